r"""Reply trees as conversations: root-to-leaf paths by iterative self-joins, branches ranked by score, each chosen path formatted.

Messages are (tree, node, parent, score) rows; a message without a parent, or whose parent isn't there, is a root. Joined with itself, the
table of parents gives that of ancestors two steps up, that again those four steps up, and so on, each with the sum of the scores
passed, until no path is so long: as many self-joins as the longest path has binary digits. With these tables every leaf climbs to
its root in as many joins, which gives the length and score of its branch without naming its nodes; branches are ranked
within their root (mean score, then length, then the smaller leaf) and only the nodes of the chosen ones are then enumerated,
each once, by the same tables from the largest step to the smallest.

Formatting: a turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings inside roles and texts (those of this and
of other templates, see CONTROL) get a backslash after their first character; where some stand there already, one more. Taking one away
wherever a first character, backslashes and the rest of a control string follow each other gives back the text. The loss mask
is a list of spans (first byte, bytes) of the UTF-8 form, one for each text of the roles that are learned.

Only DataFrame functions are used. A path is one value in the end, so that its messages come together in one row; the walk itself
joins on (tree, node), where a tree with a third of all rows spreads like any other.

Odd rows: a null text or role is an empty one. Rows of a conversation with equal turn go by role, then by the hash of the text; equal rows are turns of their own. A
null turn comes first. Rows with a null conv_id form one conversation with a null id. Replies that form a cycle are an error. An
empty table gives no rows. Texts of any length are escaped whole. Further columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.base import let, stored

TURN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# fixed values: what stands behind the first character, < or [, of a control string of this or another template
CONTROL = (r"\|", "s>", "/s>", "<SYS>>", "</SYS>>", r"INST\]", r"/INST\]", "start_of_turn>", "end_of_turn>")
_REST = "(" + "|".join(CONTROL) + ")"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


# ---- paths


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, passed) of the ancestor 1, 2, 4, ... steps up and the scores from the node to below it."""
    parents = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("up"))
    same = F.col("tree").eqNullSafe(F.col("_tree"))
    first = nodes.select("tree", "node", F.col("parent").alias("_parent"), F.col("score").alias("passed")).where("_parent is not null")
    first = first.join(parents, same & (F.col("_parent") == F.col("up"))).select("tree", "node", "up", "passed")
    tables = [stored(first, "up1")]
    while tables[-1].take(1):
        if len(tables) > 40:
            raise ValueError("replies form a cycle")
        half = tables[-1]
        above = half.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("passed").alias("_passed"))
        whole = half.join(above, same & (F.col("up") == F.col("_node")))
        tables.append(stored(whole.select("tree", "node", F.col("_up").alias("up"), (F.col("passed") + F.col("_passed")).alias("passed")), f"up{1 << len(tables)}"))
    return tables[:-1]


def _climbed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (tree, at, ...) beside the ancestor of ``at`` in ``table``, null where the tree isn't so high."""
    above = table.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("passed").alias("_passed"))
    return rows.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("at") == F.col("_node")), "left")


def branches(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree, root, leaf, n (messages), score (sum) of every root-to-leaf path."""
    inner = tables[0].select(F.col("tree").alias("_tree"), F.col("up").alias("_up")).distinct() if tables else None
    leaves = nodes
    if inner is not None:
        leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_up")), "left_anti")
    rows = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("passed"))
    for i in range(len(tables) - 1, -1, -1):
        went = F.col("_up").isNotNull()
        rows = _climbed(rows, tables[i]).select(
            "tree", "leaf", F.coalesce("_up", "at").alias("at"), (F.col("n") + F.when(went, 1 << i).otherwise(0)).alias("n"),
            (F.col("passed") + F.coalesce("_passed", F.lit(0))).alias("passed"))
    ends = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("score").alias("_score"))
    rows = rows.join(ends, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("at") == F.col("_node")))
    return rows.select("tree", F.col("at").alias("root"), "leaf", "n", (F.col("passed") + F.col("_score")).alias("score"))


def reply_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """tree, root, rank, leaf, score (mean), path (nodes from the root on) of the best ``paths`` branches of every root.

    ``messages``: tree, node (unique in its tree), parent (null for a root), score (long; null counts 0).
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0)).cast("long").alias("score"))
    nodes = stored(nodes, "nodes")
    tables = _ancestors(nodes)
    mean = F.col("score") / F.col("n")
    place = F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.desc(mean), F.desc("n"), "leaf"))
    found = branches(nodes, tables)
    chosen = found.withColumn("rank", place).where(F.col("rank") <= paths).select("tree", "root", "rank", "leaf", mean.alias("score"))
    chosen = stored(chosen, "chosen")
    # every node of the chosen paths, by its distance from the leaf: the largest steps first, so that each distance comes once
    rows = chosen.select("tree", "leaf", F.col("leaf").alias("at"), F.lit(0).alias("distance"))
    for i in range(len(tables) - 1, -1, -1):
        here = F.struct("at", "distance")
        above = F.struct(F.col("_up").alias("at"), (F.col("distance") + (1 << i)).alias("distance"))
        both = F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, above))
        rows = _climbed(rows, tables[i]).select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.*")
    listed = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("distance", "at")), asc=False)["at"].alias("path"))
    listed = listed.select(F.col("tree").alias("_tree"), F.col("leaf").alias("_leaf"), "path")
    return chosen.join(listed, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("leaf") == F.col("_leaf"))).select("tree", "root", "rank", "leaf", "score", "path")


# ---- format and read back


def running_sums(sizes: Column, block: int = 256) -> Column:
    """What stands before each element of an array of numbers, in two levels, as an array grows by copying."""
    grown = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
    inside = F.transform(blocks, grown)  # the last element is the sum of the block
    both = lambda part: let(
        grown(F.transform(part, lambda p: F.element_at(p, -1))),
        lambda base: F.flatten(F.transform(part, lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(base, b)))))
    return let(inside, both)


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(role), F.lit(SEP), escaped(text), F.lit(END + "\n"))


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of ``paths`` (tree, path, ...) with formatted (string) and loss_spans (first byte from 0, bytes).

    ``messages``: tree, place (any order within the tree), role, text; the numbers of ``path`` count a tree's messages in that
    order, from 1. The texts are moved once, to their tree.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = messages.select("tree", "place", turn_text(role, text).alias("turn"), F.octet_length(escaped(role)).alias("role_bytes"), role.isin(*LEARNED).alias("learned"))
    # a key that is never null: a null-safe join would deal the gathered texts out again
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    held = turns.groupBy(key.alias("_key")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role_bytes", "learned"))).alias("turns"))
    rows = paths.withColumn("_key", key).join(held, "_key")
    ahead, behind = len(TURN) + len(SEP), len(END) + 1

    def spans(turns: Column, places: Column) -> Column:
        span = lambda t, i: F.struct(
            (F.get(places, i) + t["role_bytes"] + ahead).alias("first"), (F.octet_length(t["turn"]) - t["role_bytes"] - ahead - behind).alias("bytes"))
        return F.filter(F.transform(turns, lambda t, i: F.when(t["learned"], span(t, i))), lambda s: s.isNotNull())

    def form(turns: Column) -> Column:
        sizes = F.transform(turns, lambda t: F.octet_length(t["turn"]))
        return F.struct(
            F.array_join(F.transform(turns, lambda t: t["turn"]), "").alias("formatted"), let(running_sums(sizes), lambda p: spans(turns, p)).alias("loss_spans"))

    chosen = let(F.col("turns"), lambda t: F.transform("path", lambda i: F.get(t, i.cast("int") - 1)))
    return rows.withColumn("_form", let(chosen, form)).select(*paths.columns, "_form.formatted", "_form.loss_spans")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)
    return F.transform(parts, lambda p: let(F.split(p, r"<\|im_sep\|>|<\|im_end\|>"), lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text"))))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    cut = lambda b: F.transform(loss_spans, lambda s: unescaped(F.decode(F.substring(b, s["first"] + 1, s["bytes"]), "UTF-8")))
    return F.array_join(let(formatted.cast("binary"), cut), "")


# ---- the conversations of the given table


def with_probe(conversations: DataFrame) -> DataFrame:
    """All rows, and the conversation -7, whose texts are made of another template's control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.createDataFrame(
        [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe)


def conversation_trees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, texts) of conversations by turn: each row replies to the one before it and scores the length of its text."""
    # equal rows have one place; which of them comes first makes no difference
    place = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    texts = rows.select(F.col("conv_id").alias("tree"), place.alias("place"), "role", "text")
    light = texts.select("tree", "place", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("score"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("place"))
    messages = light.select("tree", node.alias("node"), "score")
    return messages.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "score"), texts


def format_conversations(conversations: DataFrame) -> DataFrame:
    """tree (conv_id), root, rank, leaf, score, path, formatted, loss_spans of every conversation."""
    messages, texts = conversation_trees(conversations)
    return format_paths(texts, reply_paths(messages))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


# rows of equal turn and role go by their texts here; what is read back from the output has to equal what went in
SQL_TWIN = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, '<|im_start|>' || regexp_replace(role, '([<\[])(\\*)REST', '\1\\\2\3', 'g') || '<|im_sep|>' || regexp_replace(text, '([<\[])(\\*)REST', '\1\\\2\3', 'g')
             || '<|im_end|>' || chr(10) AS formatted FROM m),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(formatted)) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM c
""".replace("REST", _REST)
