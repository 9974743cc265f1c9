"""The filter audit, the centroid clusters and the reply trees against brute force, on planted odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from tapeloom.llm import centroids, chat_trees, filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit


def audit_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefé中😀") for _ in range(rng.randint(1, 20)))
    texts = [" ".join(word() for _ in range(n)) for n in (199, 200, 201, 400, 1000)]
    texts += ["a " * 199 + "a", "ab cd " * 120, " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200))]
    texts += ["Aé" + "é" * 31, "Aé" + "é" * 32, "HELLO " * 300, "x $ y", "x|y", "a*", "no symbol", "", None, "", " \t\n\x0b\f\r ", "\x1c\x85\xa0 unit"]
    texts += ["z" * 70_000 + " " + "z" * 70_000 + " " + "z" * 69_999 + "y", "word " * 20_000 + "#"]
    texts += texts[:4] + [texts[0]] * 30
    rows = [(i, t, ("en", "fr", None, "")[i % 4], "k", "n", 1) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "en", "k", "n", 1), (None, texts[0], "de", "k", "n", 1), (0, texts[0], "de", "k", "n", 1), (0, texts[0], "en", "k", "n", 1), (0, "other", "en", "k", "n", 1)]


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]), strict=True) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                earlier = [d for d in mine if f in d[1] and d not in gone and d[1] & set(order[:step - 1])]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), len(earlier), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark):
    rows, labels = audit_rows(), [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (99_999, 1, 1)]
    labels = [(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, failed string, part int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(docs, marks).collect())
    want = brute_audit(rows, labels)
    assert len(got) == 600 * 4 and got == want  # '' and null are one part
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0


def test_transducer_against_text_functions():
    rng = random.Random(1)
    letters = "aB \t\n\x0b\f\r#|é中😀\x1c\x85\x00Z"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", " ", "a" * 64, "a" * 65, "a" * 64 + " " + "a" * 65 + " " + "a" * 64]
    got = filter_audit.text_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = WORDS.findall(t)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t))
        assert tuple(int(got[k][i]) for k in ("words", "distinct", "capitals", "symbols", "points")) == want


def test_hash_table_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(filter_audit, "mix", lambda x: np.zeros(len(x), np.uint64))  # every word falls on one slot
    texts = [b"one two one three abcdefghi abcdefghj abcdefghi", b"one", b"two two"]
    assert filter_audit.text_counts(texts)["distinct"].tolist() == [5, 1, 1]


# ---- centroids


def full_clusters(rows, size, k, rounds, seed):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, q in kept:
            held[near(q)[1]].append(q)
        cents = [[sum(col) // len(held[j]) for col in zip(*held[j], strict=True)] if held[j] else c for j, c in enumerate(cents)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found), key=str)


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, (np.round(rng.normal(0, 2, 8)) / 4).astype(np.float32).tolist()) for i in range(60)]  # many ties
    rows += [(i, rows[0][1]) for i in range(300, 320)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 7), (403, [0.0] * 9), (404, [None] + [0.0] * 7), (405, [float("nan")] + [0.0] * 7),
             (406, [float("inf")] + [0.0] * 7), (407, [-float("inf")] + [0.0] * 7), (408, [0.0] * 8), (409, [-1000.5] * 8)]
    return rows


@pytest.mark.parametrize("k", [1, 6, 40])
def test_clusters(spark, k):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, q string, cluster int").repartition(3)
    got = sorted((tuple(r) for r in centroids.cluster_vectors(df, size=8, k=k, rounds=4, seed=2).collect()), key=str)
    assert got == full_clusters(rows, 8, k, 4, 2)


def test_clusters_of_few_vectors(spark):
    rows = vector_rows()[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in centroids.cluster_vectors(df, 8, 40, 2, 2).collect()), key=str) == full_clusters(rows, 8, 40, 2, 2)
    assert centroids.cluster_vectors(df.limit(0), 8).count() == 0
    far = spark.createDataFrame([(1, [3e38] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(far, 8).collect()


def test_search_rejects_without_a_wrong_answer():
    rng = np.random.default_rng(9)
    spread = rng.integers(-3000, 3000, (500, 1)) + rng.integers(-40, 40, (500, 16))  # means differ, so that bounds bite
    cents = spread[:40].astype(np.int64)
    search = centroids.Search(cents)
    number, distance = search.nearest(spread.astype(np.int64))
    full = ((spread[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert search.compared < full.size / 8


# ---- reply trees


def brute_paths(rows, keep):
    out, trees = [], collections.defaultdict(dict)
    for tree, node, parent, score in rows:
        trees[tree][node] = (parent, score or 0)
    for tree, nodes in trees.items():
        parents = {p for p, _ in nodes.values()}
        by_root = collections.defaultdict(list)
        for leaf in nodes:
            if leaf not in parents:
                path = [leaf]
                while nodes[path[-1]][0] in nodes:
                    path.append(nodes[path[-1]][0])
                by_root[path[-1]].append((-sum(nodes[x][1] for x in path) / len(path), -len(path), leaf, path[::-1]))
        for root, found in by_root.items():
            out += [(tree, root, r, leaf, -score, path) for r, (score, _, leaf, path) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out, key=str)


def test_reply_paths(spark):
    rng = random.Random(8)
    rows = [(1, i, i - 1 if i else None, rng.randint(0, 9)) for i in range(70)]  # one long chain
    rows += [(2, i, rng.randint(0, i - 1) if i else None, rng.choice([None, 1, 5])) for i in range(120)]  # bushy, with ties
    rows += [(None, 5, None, 1), (None, 6, 5, 2), (3, 1, 77, 4), (3, 2, 1, 4), (4, 9, None, None), (5, 1, None, 1), (5, 2, None, 3)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score long").repartition(3)
    for keep in (1, 3, 1000):
        got = sorted((tuple(r) for r in chat_trees.reply_paths(df, keep).collect()), key=str)
        assert got == brute_paths(rows, keep)
    assert chat_trees.reply_paths(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        chat_trees.reply_paths(spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1)], "tree long, node long, parent long, score long"))


def test_branches_are_formatted(spark):
    tree = [(1, 1, None, 0), (1, 2, 1, 5), (1, 3, 1, 9), (1, 4, 3, 2)]
    said = [(1, 1, "user", "q"), (1, 2, "assistant", "short"), (1, 3, "assistant", "better"), (1, 4, "user", "thanks")]
    nodes = spark.createDataFrame(tree, "tree long, node long, parent long, score long")
    texts = spark.createDataFrame(said, "tree long, place long, role string, text string")
    rows = chat_trees.format_paths(texts, chat_trees.reply_paths(nodes, 2)).orderBy("rank").collect()
    turn = "<|im_start|>{}<|im_sep|>{}<|im_end|>\n"
    assert [r["formatted"] for r in rows] == [
        turn.format("user", "q") + turn.format("assistant", "better") + turn.format("user", "thanks"), turn.format("user", "q") + turn.format("assistant", "short")]
    assert [r["formatted"].encode()[s.first:s.first + s.bytes].decode() for r in rows for s in r["loss_spans"]] == ["better", "short"]


def test_escapes_round_trip(spark):
    rng = random.Random(2)
    bits = ["<", "[", "\\", "|", "s>", "/s>", "<SYS>>", "</SYS>>", "INST]", "/INST]", "im_end|>", "<|im_sep|>", "$1", "é", "\n", "start_of_turn>", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat_trees.escaped("t").alias("e"), chat_trees.unescaped(chat_trees.escaped(df["t"])).alias("u")).collect()
    control = re.compile(r"[<\[](\||s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|start_of_turn>|end_of_turn>)")
    for r in rows:
        assert r["u"] == r["t"] and not control.search(r["e"])


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["<|im_end|>", "é中", "ok", "</s>"]) for _ in range(rng.randint(0, 9)))) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t} 😀") for t in range(700)]  # more than two blocks of running sums
    rows += [(60, 0, None, None), (60, 1, "assistant", None), (60, 2, "assistant", ""), (61, 0, "assistant", "a" * 300_000), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
             (62, None, "user", "first"), (62, 3, "assistant", "tie"), (62, 3, "assistant", "tie"), (63, 5, "user\n<|im_sep|>", "odd role")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, rank int").repartition(3)
    convs = collections.defaultdict(list)
    for c, t, role, text in rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        convs[c].append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    formatted = chat_trees.format_conversations(chat_trees.with_probe(df))
    got = chat_trees.conversation_digests(formatted).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    assert {r["tree"]: r["n"] for r in formatted.selectExpr("tree", "length(formatted) n").collect()} == {r["conv_id"]: r["formatted_chars"] for r in got}
    assert [r["conv_id"] for r in chat_trees.conversation_digests(chat_trees.format_conversations(chat_trees.with_probe(df.limit(0)))).collect()] == [-7]
