"""Near-duplicate documents: an exact Jaccard join in the metric space of shingle sets.

The distance is 1 - |A & B| / |A | B|, a metric. The join splits the space by pivots and goes down recursively:

1.  First pivots are single shingles. A set lies nearest to the one with the smallest hash among its own; sets within
    the join radius of each other can differ in at most a fifth of their shingles, so that the window of the first
    n - ceil(0.8 n) + 1 shingles in hash order reaches a common pivot. Every document is replicated to these regions.
2.  Every region names one of its documents as pivot (the smallest key). Regions with the same pivot fall together, so
    that thousands of near copies make one cell. Distances to the pivot are exact.
    Before whole sets are moved, the windows of a bounded cell are compared: they hold enough of two sets to rule out most
    pairs exactly (a common passage), and a cell falls apart into those documents that may be linked.
3.  A cell of a bounded number of shingles is joined in one task: pivot by pivot, each compared with all of its part,
    which is then split into a near part (up to 3 R from the pivot, R the radius) and a far part (from 2 R on). Two
    documents within R of each other are both in one of them, by the triangle inequality: the ring is replicated.
    Documents that hang together already, as two that are linked to one pivot, are not compared.
4.  A larger cell is split by its pivot in Spark in the same way, level by level. Its far documents only share frequent
    shingles with the pivot (a passage that many texts quote); they go back to step 1 with these shingles put last. So do
    all documents of cells whose pivots have no room beside those of the heaviest cells, which are split first.

What comes out are links between representatives of different sets, a spanning set of each group; equal sets are one
node from the start. Documents with words but no doc_id take part and get the smallest id of their group (null if it has none).
Rows that repeat a doc_id are judged by their own text. Null or wordless texts have an empty set and no links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  so that pa.compute is there
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.base import SMALL_ROWS, forget, mapped, small_side, stored, sweep
from tapeloom.llm.components import components
from tapeloom.llm.words import mix, shingle_sets

#: Shingles that a cell may hold to be joined in one task (8 bytes each); eight times more on each of three further levels.
CELL_SHINGLES = 150_000
#: The same for cells of which only the windows are compared.
WINDOW_SHINGLES = 30_000
#: Far documents that share a shingle with their pivot, beyond which it counts as frequent.
FREQUENT = 50
#: Of the frequent shingles of a round, how many go to the end of the order.
HOT_MOST = 200_000
#: Rounds of step 4; what is left then is split by pivots to the end.
ROUNDS = 4
#: Shingles of pivots that a task may hold (8 bytes each), and how many of the heaviest cells are looked at to fill it.
CENTRE_SHINGLES = 2_000_000
HEAVIEST = 20_000


def _signature(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key for each set, 0 for the empty set."""
    n = np.diff(offsets)
    filled = n > 0
    out = np.zeros(len(n), np.uint64)
    if filled.any():
        at = offsets[:-1][filled]
        a, b = np.add.reduceat(mix(hashes + np.uint64(0x51ED27)), at), np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0xABCDEF)), at)
        out[filled] = mix(mix(a) + b * np.uint64(3) + n[filled].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _window(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n must be looked at to meet any set at least so similar."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _lists(values: np.ndarray, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(values.view(np.int64)))


def document_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig (key of the set), its window of first shingles, tie (hash of the text), and a number of the row."""

    def kernel(batch):
        hashes, offsets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), k)
        n = np.diff(offsets)
        w = _window(n, percent)
        at = np.repeat(offsets[:-1] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(_signature(hashes, offsets)), _lists(hashes[at], w), batch.column(2)], ["doc_id", "n_shingles", "sig", "window", "tie"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    sets = mapped(rows, kernel, f"doc_id {kind}, n_shingles long, sig long, window array<long>, tie long")
    return sets.withColumn("rid", F.monotonically_increasing_id())


def _cells(spread: DataFrame) -> DataFrame:
    """From (node, shingle), each once: the members (cell, node) of all cells of two documents or more."""
    shared = stored(spread.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    sweep(spread.sparkSession)  # the next step may deal out as many rows again
    rows = stored(spread.join(small_side(shared.select("shingle")), "shingle").select("shingle", "node"), "rows")
    pivots = rows.groupBy("shingle").agg(F.min("node").alias("cell"))
    members = rows.join(pivots, "shingle").select("cell", "node").distinct()
    return stored(members, "members", shared, rows)


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, tie) of rows that come more than once with one id and text, as a written table."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"))
    return stored(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tie"), "repeated")


def _texts(nodes: DataFrame, sets: DataFrame, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """A written table of nodes, each once, with the text and the key of the set of each, and with its other columns.

    Texts stay where they are as long as the nodes can be sent to them; beyond that they are shuffled, once for a step.
    Whole sets are larger than texts and are never joined: what a step needs to know of a node comes along with it.
    """
    extra = [c for c in nodes.columns if c != "node"]
    own = sets.select(F.col("rid").alias("node"), "doc_id", "sig", "tie").join(small_side(nodes, SMALL_ROWS // (4 if extra else 1)), "node")
    twice = small_side(repeated.select(F.col("doc_id").alias("twice_id"), F.col("tie").alias("twice_tie"), F.lit(True).alias("twice")))
    one = own.join(twice, F.col("doc_id").eqNullSafe(F.col("twice_id")) & (F.col("tie") == F.col("twice_tie")), "left")
    one = stored(one.select("node", "doc_id", "sig", "tie", F.coalesce("twice", F.lit(False)).alias("twice"), *extra), "wanted", nodes)
    # by id and text: one id, or none, may stand for any number of texts
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.xxhash64("d.text") == F.col("w.tie"))

    def met(part):
        # four longs and more a row; the hash table is of the nodes, so that texts are not sorted
        small = small_side(part, SMALL_ROWS // (4 if extra else 2))
        side = small if small is not part else part.hint("shuffle_hash")
        return docs.select("doc_id", "text").alias("d").join(side.alias("w"), same).select("w.node", "d.text", "w.sig", *(f"w.{c}" for c in extra))

    every = met(one.where("not twice"))
    again = one.where("twice")
    # only rows that come more than once are moved to be told apart
    return every.union(met(again).dropDuplicates(["node", "text"])) if again.take(1) else every


def _whole(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of ``_texts``: the rows whose text has the set that the node stands for, and the sets of all rows (hashes, offsets)."""
    hashes, offsets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)
    own = np.flatnonzero(_signature(hashes, offsets) == batch.column("sig").to_numpy())  # a hash of a text may be another text's too
    return own, hashes, offsets


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def _full_sets(nodes: DataFrame, sets: DataFrame, docs: DataFrame, repeated: DataFrame, k: int,
               cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(node, hashes), each node once, of a written table of nodes: the whole sets, made anew from the texts.

    They are as large as the texts and each step needs others, so that they are neither kept nor shuffled here. ``cut``, from
    hashes and lengths of sets to those that go on, runs where the sets are made: a step of its own would be a second Python
    worker beside each task's first, and executors keep their workers.
    """

    def kernel(batch):
        own, hashes, offsets = _whole(batch, k)
        n = np.diff(offsets)[own]
        kept = hashes[_runs(offsets[own], n)]
        kept, n = cut(kept, n) if cut else (kept, n)
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own)), _lists(kept, n)], ["node", "hashes"])

    return mapped(_texts(nodes, sets, docs, repeated), kernel, "node long, hashes array<long>")


def _places(members: DataFrame) -> DataFrame:
    """(node, cells, labels): the cells that each node of (cell, node, label) is in, and its labels there, as a written table."""
    rows = members.groupBy("node").agg(F.collect_list(F.struct("cell", "label")).alias("places"))
    return stored(rows.select("node", F.col("places.cell").alias("cells"), F.col("places.label").alias("labels")), "places")


def _placed(batch: pa.RecordBatch, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows ``own`` of a batch with columns cells and labels: row, cell and label of each place."""
    cells, labels = batch.column("cells"), batch.column("labels")
    starts, ends = cells.offsets.to_numpy()[:-1][own], cells.offsets.to_numpy()[1:][own]
    first = labels.offsets.to_numpy()[:-1][own]
    lens = ends - starts
    return np.repeat(own, lens), cells.values.to_numpy()[_runs(starts, lens)], labels.values.to_numpy()[_runs(first, lens)]


def first_shingles(hashes: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of whole sets of n hashes each, and their lengths, in the order that puts the shingles ``hot`` (sorted) last.

    Any order of the shingles serves, as long as it is one for all documents.
    """
    signed = hashes.view(np.int64)
    late = np.searchsorted(hot, signed, side="right") > np.searchsorted(hot, signed)
    order = np.argsort(2 * np.repeat(np.arange(len(n)), n) + late, kind="stable")
    w = _window(n, percent)
    at = np.repeat(np.cumsum(n) - n - (np.cumsum(w) - w), w) + np.arange(w.sum())
    return hashes[order[at]], w


def possible_cells(nodes: np.ndarray, n: np.ndarray, windows: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(cell, node) of documents that may have a link in this cell, by their windows alone.

    Below the smaller of two windows' last hashes, both sets are known, and so is a part of their symmetric difference. A
    similarity of t allows a difference of (1 - t) / (1 + t) of both sizes together; pairs that exceed it are out. Windows
    come as the high halves of their hashes, which can only make two sets look more alike. What hangs together by the
    other pairs is a cell of its own, named by its smallest key.
    """
    nodes, first = np.unique(nodes, return_index=True)
    n, windows = n[first], [windows[i] for i in first]
    size = np.fromiter((len(w) for w in windows), np.int64, len(windows))
    at = np.cumsum(size) - size
    every = np.concatenate(windows)
    last = np.where(size == n, 1 << 32, every[at + size - 1].astype(np.int64))
    code = np.unique(every, return_inverse=True)[1]
    flag = np.zeros(int(code.max()) + 1, bool)
    out, left = [], np.arange(len(nodes))
    while len(left) > 1:
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            p = todo.pop()
            rows = left[(100 * n[left] >= percent * n[p]) & (100 * n[p] >= percent * n[left])]
            if not len(rows):
                continue
            mine = slice(at[p], at[p] + size[p])
            flag[code[mine]] = True
            lens = size[rows]
            begin = np.cumsum(lens) - lens
            spots = np.repeat(at[rows] - begin, lens) + np.arange(lens.sum())
            both = np.add.reduceat(flag[code[spots]].astype(np.int64), begin)  # the last hash itself may count here: too alike again
            flag[code[mine]] = False
            theirs = np.add.reduceat((every[spots] < last[p]).astype(np.int64), begin)
            ours = np.searchsorted(windows[p], last[rows], side="left")
            near = rows[(100 + percent) * (theirs + ours - 2 * both) <= (100 - percent) * (n[rows] + n[p])]
            group += near.tolist()
            todo += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
        if len(group) > 1:
            cell = int(nodes[min(group)])
            out += [(cell, int(nodes[x])) for x in group]
    return out


def _narrowed(members: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Members of cells after the comparison of windows; cells with more than ``most`` shingles in windows stay as they are."""
    high = F.transform("window", lambda h: F.shiftright(h, 32).cast("int"))
    size = F.expr(f"n_shingles - (n_shingles * {percent} + 99) div 100 + 1")  # as _window
    sizes = sets.select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"), size.alias("size"))
    placed = stored(sizes.join(small_side(members), "node"), "placed")
    weights = stored(placed.groupBy("cell").agg(F.sum("size").alias("weight")), "weights")
    bounded = placed.join(weights.where(F.col("weight") <= most).select("cell"), "cell")
    # no link without a set of like size: of a cell in order of size, one of the two next to it
    by_size = Window.partitionBy("cell").orderBy("n")
    alike = bounded.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    alike = alike.where((100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above")))
    small = stored(alike.select("cell", "node"), "placed")
    full = sets.select(F.col("rid").alias("node"), "n_shingles", high.alias("window")).join(small_side(small), "node")

    def run(rows):
        windows = rows["window"].combine_chunks()
        cuts, values = windows.offsets.to_numpy(), windows.values.to_numpy().view(np.uint32)
        found = possible_cells(rows["node"].to_numpy(), rows["n_shingles"].to_numpy(), [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], percent)
        return pa.table({"cell": pa.array([f[0] for f in found], pa.int64()), "node": pa.array([f[1] for f in found], pa.int64())})

    narrow = full.select("cell", "node", "n_shingles", "window").groupBy("cell").applyInArrow(run, "cell long, node long")
    large = placed.join(weights.where(F.col("weight") > most).select("cell"), "cell").select("cell", "node")
    return stored(narrow.union(large).distinct(), "members", members, placed, weights, small)


def join_cell(nodes: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Exact links of one bounded cell, enough of them to join all that hangs together.

    Documents of equal label (not negative) hang together already; such pairs are not compared.
    """
    nodes, first = np.unique(nodes, return_index=True)
    sets = [sets[i] for i in first]
    label = -1 - np.arange(len(nodes)) if labels is None else np.where(labels[first] >= 0, labels[first], -1 - np.arange(len(nodes)))
    label = np.unique(label, return_inverse=True)[1]
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(size) - size
    flag = np.zeros(len(values), bool)
    radius = (100 - percent) / 100
    links, todo = [], [(np.arange(len(nodes)), np.ones(len(nodes), bool))]
    while todo:
        rows, must = todo.pop()
        while must.any() and len(rows) > 1:
            mine = label[rows]
            classes, count = np.unique(mine, return_counts=True)
            if len(classes) == 1:
                break
            # of two documents with different labels, one is outside the most frequent label
            outside = np.flatnonzero(must & (mine != classes[count.argmax()]))
            here = int(outside[0]) if len(outside) else int(np.flatnonzero(must)[0])
            pivot = rows[here]
            flag[code[at[pivot]:at[pivot] + size[pivot]]] = True
            lens = size[rows]
            begin = np.cumsum(lens) - lens
            spots = np.repeat(at[rows] - begin, lens) + np.arange(lens.sum())
            both = np.add.reduceat(flag[code[spots]].astype(np.int64), begin)
            flag[code[at[pivot]:at[pivot] + size[pivot]]] = False
            union = lens + size[pivot] - both
            linked = 100 * both >= percent * union
            linked[here] = False
            for x in rows[linked]:
                if label[x] != label[pivot]:
                    links.append((int(nodes[pivot]), int(nodes[x])))
                    label[label == label[x]] = label[pivot]
            away = 1 - both / union
            others = np.arange(len(rows)) != here
            must[here] = False
            near, far = others & (away <= 3 * radius + 1e-9), others & (away > 2 * radius - 1e-9)
            # a wide ring would be compared in both parts again and again: then the cell stays whole, without its pivot
            if 4 * (near & far).sum() > len(rows):
                rows, must = rows[others], must[others]
                continue
            if (far & ~near).any() and (must & far).any():
                todo.append((rows[far], must[far]))
            rows, must = rows[near], must[near]
    return links


def _small_links(members: DataFrame, sets: DataFrame, docs: DataFrame, repeated: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of the cells of a written table (cell, node, label); each set goes to the cells that it is in, and nowhere else."""

    def kernel(batch):
        own, hashes, offsets = _whole(batch, k)
        row, cell, label = _placed(batch, own)
        n = np.diff(offsets)[row]
        arrays = [pa.array(cell), batch.column("node").take(pa.array(row)), pa.array(label), _lists(hashes[_runs(offsets[row], n)], n)]
        yield pa.RecordBatch.from_arrays(arrays, ["cell", "node", "label", "hashes"])

    def run(batch):
        found = join_cell(batch["node"].to_numpy(), [np.asarray(h, np.int64) for h in batch["hashes"]], percent, batch["label"].to_numpy())
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    cells = mapped(_texts(_places(members), sets, docs, repeated), kernel, "cell long, node long, label long, hashes array<long>")
    return cells.groupBy("cell").applyInPandas(run, "u long, v long")


class Pivots:
    """Pivot documents of cells with their sets, as a task holds them: sorted cells, the pivot of each, and where its set lies."""

    def __init__(self, cells: np.ndarray, pivots: np.ndarray, names: np.ndarray, hashes: np.ndarray, offsets: np.ndarray):
        """cells, pivots: a pivot for each cell. names, hashes, offsets: each pivot's sorted set."""
        by_cell, by_name = np.argsort(cells), np.argsort(names)
        self.cells, self.pivots = cells[by_cell], pivots[by_cell]
        at = by_name[np.searchsorted(names, self.pivots, sorter=by_name)]
        self.starts, self.ends, self.hashes = offsets[:-1][at], offsets[1:][at], hashes

    def common(self, cells: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """For sorted sets, each in a cell of known pivot: whether there is one, the pivots, the sizes of their sets, and what the two have in common."""
        at = np.minimum(np.searchsorted(self.cells, cells), max(0, len(self.cells) - 1))
        known = self.cells[at] == cells if len(self.cells) else np.zeros(len(cells), bool)
        shared = []
        for spot, mine in zip(at[known], (s for s, ok in zip(sets, known, strict=True) if ok), strict=True):
            centre = self.hashes[self.starts[spot]:self.ends[spot]]
            few, many = (mine, centre) if len(mine) <= len(centre) else (centre, mine)
            shared.append(few[many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few])
        at = at[known]
        return known, self.pivots[at], self.ends[at] - self.starts[at], shared


def _heaviest(pivots: DataFrame, most: int) -> Column:
    """Of pivots (cell, weight, size), the condition that holds for the heaviest cells, as many as have ``most`` shingles in their pivots, one at least."""
    first = pivots.orderBy(F.desc("weight"), "cell").limit(HEAVIEST).select("weight", "cell", "size").toPandas()
    last = first.iloc[max(1, int((first["size"].cumsum() <= most).sum())) - 1]
    weight, cell = int(last["weight"]), int(last["cell"])
    return (F.col("weight") > weight) | ((F.col("weight") == weight) & (F.col("cell") <= cell))


def _split(members: DataFrame, sets: DataFrame, docs: DataFrame, repeated: DataFrame, k: int, live: DataFrame, percent: int, centre_shingles: int,
           every: bool) -> tuple[list[DataFrame], DataFrame]:
    """Distances of members of large cells to a pivot of their cell: the one with the smallest key outside the most frequent label.

    Pivots are sent to the tasks that make the members' sets, so that no set but a pivot's leaves its task. As many go at a time as
    have ``centre_shingles`` shingles: those of the heaviest cells, and if ``every`` is set the others after them, each time
    reading the texts of their own members. One written table for each time, and one of the nodes of cells that were not split.
    """
    lead = members.join(live, "cell").where("label < 0 or label <> top").groupBy("cell", "weight").agg(F.min(F.struct("node", "n")).alias("lead"))
    pivots = stored(lead.select("cell", "weight", F.col("lead.node").alias("pivot"), F.col("lead.n").alias("size")), "pivots")
    total = pivots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    now = pivots if every or total <= centre_shingles else pivots.where(_heaviest(pivots, centre_shingles))
    left = stored(members.join(pivots, "cell", "left_semi").join(now.select("cell"), "cell", "left_anti").select("node").distinct(), "left")
    parts = max(1, -(-total // centre_shingles)) if every else 1
    centre = _full_sets(stored(now.select(F.col("pivot").alias("node")).distinct(), "nodes"), sets, docs, repeated, k)
    centres = stored(centre.withColumnsRenamed({"node": "pivot", "hashes": "centre"}), "centres")
    far = 3 * (100 - percent) / 100
    out = []
    for part in range(parts):
        mine = F.pmod(F.xxhash64("pivot"), F.lit(parts)) == part
        of_cells = now.where(mine).select("cell", "pivot").toArrow().combine_chunks()
        of_pivots = centres.where(mine).select("pivot", "centre").toArrow().combine_chunks()
        lists = of_pivots.column("centre").combine_chunks()
        held = Pivots(
            of_cells.column("cell").to_numpy(), of_cells.column("pivot").to_numpy(), of_pivots.column("pivot").to_numpy(),
            lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]).astype(np.int64))
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def kernel(batch, shared=shared):
            own, hashes, offsets = _whole(batch, k)
            row, cell, label = _placed(batch, own)
            known, pivot, size, common = shared.value.common(cell, [hashes[offsets[i]:offsets[i + 1]] for i in row])
            row, cell, label = row[known], cell[known], label[known]
            n, both = np.diff(offsets)[row], np.fromiter((len(c) for c in common), np.int64, len(common))
            node, either = batch.column("node").to_numpy()[row], n + size - both
            away = 1.0 - both / either
            beyond = away > far
            kept = pa.array([c.view(np.int64) if b else None for c, b in zip(common, beyond, strict=True)], pa.list_(pa.int64()))
            arrays = [pa.array(x) for x in (cell, node, n, label, pivot, (node != pivot) & (100 * both >= percent * either), away)]
            yield pa.RecordBatch.from_arrays([*arrays, kept], ["cell", "node", "n", "label", "pivot", "linked", "away", "common"])

        places = _places(members.join(now.where(mine).select("cell"), "cell", "left_semi"))
        rows = mapped(_texts(places, sets, docs, repeated), kernel, "cell long, node long, n long, label long, pivot long, linked boolean, away double, common array<long>")
        out.append(stored(rows, "split"))
        shared.unpersist()
    forget(pivots, centres)
    return out, left


def near_duplicate_links(docs: DataFrame, sets: DataFrame, k: int = 5, percent: int = 80, cell_shingles: int = CELL_SHINGLES, window_shingles: int = WINDOW_SHINGLES,
                         frequent_from: int = FREQUENT, centre_shingles: int = CENTRE_SHINGLES) -> DataFrame:
    """(u, v) of row numbers in ``sets``, each set once: links at or above the similarity that join all groups that any link joins."""
    radius = (100 - percent) / 100
    sizes = sets.select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"))
    alone = F.lit(-1).cast("long").alias("label")

    def members_of(spread):
        return sizes.join(small_side(_narrowed(_cells(spread), sets, percent, window_shingles << grow)), "node")

    grow = 0
    members = members_of(sets.select(F.col("rid").alias("node"), F.explode("window").alias("shingle")))
    members = stored(members.select("cell", "node", "n", alone), "members")
    repeated = _repeated(docs)

    links, hot, level = [], np.zeros(0, np.int64), -1
    while True:
        level += 1
        kinds = members.groupBy("cell", "label").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        weight = kinds.groupBy("cell").agg(
            F.sum("n").alias("weight"), F.sum(F.expr("if(label < 0, m, 1)")).alias("classes"), F.max_by("label", F.expr("if(label < 0, 0, m)")).alias("top"))
        weight = stored(weight.where("classes > 1"), "weights")
        # few cells go far down, so that tasks may be larger there
        grow, most = min(9, 3 * (level + 1)), cell_shingles << min(9, 3 * level)
        large = weight.where(F.col("weight") > most).select("cell", "top", "weight")
        small = stored(members.join(weight.where(F.col("weight") <= most).select("cell"), "cell"), "small")
        links.append(stored(_small_links(small, sets, docs, repeated, k, percent), "links", small))
        if not large.take(1):
            break
        members = stored(members.join(large.select("cell"), "cell"), "large", members)
        parts, left = _split(members, sets, docs, repeated, k, large, percent, centre_shingles, level >= ROUNDS)
        split = reduce(DataFrame.union, parts)
        links.append(stored(split.where("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v")), "links", members, weight))
        # labels that a link reaches become one
        reached = stored(split.where("linked and label >= 0").select("cell", "label").distinct().withColumn("reached", F.lit(True)), "reached")
        rest = split.where("node <> pivot").join(reached, ["cell", "label"], "left")
        rest = rest.withColumn("label", F.when(F.col("linked") | F.col("reached"), F.col("pivot")).otherwise(F.col("label"))).select("cell", "node", "n", "label", "away")
        if level < ROUNDS:
            near = rest.where(F.col("away") <= 3 * radius + 1e-9).select(F.xxhash64("cell", F.lit(2 * level)).alias("cell"), "node", "n", "label")
            beyond = rest.where(F.col("away") > 2 * radius - 1e-9).join(rest.where(F.col("away") > 3 * radius + 1e-9).select("cell").distinct(), "cell", "left_semi")
            # cells that wait go back as a whole: the frequent shingles of the heavier ones are mostly theirs too
            again = stored(beyond.select("node").union(left).distinct(), "again")
            # what many far documents share with a pivot; a bounded number, as others may keep their place in the order
            often = split.select(F.explode("common").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > frequent_from)
            hot = np.union1d(hot, often.orderBy(F.desc("n"), "shingle").limit(HOT_MOST).toPandas()["shingle"].to_numpy()).astype(np.int64)
            shared = docs.sparkSession.sparkContext.broadcast(hot)
            late = _full_sets(again, sets, docs, repeated, k, lambda hashes, n, shared=shared: first_shingles(hashes, n, shared.value, percent))
            late = stored(late.withColumnRenamed("hashes", "window"), "windows")
            sweep(docs.sparkSession)
            fresh = members_of(late.select("node", F.explode("window").alias("shingle")))
            fresh = fresh.select(F.xxhash64("cell", F.lit(2 * level + 1)).alias("cell"), "node", "n", alone)
            members = stored(near.union(fresh), "members", *parts, left, reached, late)
        else:  # only pivots go: the ring would be compared in both parts
            members = stored(rest.drop("away"), "members", *parts, left, reached)
    forget(members, weight, repeated)
    return reduce(DataFrame.union, links).distinct()


def _grouped_sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, n_shingles, sig, tie, rid), and each set with words: sig, root of its group, least (its smallest doc_id)."""
    sets = stored(document_sets(docs, k, percent), "sets")
    # equal sets are one node, the first row that has it
    light = stored(sets.select("doc_id", "n_shingles", "sig", "tie", "rid"), "rows")
    first = stored(light.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least")), "first")
    # the others are fewer, so that they are sent to the sets and windows stay where they are
    others = stored(light.where("n_shingles > 0").select("rid").join(first.select(F.col("node").alias("rid")), "rid", "left_anti"), "others")
    once = sets.where("n_shingles > 0").join(small_side(others), "rid", "left_anti")
    roots = components(near_duplicate_links(docs, once, k, percent))
    forget(sets, others)
    return light, first.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"), "least")


def near_duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    light, groups = _grouped_sets(docs, k, percent)
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stored(groups.join(named, "root").select("sig", "component_id"), "names")
    rows = light.where("n_shingles > 0").join(small_side(names), "sig").select("doc_id", "n_shingles", "component_id")
    return rows.union(light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: one for each group, and every row without words.

    That is the row with the group's smallest doc_id; of rows that repeat it, the one whose text hashes lowest; of rows that
    repeat both, the one whose columns hash lowest. Rows without a doc_id come last, so that a group without any id keeps one
    of them. Each row is judged by its own text, whatever other rows have its doc_id.
    """
    light, groups = _grouped_sets(docs, k, percent)
    groups = stored(groups.select("sig", "root"), "groups")
    texts = light.where("n_shingles > 0").join(small_side(groups), "sig").groupBy("root", "doc_id", "tie").agg(F.count("*").alias("n"))
    texts = stored(texts, "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    heads = stored(texts.groupBy("root").agg(F.min(order).alias("head")), "heads")
    judged = texts.join(small_side(heads), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))
    # rows that go, and the few that stay once although they come more often
    marked = judged.where("not stays or n > 1").select(F.col("doc_id").alias("marked_id"), F.col("tie").alias("marked_tie"), "stays")
    marked = small_side(stored(marked, "marked"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    same = F.col("id").eqNullSafe(F.col("marked_id")) & (F.col("tie") == F.col("marked_tie"))
    kept = rows.join(marked, same, "left_anti").select("row.*")
    again = small_side(marked.where("stays"))
    if not again.take(1):
        return kept
    once = rows.join(again, same, "left_semi").groupBy("id", "tie").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.union(once.select("row.*"))
