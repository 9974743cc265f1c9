"""Operators for training data against brute force, on small tables and on planted odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tapeloom.llm import fingerprints, html_main, license_scan, lm_score, mixing, ngram_join, packing, quality_model, quality_rules, warc
from tapeloom.llm.components import components
from tapeloom.llm.q_documents import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, row string, node string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sample_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeéß"), 4))
    base = [[word() for _ in range(120)] for _ in range(12)]
    passage = [word() for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base[:6]):
        for j in range(6):  # chains of near copies
            c = list(b)
            for at in rng.choice(120, 1 + j % 3, replace=False):
                c[at] = word()
            texts.append(" ".join(c))
    texts += [" ".join([word() for _ in range(70)] + passage + [word() for _ in range(70)]) for _ in range(12)]
    texts += [None, "", " \n\t", "two words", "Two Words", texts[0], texts[0], "x", "a b c d", "Apache License and MIT license, CC BY-NC. GNU general public license cc by",
              "Licensed under the Apache License, Version 2.0", "*** $$$ " * 30, "same line here\n" * 9 + "end", " ".join(word() for _ in range(5000))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, "r", "n") for i, t in enumerate(texts)]
    return rows + [(None, "no id at all", "en", "s1", "r", "n"), (3, texts[3], "en", "s0", "r", "n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [x for x in WORDS.findall((text or "").encode().lower().decode())]
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return sorted(((i, len(s), min((x for x in least[find(a)] if x is not None), default=None)) for a, (i, s) in enumerate(sets)), key=str)


def test_long_words_that_differ_by_a_swap_are_two(spark):
    word = bytearray(b"abcdefghij" * 7000)
    word[10], word[10 + 65536] = word[10 + 65536] + 1, word[10]
    texts = ["abcdefghij" * 7000, word.decode(), "abcdefghij" * 7000]
    swapped = bytearray(texts[0].encode())
    swapped[3], swapped[3 + 65536] = swapped[3 + 65536], swapped[3]
    rows = [(i, t) for i, t in enumerate([*texts, swapped.decode()])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def test_near_duplicates(docs, empty):
    got = sorted((tuple(r) for r in ngram_join.near_duplicate_groups(docs).collect()), key=str)
    assert got == brute_groups(sample_rows())
    assert ngram_join.near_duplicate_groups(empty).count() == 0
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns


def test_kept_rows(spark, empty):
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [[word() for _ in range(100)] for _ in range(6)]
    text, near = [" ".join(b) for b in base], [" ".join([*b[:-1], word()]) for b in base]
    rows = [(3, text[0]), (3, text[0]), (3, near[0]), (4, near[0]), (4, near[0])]  # repeated rows, and two texts of one group on one id
    rows += [(5, near[0]), (5, text[1]), (9, near[1])]  # two texts of different groups on one id: 5 stands for the second
    rows += [(7, text[2]), (None, text[2]), (None, text[3]), (None, None), (None, " "), (8, None), (8, ""), (8, "")]  # one row without an id is a copy
    rows += [(None, text[4]), (None, near[4]), (None, near[4]), (11, text[5])]  # a group without any id
    full = [(i, t, "en", "s", f"r{k}", "n") for k, (i, t) in enumerate(rows)]
    groups, want = [], collections.Counter((i, t) for i, t in rows if not shingles(t))
    for i, t in rows:
        if s := shingles(t):
            # all near copies here are copies of one text, so that a group is what is near to its first member
            home = next((g for g in groups if 100 * len(s & shingles(g[0][1])) >= 80 * len(s | shingles(g[0][1]))), None)
            groups.append([(i, t)]) if home is None else home.append((i, t))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want.update(min(g, key=lambda r: (r[0] is None, r[0] or 0, signed(xxh64_intdigest(r[1].encode(), 42)))) for g in groups)
    got = ngram_join.keep_representatives(spark.createDataFrame(full, DOCS).repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == want and len(groups) == 6
    assert len({r["row"] for r in got}) == len(got)
    assert ngram_join.keep_representatives(empty).count() == 0


def test_documents_that_go_are_found_where_they_are(spark, docs):
    """The few rows to drop are sent to the documents: a join by shuffles would write all texts once more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ngram_join.keep_representatives(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_whole_sets_are_neither_kept_nor_doubled(spark, docs, monkeypatch):
    """Large cells are split without a table of whole sets; rows that come twice with one id and text give their node once."""
    from pyspark.sql import functions as F

    twice = docs.union(docs.where("doc_id % 3 = 0")).union(docs.where("doc_id % 3 = 0")).repartition(5)
    sets = ngram_join.stored(ngram_join.document_sets(twice, 5, 80), "sets")
    first = sets.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("rid"))
    once = ngram_join.stored(sets.join(first.select("rid"), "rid"), "once")
    nodes = ngram_join.stored(once.select(F.col("rid").alias("node")), "nodes")
    full = ngram_join._full_sets(nodes, once, twice, ngram_join._repeated(twice), 5).select("node", F.size("hashes").alias("n")).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, once.select("rid", "n_shingles").collect()))
    written, real = [], ngram_join.stored

    def watched(df, label, *done):
        written.append((label, df.columns))
        return real(df, label, *done)

    monkeypatch.setattr(ngram_join, "stored", watched)
    roots = lambda **k: sorted(map(tuple, components(ngram_join.near_duplicate_links(twice, once, **k)).collect()))
    assert roots(cell_shingles=300, window_shingles=100, frequent_from=3) == roots()
    assert "split" in {label for label, _ in written}
    assert [label for label, columns in written if "hashes" in columns] == []


def test_splits_of_large_cells(docs):
    from pyspark.sql import functions as F

    from tapeloom.llm.base import stored

    sets = stored(ngram_join.document_sets(docs, 5, 80), "sets")
    once = sets.where("n_shingles > 0").join(sets.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid"), "rid")
    roots = lambda **k: sorted(map(tuple, components(ngram_join.near_duplicate_links(docs, once, **k)).collect()))
    assert roots() == roots(cell_shingles=200, window_shingles=50, frequent_from=2)


def python_steps_of_a_task(plan):
    """The most Python steps, each with a worker of its own, that one task of a printed plan runs at a time."""
    most, above = 0, []
    for line in plan.splitlines():
        at = re.search(r"[A-Za-z*]|$", line).start()
        while above and above[-1][0] >= at:
            above.pop()
        name = re.sub(r"^\*?\(\d+\) ", "", line[at:])
        here = 0 if re.match(r"(Broadcast)?Exchange", name) else (above[-1][1] if above else 0) + bool(re.match(r"MapIn|FlatMapGroupsIn|ArrowEvalPython|BatchEvalPython", name))
        above.append((at, here))
        most = max(most, here)
    return most


def test_a_task_of_the_join_has_one_python_worker(docs, monkeypatch):
    from pyspark.sql import functions as F

    sets = ngram_join.stored(ngram_join.document_sets(docs, 5, 80), "sets")
    once = ngram_join.stored(sets.join(sets.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid"), "rid"), "once")
    steps, real = {}, ngram_join.stored

    def watched(df, label, *done):
        steps[label] = max(steps.get(label, 0), python_steps_of_a_task(df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label, *done)

    monkeypatch.setattr(ngram_join, "stored", watched)
    ngram_join.near_duplicate_links(docs, once, cell_shingles=200, window_shingles=50, frequent_from=2)
    assert {label: n for label, n in steps.items() if n > 1} == {}
    assert steps["windows"] == steps["links"] == 1


def moves_of_made_sets(plan):
    """The most exchanges of a printed plan that rows pass after a Python step made them."""
    most, above = 0, []
    for line in plan.splitlines():
        at = re.search(r"[A-Za-z*]|$", line).start()
        while above and above[-1][0] >= at:
            above.pop()
        name = re.sub(r"^\*?\(\d+\) ", "", line[at:])
        moves = (above[-1][1] if above else 0) + name.startswith("Exchange")
        above.append((at, moves))
        most = max(most, moves if name.startswith("MapInArrow") else 0)
    return most


def test_large_cells_are_split_without_moving_whole_sets(spark, docs, monkeypatch):
    """Beyond what is broadcast, texts are shuffled once for a step; sets only go to the cells that one task joins."""
    from pyspark.sql import functions as F

    sets = ngram_join.stored(ngram_join.document_sets(docs, 5, 80), "sets")
    once = ngram_join.stored(sets.join(sets.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid"), "rid"), "once")
    roots = lambda **k: sorted(map(tuple, components(ngram_join.near_duplicate_links(docs, once, **k)).collect()))
    want = roots()
    steps, real = {}, ngram_join.stored

    def watched(df, label, *done):
        steps[label] = max(steps.get(label, 0), moves_of_made_sets(df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label, *done)

    monkeypatch.setattr(ngram_join, "stored", watched)
    monkeypatch.setattr(ngram_join, "small_side", lambda df, limit=0: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert roots(cell_shingles=200, window_shingles=50, frequent_from=2) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert steps["split"] == 0 and steps["links"] == 1


@pytest.mark.parametrize("rounds", [0, 4])
def test_pivots_go_to_tasks_in_parts(docs, monkeypatch, rounds):
    """Cells whose pivots find no room wait for the next round, and after the last round each part of the pivots has its turn."""
    from pyspark.sql import functions as F

    sets = ngram_join.stored(ngram_join.document_sets(docs, 5, 80), "sets")
    once = ngram_join.stored(sets.join(sets.where("n_shingles > 0").groupBy("sig").agg(F.min("rid").alias("rid")).select("rid"), "rid"), "once")
    roots = lambda **k: sorted(map(tuple, components(ngram_join.near_duplicate_links(docs, once, **k)).collect()))
    want = roots()
    waited, real = [], ngram_join._split

    def watched(*args):
        parts, left = real(*args)
        waited.append((len(parts), left.count()))
        return parts, left

    monkeypatch.setattr(ngram_join, "_split", watched)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    assert roots(cell_shingles=600, window_shingles=50, frequent_from=2, centre_shingles=130) == want
    assert max(n for n, _ in waited) > 1 if rounds == 0 else max(n for _, n in waited) > 0


def test_what_sets_share_with_pivots():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 50, np.uint64)
    names, sets = np.array([9, 4, 70]), [np.sort(rng.choice(pool, n, replace=False)) for n in (30, 1, 12)]
    cells, pivots = np.array([5, -3, 8, 6]), np.array([4, 70, 9, 70])
    held = ngram_join.Pivots(cells, pivots, names, np.concatenate(sets), np.array([0, 30, 31, 43]))
    at, mine = np.array([8, 7, 6, -3, 5, 99]), [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 5, 50, 20, 9, 3)]
    known, pivot, size, shared = held.common(at, mine)
    assert known.tolist() == [True, False, True, True, True, False]
    assert pivot.tolist() == [9, 70, 70, 4] and size.tolist() == [30, 12, 12, 1]
    theirs = dict(zip(names.tolist(), sets))
    assert [s.tolist() for s in shared] == [sorted({*mine[i].tolist()} & {*theirs[p].tolist()}) for i, p in zip((0, 2, 3, 4), pivot.tolist())]
    none = ngram_join.Pivots(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    assert none.common(at, mine)[0].tolist() == [False] * 6


def test_windows_put_frequent_shingles_last():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 60, np.uint64)
    hot = np.sort(pool[:20].view(np.int64))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 3, 0, 40, 5, 60)]
    got, lens = ngram_join.first_shingles(np.concatenate(sets), np.array([len(s) for s in sets]), hot, 80)
    want = [sorted(map(int, s), key=lambda h: (np.uint64(h) in pool[:20], h))[:len(s) - -(-len(s) * 80 // 100) + 1 if len(s) else 0] for s in sets]
    assert lens.tolist() == [len(w) for w in want]
    assert got.tolist() == sum(want, [])
    for part in (np.zeros(0, np.int64), hot[:1]):  # no frequent shingle, or one
        assert len(ngram_join.first_shingles(np.concatenate(sets), np.array([len(s) for s in sets]), part, 80)[0]) == lens.sum()
    assert ngram_join.first_shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64), hot, 80)[0].tolist() == []


def test_license_phrases(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.license_scan(docs).collect()}
    want = set()
    for i, t, *_ in sample_rows():
        w = license_scan.words_of(t or "")
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j:j + len(p)] == p:
                    places.append(j)
                    labels.add(label)
        want.add((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got == want
    assert license_scan.license_scan(empty).count() == 0


def test_changed_notices_are_found_and_other_texts_are_not(spark):
    rng = np.random.default_rng(4)
    filler = lambda n: " ".join("".join(rng.choice(list("aeiostr"), 5)) for _ in range(n))
    rows, want = [], {}
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            words = license_scan.words_of(t)
            changed = " ".join(w if i % 4 != 3 else f"zz{i}" for i, w in enumerate(words)) if len(words) >= 12 else " ".join(words)
            want[len(rows)] = label
            rows.append((len(rows), f"{filler(30)} {changed} {filler(30)}"))
    clean = ["the use of this software is under the old license of the state", "permission is granted to any person", "in source and binary forms of the work", filler(500)]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i][0] and 0.6 <= got[i][1] <= 1 for i, label in want.items())
    assert all(got[1000 + i] == ({""}, 0.0) for i in range(len(clean)))


def brute_losses(rows, targets):
    """The two mean losses of every row, from counts of words and pairs as text."""
    A, B = lm_score.BACK_OFF, lm_score.FLOOR
    words = [["\0", *(WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or "")))] for _, t, *_ in rows]
    single, pair = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for (i, *_), ws in zip(rows, words):
        for k in (0, 1) if i in targets else (1,):
            single[k].update(ws if len(ws) > 1 else [])
            pair[k].update(zip(ws, ws[1:]))
    sums = [sum(c.values()) - c["\0"] for c in single]
    mass, kinds = min(s for s in sums if s), len(single[1]) - 1
    out = []
    for ws in words:
        loss = [0.0, 0.0]
        for k in (0, 1):
            f = mass / max(sums[k], 1)
            for v, w in zip(ws, ws[1:]):
                p = (f * single[k][w] + B / kinds) / (f * sums[k] + B)
                loss[k] -= np.log((f * pair[k][v, w] + A * p) / (f * single[k][v] + A)) / (len(ws) - 1)
        out.append((len(ws) - 1, *loss))
    return out


@pytest.mark.parametrize("dealt_bytes", [4000, 1 << 23])
def test_losses(docs, spark, empty, dealt_bytes):
    targets = spark.createDataFrame([(0,), (1,), (1,), (None,), (-7,)], "doc_id long")
    got = [tuple(r) for r in lm_score.cross_entropy_difference(docs, targets, dealt_bytes).collect()]
    want = [(i, *b) for (i, *_), b in zip(sample_rows(), brute_losses(sample_rows(), {0, 1}))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], abs=1e-9) and g[4] == pytest.approx(w[3] - w[2], abs=1e-9)
    assert lm_score.cross_entropy_difference(empty, targets, dealt_bytes).count() == 0
    alone = lm_score.cross_entropy_difference(docs, targets.limit(0), dealt_bytes).collect()
    assert len(alone) == len(want) and all(np.isfinite(r["score"]) for r in alone)


def test_mixing(docs, empty):
    got = mixing.replicate(docs, {"s0": 1.0, "s1": 3.0}, epochs=20.0).collect()
    assert {r["row"]["source"] for r in got} == {"s0", "s1"}
    counts = collections.Counter(r["row"]["source"] for r in got)
    sizes = collections.Counter()
    for _, t, _, s, *_ in sample_rows():
        sizes[s] += len(t or "")
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(docs, {"s0": 1.0, "s1": 3.0}, epochs=20.0).collect()}
    for s in ("s0", "s1"):
        n = sum(1 for r in sample_rows() if r[3] == s)
        assert abs(counts[s] - n * rates[s]) < 5 * (n * rates[s]) ** 0.5
        assert rates[s] * sizes[s] == pytest.approx({"s0": 5, "s1": 15}[s] * sum(sizes.values()))
    assert mixing.replicate(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h{i}.org/ä b", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é" * 5000, "x\r\n\r\ny", "é" * 5000])] + [(None, None, "<p>a</p>"), (10**17, "u\nv", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = set()
    for i, _, h in pages:
        h = h or ""
        back = None if first[h] == i else first[h]
        want.add((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if back is None else "revisit", back))
    for k in range(2):
        warc.write_archives(df.repartition(1 + 3 * k), str(tmp_path / f"w{k}"), roll_bytes=300, shard_bytes=4000)
        rows = warc.read_archives(spark, str(tmp_path / f"w{k}"), payload=True).collect()
        assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(pages)
    files = [{p.name: p.read_bytes() for p in (tmp_path / f"w{k}").glob("part-*.gz")} for k in range(2)]
    assert files[0] == files[1] and len(files[0]) > 2
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_fingerprints(docs, empty, spark):
    rows = [r for r in sample_rows() if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    errors = []
    for k, (i, t, *_) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[:len(t) - h] + n[:h]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = collections.Counter(WORDS.findall(t)), collections.Counter(WORDS.findall(edited))
        if a or b:
            errors.append(got[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.15
    assert got[0]["fingerprint"] == got[65]["fingerprint"] == got[66]["fingerprint"]
    assert fingerprints.fingerprint_edits(docs).count() == len(sample_rows())
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_fingerprint_error(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null")
    rows = sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    squares = variance = 0.0
    for (i, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        h = len(t) // 2
        a, b = collections.Counter(WORDS.findall(t)), collections.Counter(WORDS.findall(t[:len(t) - h] + n[:h]))
        if a and b:
            exact = sum((a & b).values()) / sum((a | b).values())
            squares += (got[i]["near_edited"] - exact) ** 2
            variance += exact * (1 - exact)
    assert variance / squares > 32  # as of so many independent samples


def test_following(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ALONE", 5)
    keys = sorted({int(x) for x in np.random.default_rng(1).integers(0, 10**6, 40)} | {10**12})
    got = {tuple(r) for r in fingerprints.following(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    assert got == set(zip(keys, [*keys[1:], None], strict=True))


PAGE = ("<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class='ad'>buy</div>"
        "<article><h1>Head &amp; line</h1><p>One\n  two<br>three<p><b>Bold <i>it</i>alic</b></p><aside>no</aside><div class='comments'><p>troll</p></div></article><footer>end</footer>")


def test_main_text(spark):
    assert html_main.main_text(html_main.parse(PAGE)) == "Head & line\n\nOne two three\n\nBold italic"
    template = "<div><p>Every page of the site says so</p></div>"
    pages = [(i, f"http://site.org/{i}", f"<body>{template}<p>own text {i}</p></body>") for i in range(12)] + [(50, None, None), (51, "", ""), (52, "http://o.org", PAGE), (None, "http://o.org", "<p>x")]
    got = {r["page_id"]: r["text"] for r in html_main.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "own text 3" and got[50] == got[51] == "" and got[52].startswith("Head") and got[None] == "x" and len(got) == 16


def extracted(spark, pages):
    return {r["page_id"]: r["text"] for r in html_main.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_templates_spare_articles(spark):
    menu = "<div><a href=/s>Sport</a> <b>Note</b></div><div><p>All rights reserved</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<body>{menu}<article><p>A <b>Note</b> on <a href=/x>Sport</a> {i}</p><p>All rights reserved</p></article>") for i in range(9)]
    pages += [(9, "http://a.org/9", f"<body>{menu}<p>Own <b>Note</b></p>")]  # no article: the menu goes, inline nodes stay
    pages += [(10 + i, f"http://b.org/{i}", "<body><p>one text</p><p>on six pages</p>") for i in range(6)]  # copies
    pages += [(20 + i, f"http://c.org/{i}", "<body><div class=main><p>one text</p><p>on six pages</p></div>") for i in range(6)]
    pages += [(30 + i, f"http://d.org/{i}", f"<body><p>shared line</p><div class=main><p>shared line</p>{i}</div>") for i in range(6)]
    got = extracted(spark, pages)
    assert all(got[i] == f"A Note on Sport {i}\n\nAll rights reserved" for i in range(9)) and got[9] == "Own Note"
    assert {got[i] for i in (*range(10, 16), *range(20, 26))} == {"one text\n\non six pages"}
    assert all(got[30 + i] == f"shared line\n\n{i}" for i in range(6))


def test_templates_inside_articles(spark):
    block = "<div class=box><p>Get our letter</p></div>"
    own = lambda i: "<ul><li>seen on few pages</li></ul>" if i < 5 else ""
    pages = [(i, f"http://a.org/{i}", f"<body><article><p>Own {i}</p><p>Said often</p>{block}{own(i)}</article>") for i in range(12)]
    pages += [(20 + i, f"http://b.org/{i}", f"<body><nav>{i}</nav><article><p>Copy</p>{block}</article>") for i in range(9)]  # copies of one article
    pages += [(40 + i, f"http://c.org/{i}", f"<body><div class=main><p>Own {i}</p>{block}</div>") for i in range(6)]
    got = extracted(spark, pages)
    assert all(got[i] == f"Own {i}\n\nSaid often" + ("\n\nseen on few pages" if i < 5 else "") for i in range(12))
    assert {got[20 + i] for i in range(9)} == {"Copy\n\nGet our letter"}
    assert all(got[40 + i] == f"Own {i}" for i in range(6))


def naive_tree(page):
    """The element tree with a look at every open element, one by one."""
    root = html_main.Node("")
    nodes, at = [root], 0
    for start, end, token in html_main._tokens(page):
        if start < at:
            continue
        if start > at:
            nodes[-1].parts.append(page[at:start])
        at = end
        if token[1] in "!?":
            continue
        tag = html_main._NAME.match(token)[1].lower()
        if token[1] == "/":
            for i in range(len(nodes) - 1, 0, -1):
                if nodes[i].tag == tag:
                    del nodes[i:]
                    break
            continue
        for i in range(len(nodes) - 1, 0, -1):
            if tag in html_main._ENDS.get(nodes[i].tag, ()):
                del nodes[i:]
                break
            if nodes[i].tag in html_main._FENCE:
                break
        nodes[-1].parts.append(html_main.Node(tag))
        if tag not in html_main.VOID:
            nodes.append(nodes[-1].parts[-1])
    if at < len(page):
        nodes[-1].parts.append(page[at:])
    return root


def shape(part):
    return part if isinstance(part, str) else (part.tag, [shape(p) for p in part.parts])


def test_parser_against_a_look_at_every_open_element():
    rng = np.random.default_rng(2)
    bits = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<div>", "</div>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<dt>", "<dd>", "<dl>", "</dl>",
            "<article>", "</article>", "x", "y <", "&amp;", "<!-- c -->", "<br>", "<th>", "<a href='q>'>", "</a>", "<h1>", "</i>", "<!-"]
    for _ in range(5000):
        page = "".join(rng.choice(bits, rng.integers(0, 25)))
        assert shape(html_main.parse(page)) == shape(naive_tree(page))


@pytest.mark.parametrize("page", ["<div class=ad>" * 40_000, "<article>x" * 40_000, "<b>" * 40_000 + "<p>x</p>" * 40_000, "<p>" + "</b>" * 100_000, "<a " * 200_000, "<a \"x>\"" * 50_000,
                                  "<li>" * 50_000, "<table><tr><td>" * 20_000, "<script>" * 100_000, "<" * 400_000, "<!-" * 100_000])
def test_deep_and_broken_pages_take_one_walk(page):
    import time

    start = time.process_time()
    root = html_main.parse(page)
    html_main.subtree_codes(root)
    html_main.content_key(root)
    html_main.main_text(root, {1} | {n.code for n in html_main._outside(root) if n.code}, {1})
    assert list(html_main._inside(root)) is not None and time.process_time() - start < 20


def test_names_are_whole_and_pages_with_text_are_not_empty():
    text = lambda page: html_main.main_text(html_main.parse(page))
    assert text('<body><div class="layout has-sidebar"><p>real text here</p></div></body>') == "real text here"
    assert text('<article><div class="article-header"><h1>Head</h1></div><p class="share-price">Price rose</p><div class="site-footer x">no</div></article>') == "Head\n\nPrice rose"
    assert text("<body><div id='header'><p>all there is</p><form>no</form></div></body>") == "all there is"
    assert text("<body><p>text</p><div class=\"Comments big\">no</div><div class=ad>no</div></body>") == "text"


def test_ids_of_all_plain_characters_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    rng = np.random.default_rng(5)
    # all letters of the range, also those whose small letter lies beyond it
    every = [chr(c) for c in range(0x20, 0x250) if chr(c).isprintable()]
    texts = ["Əli", "BAƊA", "ƐYƐ", "İstanbul", "ſ's It'S", *every, *("".join(rng.choice(every, rng.integers(1, 12))) for _ in range(4000)),
             *("".join(rng.choice(list("aÉ1²'sST \t\n.,!<|>"), rng.integers(1, 16))) for _ in range(2000))]
    got = ids.encode(texts)
    for t, data in zip(texts, got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(docs, tokenizer_path(), 64).collect()
    want, total = collections.Counter(), 0
    for i, text, *_ in sample_rows():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want.update((i, a // 64, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for a in range(0, len(ids), 64))
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= 64
    assert len(bins) <= -(-total // 64) + 3
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 4, 2])
    start = [[0, 3], [1, 2], [4, 5], [6]]
    out = packing.local_search([list(b) for b in start], lengths, 10)
    assert sorted(sum(out, [])) == list(range(7)) and all(lengths[b].sum() <= 10 for b in out) and len(out) == 3


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(5)
    good, bad = ["river", "stone", "cloud", "light"], ["$$$win", "!!free", "***xx"]
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, 30)), "en", "s", "r", "n") for i in range(300)]
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality_model.score_quality(df, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 30
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert quality_model.score_quality(docs, labels).count() == len(sample_rows())
    assert quality_model.score_quality(empty, labels.limit(0)).count() == 0
    assert quality_model.keep_quality(docs, labels).columns == docs.columns


def test_rules(docs, empty):
    got = sorted((tuple(r)[:7] for r in quality_rules.rule_verdicts(docs).collect()), key=str)
    want = []
    for i, t, *_ in sample_rows():
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        count = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        cover = {x for j in range(len(w) - 4) if count[tuple(w[j:j + 5])] > 1 for x in range(j, j + 5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert got == sorted(want, key=str)
    assert quality_rules.rule_verdicts(empty).count() == 0
    assert quality_rules.keep_by_rules(docs).columns == docs.columns


def brute_distances(texts):
    """Squared distances by a minimum covariance determinant fit of one group, none of whose texts fails the base rules."""
    G, rows = quality_rules.GRID, []
    for t in texts:
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        n, symbols = len(w) + 20, len(re.findall(r"[#*$%&|<>]", t))
        rows.append([np.log((sum(map(len, w)) + 110) / n), np.arcsinh(10 * symbols / n), np.arcsinh(20 * (len(lines) - len(set(lines))) / n), 0.0, np.log((len(set(w)) + 20) / np.sqrt(n * 20))])
    x, floors = np.floor(np.array(rows) * G + 0.5) / G, np.diag(np.square(quality_rules.FLOORS))
    lowest = lambda v, share: np.sort(v, axis=0)[int(np.ceil(share * len(v))) - 1]
    centre = lowest(x, 0.5)
    scatter = np.diag((1.4826 * lowest(np.abs(x - centre), 0.5)) ** 2) + floors
    distance = lambda: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
    for share in (0.5, 0.5, 0.5, 0.75):
        level = np.floor(np.log(distance() + 1e-6) * 64 + 0.5)
        near = x[level <= lowest(level, share)]
        centre, scatter = near.mean(0), np.cov(near.T, bias=True) + floors
    return distance()


def test_outliers(spark):
    rng = np.random.default_rng(12)
    word = lambda least, most: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(least, most)))
    clean = [" ".join(word(2, 8) for _ in range(rng.integers(60, 200))) for _ in range(300)]
    clean[5] += " &"  # one symbol, one repeated line
    clean[6] += "\nthe end\nthe end"
    odd = [" ".join(word(4, 16) for _ in range(600)), " ".join([word(2, 8) for _ in range(70)]) + " **********"]
    rows = [(i, t, "en", "s", "r", "n") for i, t in enumerate(clean + odd)]
    got = sorted(quality_rules.rule_verdicts(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: r["doc_id"])
    want = brute_distances(clean + odd)
    assert not any(r["base_failed"] for r in got) and [r["distance"] for r in got] == pytest.approx(want, rel=1e-6)
    # 99.9 % of chi-squared with 5 degrees, 0.75 / P(chi-squared of 7 degrees <= 6.6257)
    assert quality_rules.CUTOFF == pytest.approx(20.515 * 0.75 / 0.53118, rel=1e-3)
    assert [r["kept"] for r in got] == (want <= quality_rules.CUTOFF).tolist() == [True] * 300 + [False] * 2


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    full = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = full, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == full.columns
        seen.append(docs.count())
    assert full.count() > seen[0] > seen[1] > seen[2] > 0
    assert corpus_pipeline.run(spark, sf).count() >= seen[3]


def test_a_verdict_belongs_to_its_source(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), n)) for _ in range(100))
    shared = words(4)
    rows = [(i, words(4 if s == "a" else 12), s, s) for s in "ab" for i in range(1000 if s == "a" else 2000, 1250 if s == "a" else 2250)]
    rows += [(5, shared, "a", "a"), (5, shared, "b", "b"), (6, shared, None, "a"), (6, shared, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {(r["doc_id"], r["lang"], r["source"]) for r in quality_rules.keep_by_rules(df).where("doc_id < 10").collect()}
    assert (5, "a", "a") in kept and (5, "b", "b") not in kept
    verdicts = {(r["doc_id"], r["kept"]) for r in quality_rules.rule_verdicts(df).where("doc_id = 5").collect()}
    assert verdicts == {(5, True), (5, False)}


def test_features_are_words_and_character_ngrams():
    from tapeloom.llm.words import joined, mix, separators, word_hashes, SPACE

    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aé中😀 \t\n\x85"), rng.integers(0, 25))) for _ in range(200)] + [None, "", "a", "  ", "é" * 3]
    buckets, owner = quality_model.features(texts)
    got = [sorted(buckets[owner == i].tolist()) for i in range(len(texts))]
    mask = (1 << 64) - 1

    def bucket(h):
        return int(mix(np.array([h & mask], np.uint64))[0]) >> (64 - quality_model.BITS)

    for i, t in enumerate(texts):
        t, want = t or "", []
        for w in WORDS.findall(t):
            h, _ = word_hashes(*joined([w.encode()], lower=False), separators(SPACE))
            want.append(int(h[0]) >> (64 - quality_model.BITS))
        around = " ".join(texts[j] or "" for j in range(len(texts))) + " "
        at = sum(len(x or "") + 1 for x in texts[:i])
        for n in quality_model.NGRAMS:
            for j in range(at, at + len(t) + 1):
                g = around[j:j + n]
                if len(g) == n and not any(WORDS.fullmatch(c) is None for c in g[1:-1]) and not (WORDS.fullmatch(g[0]) is None and WORDS.fullmatch(g[-1]) is None):
                    h = 0
                    for c in g:
                        h = (h * int(quality_model._POINTS) + (32 if WORDS.fullmatch(c) is None else ord(c))) & mask
                    want.append(bucket(h + n))
        assert got[i] == sorted(want)


def test_a_repeated_id_is_learned_from_once(spark):
    docs = [(1, f"bad words {i}", "x") for i in range(400)] + [(2, "good words", "x"), (3, "more good words", "x")]
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    keep = {r["doc_id"]: r["score"] for r in quality_model.score_quality(df, labels).collect()}
    one = quality_model.learn(df.where("doc_id > 1").union(df.where("doc_id = 1").orderBy(F_hash()).limit(1)), labels)
    all_rows = quality_model.learn(df, labels)
    assert (one[0] == all_rows[0]).all() and one[1] == all_rows[1] and len(keep) == 3


def F_hash():
    from pyspark.sql import functions as F

    return F.xxhash64("text")
