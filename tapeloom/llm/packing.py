"""Packing of token sequences: best fit, then swaps between underfull bins.

Documents are cut into pieces of at most ``room`` tokens. The lengths of all pieces, without their tokens, are dealt by a
hash to blocks of some thousand pieces, and every block is packed by one task: best fit in decreasing order, then local
search. The search moves a piece from one underfull bin to another, or exchanges one for one or two for one, whenever
that raises the sum of squared fills, so that bins empty; it ends at the lower bound, when no change is left, or after some
rounds, each of which looks at a bounded number of the emptiest bins. A block wastes less than a bin by its border.

Null texts are empty: their one piece holds the end mark alone. Each row is packed, repeated rows too; null ids as well.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import mapped, stored

ROOM = 2048
#: Pieces to a block, on average.
BLOCK = 8192
#: Words, and runs between spaces, whose ids a task keeps at a time.
KEPT = 600_000
#: Texts of these characters are cut at spaces first, which is known to give the same ids; others go to the tokenizer whole. A capital whose
#: small letter lies beyond the range (Ɓ, Ə, ...) is none of them, as words are cut in lower case.
_RANGE = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-ɏ]*")
PLAIN = "".join(c for c in map(chr, range(0x250)) if _RANGE.fullmatch(c) and _RANGE.fullmatch(c.lower()))
_PLAIN = re.compile(f"[{re.escape(PLAIN)}]*")
# fixed values: how the word vocabulary of the public tokenizers cuts a text of these characters, in lower case
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼-¾]+")


class WordIds:
    """Ids of texts through the ids of what stands between spaces, each encoded once, word by word."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.words_only = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words that are cut and in lower case already
        self.words_only.normalizer = normalizers.Sequence([])
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kept, self.known, self.words = kept, {}, {}

    def _learn(self, words: list[str]) -> None:
        found = self.words_only.encode(" ".join(words), add_special_tokens=False)
        cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1)).tolist()
        data = np.array(found.ids, "<u4").tobytes()
        for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self.words[w] = data[4 * a:4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers."""
        if len(self.known) > self.kept or len(self.words) > self.kept:
            self.known.clear()
            self.words.clear()
        known, out, open_texts, new = self.known, [], [], {}
        for t in texts:
            if not _PLAIN.fullmatch(t) or "<|" in t:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            runs = t.lower().split()
            parts = list(map(known.get, runs))  # one look-up for each run: the dictionary is too large for the processor's cache
            if None in parts:
                missing = [i for i, p in enumerate(parts) if p is None]
                new.update((runs[i], None) for i in missing)
                open_texts.append((len(out), runs, parts, missing))
                out.append(b"")
            else:
                out.append(b"".join(parts))
        cut = [_WORD.findall(run) for run in new]
        words = sorted({w for ws in cut for w in ws if w not in self.words})
        for i in range(0, len(words), 200):
            self._learn(words[i:i + 200])
        get = self.words.__getitem__
        for run, ws in zip(new, cut, strict=True):
            new[run] = b"".join(map(get, ws))
        known.update(new)
        for at, runs, parts, missing in open_texts:
            for i in missing:
                parts[i] = new[runs[i]]
            out[at] = b"".join(parts)
        return out


def pieces(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for all pieces of every row."""
    end = np.array([end_id], "<u4").tobytes()
    state: dict = {}

    def kernel(batch):
        if "ids" not in state:
            state["ids"] = WordIds(tokenizer_path)
        out, at = [], []
        for i, data in enumerate(state["ids"].encode([t or "" for t in batch.column(1).to_pylist()])):
            data += end
            for piece, start in enumerate(range(0, len(data), 4 * room)):
                part = data[start:start + 4 * room]
                at.append(i)
                out.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                                         ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0  # bit g is set if a bin has g tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = gaps >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            b, gap = len(bins), room
            bins.append([i])
        left = gap - n
        if left:
            by_gap.setdefault(left, []).append(b)
            gaps |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, room: int, rounds: int = 8) -> list[list[int]]:
    """Empty bins by moves and swaps, each of which raises the sum of squared fills.

    The emptiest bin gives: a piece moves to a bin whose gap it fills best, or it is exchanged for one shorter piece, or for two,
    of a bin whose gap takes the difference. All gains are checked on the two bins, so that the sum can only rise.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-int(lengths.sum()) // room)
    for _ in range(rounds):
        changed = False
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < room), key=lambda b: fill[b])
        alive = sum(f > 0 for f in fill)
        if alive <= least:
            break
        order = sorted((room - fill[b], b) for b in open_bins)
        for giver in open_bins[:max(1, 4 * (alive - least))]:
            for i in sorted(bins[giver], key=lambda i: -lengths[i]):
                n = int(lengths[i])
                # moves: the smallest gap that takes the piece
                at = bisect.bisect_left(order, (n, -1))
                target = next((b for g, b in order[at:at + 4] if b != giver and room - fill[b] >= n and fill[b] + n > fill[giver]), None)
                if target is not None:
                    bins[giver].remove(i)
                    bins[target].append(i)
                    fill[giver] -= n
                    fill[target] += n
                    changed = True
                    continue
                # swaps: of the bins with a gap, the exchange that leaves the smallest
                best = None
                for g, b in order[::-1][:64]:
                    gap = room - fill[b]
                    if b == giver or not 0 < gap < n:
                        continue
                    sizes = sorted((int(lengths[j]), j) for j in bins[b])
                    k = bisect.bisect_left(sizes, (n - gap, -1))
                    if k < len(sizes) and sizes[k][0] < n:
                        left = gap - (n - sizes[k][0])
                        if best is None or left < best[0]:
                            best = (left, b, [sizes[k][1]])
                    for x in range(len(sizes)):
                        y = bisect.bisect_left(sizes, (n - gap - sizes[x][0], -1), x + 1)
                        if y < len(sizes) and sizes[x][0] + sizes[y][0] < n:
                            left = gap - (n - sizes[x][0] - sizes[y][0])
                            if best is None or left < best[0]:
                                best = (left, b, [sizes[x][1], sizes[y][1]])
                    if best and best[0] == 0:
                        break
                sent = int(sum(lengths[j] for j in best[2])) if best else 0
                if best and fill[best[1]] + n - sent > fill[giver]:
                    _, b, back = best
                    bins[giver] = [j for j in bins[giver] if j != i] + back
                    bins[b] = [j for j in bins[b] if j not in back] + [i]
                    fill[giver] += sent - n
                    fill[b] += n - sent
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack(cut: DataFrame, room: int = ROOM, block: int = BLOCK) -> DataFrame:
    """Add sequence_id and offset to the rows of ``cut`` (doc_id, piece, length, ...)."""
    blocks = max(1, -(-cut.count() // block))
    spread = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)))

    def run(rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s, items in enumerate(local_search(best_fit(lengths, room), lengths, room)):
            sequence[items] = (rows["block"][0].as_py() << 24) | s
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return rows.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return spread.groupBy("block").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = ROOM) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer_path, room), "pieces"), room)
