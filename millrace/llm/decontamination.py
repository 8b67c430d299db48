"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over consecutive token positions; its hash uses the positions marked 1 and ignores the others, so
a word put in place of another at an ignored position leaves the hash as it is. Hashes of all masks over the benchmark
items are joined with those over the documents; around each hit the item is laid over the document and compared token by
token, and the segment that scores best (1 a match, -3 a difference) is the overlap. If that has too few equal tokens, the
segment with the most equal tokens of those with three matches in four at least is.
A document is contaminated by an item if an overlap has MATCHES equal tokens, or MATCH_SHARE of the tokens of a shorter item.

Tokens are runs of letters and digits, lower case; punctuation and white space part them.

The benchmark's hashes go to every task. Their size is bounded: a benchmark of more than CHUNK_TOKENS tokens is taken in
chunks below that bound, one pass over the documents for each, whose overlaps are written before the next: benchmarks are
small beside a corpus.

Defined cases: null and empty texts have no tokens, so they are never contaminated and contaminate nothing; items of fewer
than LEAST_TOKENS tokens are left out, as chance brings them; rows with a null item_id count as an item without a name;
items that repeat give a row each; documents that repeat give a row each; empty tables give an empty result; further
columns are ignored by overlaps and kept by clean, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._arrow import mix, runs, slices, span_hashes, utf8
from ._store import saved, small_side

#: MASKS are for every item, SHORT_MASKS for those of SHORT_TOKENS at most, LEAST_MASKS for those of LEAST_TOKENS. Together they hit every
#: placing of one to three substitutions in an item of 5 to 20 tokens that leaves an overlap, and of four in one of 16.
MASKS = ("111111", "11101101", "1111011", "110100100111")
SHORT_MASKS = ("110100011", "11111", "110111", "101111", "111011", "111101")
SHORT_TOKENS = 20
LEAST_MASKS = ("1111", "11011", "10111", "11101")
MATCHES = 12
MATCH_SHARE = 0.8
LEAST_TOKENS = 5
CHUNK_TOKENS = 1_000_000
FILTER_BITS = 22
#: Pairs of places and positions of a seed above which a bitmap takes their place.
OFTEN = 10_000
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a large_string column, and the offsets of its texts in them."""
    raw, off = utf8(pc.utf8_lower(column))
    gap = ~_WORD[raw]
    for lead, tail, size in ((0xC2, None, 2), (0xE2, 0x80, 3)):  # signs of Latin-1, and general punctuation
        at = np.flatnonzero(raw == lead)
        if tail is not None:
            at = at[raw[np.minimum(at + 1, len(raw) - 1)] == tail]
        for k in range(size):
            gap[np.minimum(at + k, len(raw) - 1)] = True
    start, end, doc = runs(raw, off, gap)
    return span_hashes(raw, start, end), np.searchsorted(doc, np.arange(len(column) + 1))


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The mask's hash at each position at which it fits, texts not told apart."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(0, n), np.uint64(salt + 1))
    for k, one in enumerate(mask):
        if one == "1" and n > 0:
            out += hashes[k : k + n] * _FACTORS[k]
    return mix(out)


def _overlap(same: np.ndarray, least: int) -> tuple[int, int]:
    """Start and stop of the segment that scores best, or if fewer than `least` are equal in it, of the one with the most equal tokens of those with three in four at least."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -3))))
    gain = total - np.minimum.accumulate(total)
    stop = len(gain) - 1 - int(gain[::-1].argmax())
    start = int(total[: stop + 1].argmin())
    if int(same[start:stop].sum()) < least:
        # the last stop at which the total is no less than at the start
        ahead = np.maximum.accumulate(total[::-1])[::-1]
        last = np.searchsorted(-ahead, -total, side="right") - 1
        equal = np.concatenate(([0], np.cumsum(same)))
        start = int((equal[last] - equal).argmax())
        stop = int(last[start])
        own = np.flatnonzero(same[start:stop])
        if len(own):
            start, stop = start + int(own[0]), start + int(own[-1]) + 1
    return start, stop


class Index:
    """Benchmark items by the hashes of every mask: sorted hashes with item and position, and a bitmap to pass most misses by."""

    def __init__(self, item_ids: list, column: pa.Array):
        self.item_ids = item_ids
        self.tokens, self.off = tokens(column)
        size = np.diff(self.off)
        kinds = [(m, LEAST_TOKENS, None) for m in MASKS] + [(m, LEAST_TOKENS, SHORT_TOKENS) for m in SHORT_MASKS] + [(m, LEAST_TOKENS, LEAST_TOKENS) for m in LEAST_MASKS]
        able = [(size >= least) & (size <= most) if most else size >= least for _, least, most in kinds]
        self.masks = [(salt, mask) for salt, (mask, _, most) in enumerate(kinds) if not most or able[salt].any()]
        found = []
        for salt, mask in self.masks:
            h = seeds(self.tokens, mask, salt)
            item = np.searchsorted(self.off, np.arange(len(h)), side="right") - 1
            fits = (np.arange(len(h)) + len(mask) <= self.off[item + 1]) & able[salt][item]
            found.append((h[fits], item[fits], (np.arange(len(h)) - self.off[item])[fits]))
        h, self.item, self.at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], self.item[order], self.at[order]
        self.bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.bits[(self.h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _diagonals(self, place: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Arrays of text, item and shift of the hits of a mask: places in texts with their ranges in the index.

        Where a text and an item both repeat a seed often, the shifts come from its places as a bitmap, moved by each position
        in the item, instead of from all pairs of places and positions.
        """
        order = np.lexsort((place, low, text))
        place, text, low, high = place[order], text[order], low[order], high[order]
        heads = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (low[1:] != low[:-1])))) if len(place) else np.zeros(0, np.int64)
        count = np.diff(np.append(heads, len(place)))
        often = count * (high - low)[heads] > OFTEN
        out = []
        for g in np.flatnonzero(often).tolist():
            own = place[heads[g] : heads[g] + count[g]]
            bits = np.zeros(int(own[-1] - own[0]) + 1, dtype=bool)
            bits[own - own[0]] = True
            hits = np.arange(low[heads[g]], high[heads[g]])
            for item in np.unique(self.item[hits]).tolist():
                at = self.at[hits[self.item[hits] == item]]
                moved = np.zeros(len(bits) + int(at.max() - at.min()), dtype=bool)
                for k in (int(at.max()) - at).tolist():
                    moved[k : k + len(bits)] |= bits
                shift = np.flatnonzero(moved) + own[0] - at.max()
                out.append(np.stack([np.full(len(shift), text[heads[g]]), np.full(len(shift), item), shift]))
        few = np.repeat(~often, count)
        place, text, low, n = place[few], text[few], low[few], (high - low)[few]
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(np.stack([np.repeat(text, n), self.item[hit], np.repeat(place, n) - self.at[hit]]))
        return out

    def overlaps(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Text, item, start in the text and in the item, length and equal tokens of the best overlap of each pair that has one."""
        words, off = tokens(column)
        found = []
        for salt, mask in self.masks:
            h = seeds(words, mask, salt)
            at = np.flatnonzero(self.bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if len(at):
                low, high = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], side="right")
                hit = high > low
                found += self._diagonals(at[hit], np.searchsorted(off, at[hit], side="right") - 1, low[hit], high[hit])
        if not found:
            return
        pairs = np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()
        best: dict[tuple[int, int], tuple] = {}
        for t, i, s in pairs:
            own = self.tokens[self.off[i] : self.off[i + 1]]
            a, b = max(s, off[t]), min(s + len(own), off[t + 1])
            if b <= a:
                continue
            least, old = min(MATCHES, int(np.ceil(MATCH_SHARE * len(own)))), best[t, i][-1] if (t, i) in best else 0
            if b - a <= old:
                continue
            same = words[a:b] == own[a - s : b - s]
            if int(same.sum()) < max(least, old + 1):
                continue
            start, stop = _overlap(same, least)
            matched = int(same[start:stop].sum())
            if matched >= least and matched > old:
                best[t, i] = (int(a - off[t]) + start, int(a - s) + start, stop - start, matched)
        for (t, i), found in best.items():
            yield t, i, *found


_SCHEMA = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, length bigint, matched bigint"


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            ids = piece.column(0)
            found = [(ids[t].as_py(), index.value.item_ids[i], *rest) for t, i, *rest in index.value.overlaps(piece.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def _chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    """The items in chunks of CHUNK_TOKENS tokens at most (a longer item is a chunk of its own), fetched partition by partition."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        n = len(row.t or "") // 2 + 1  # tokens at most
        if ids and size + n > CHUNK_TOKENS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t or "")
        size += n
    if ids:
        yield ids, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, doc_start, item_start, length, matched (in tokens)."""
    spark, rows, out = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), None
    last = None  # the chunk that is not written yet: its broadcast, and the overlaps with it
    for ids, texts in _chunks(benchmark, item_id, item_text):
        index = Index(ids, pa.array(texts, pa.large_string()))
        if len(index.h):
            if last:  # of several chunks one at a time is in memory
                found = saved(last[1], "overlaps")
                last[0].destroy()
                out = found if out is None else out.unionByName(found)
            shared = spark.sparkContext.broadcast(index)
            last = shared, rows.mapInArrow(_finder(shared), _SCHEMA)
    if not last:
        return spark.createDataFrame([], _SCHEMA)
    return last[1] if out is None else out.unionByName(last[1])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without an overlap with any item, with all their columns."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.xxhash64(text, id_col).alias("_c"))
    found = saved(overlaps(keyed, benchmark, "_c", "_text", **settings).select(F.col("doc_id").alias("_c")).distinct(), "contaminated")
    return keyed.join(small_side(found), "_c", "left_anti").select("_row.*")
