"""Line dedup by a deletion-neighbourhood join.

Lines are compared by their words (lower case; runs of white space part them). Equal lines are copies. Lines of LEAST_WORDS
words or more (a parameter) are also copies if they are one edit apart: one word put in place of another, added or left out.
The edit bound is thus an eighth of a line at most: in shorter ones a word makes another statement of them. Each line
emits, as hashed keys, itself and every line that leaving out one of its words gives; lines that share a key are joined, the
edit distance is verified on the words, and of a line and its earlier copies the earliest stays. Earlier means a smaller
document id, then a smaller line number.

Sharing a key is not enough for one edit: two lines that leave out different words may be two edits apart. A substitution
leaves out the same position on both sides; an added word makes one line itself a key of the other. So the earliest line
is taken for each key and position, and for each line as a whole, and no pairs within a group of lines are formed.

A line's partner has the first or the second half of its words in common with it, counted from that end. Lines without
such a partner can't have one at all and emit no keys.

Defined cases: null and empty texts have no lines; lines without words are neither counted nor removed; a null id comes
before all others; rows that repeat are copies of each other; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrow import is_space, lower_ascii, mix, runs, slices, span_hashes, utf8
from ._store import saved, small_side

LEAST_WORDS = 8
_BASE = np.uint64(0xB5026F5AA96619E9)
_INVERSE = np.uint64(pow(0xB5026F5AA96619E9, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base))))


class Lines:
    """The lines of a column of texts that have words: text and number of each, and the hashes of their words."""

    def __init__(self, column: pa.Array):
        raw, off = utf8(column)
        raw = lower_ascii(raw)
        start, end, text = runs(raw, off, is_space(raw))
        self.words = span_hashes(raw, start, end)
        breaks = np.concatenate(([0], np.cumsum(raw == 0x0A)))
        number = breaks[start] - breaks[off[text]] if len(start) else np.zeros(0, np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        heads = np.flatnonzero(new)
        self.text, self.number, self.first = text[heads], number[heads], np.append(heads, len(start))
        self.n = np.diff(self.first)
        # prefix sums of word * base^position: the hash of any run of words, whatever its place
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(self.words * _powers(_BASE, len(self.words))[:-1])))
        self.down = _powers(_INVERSE, len(self.words))

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unmixed hashes of the words a to b."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def hashes(self) -> np.ndarray:
        return mix(self.spans(self.first[:-1], self.first[1:]) + self.n.astype(np.uint64))

    def halves(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Four keys of each line of least words or more, and which line: its first and its last half, for its own length and for one less."""
        keys, own = [], []
        for less in (0, 1):
            length = self.n - less
            half, at = length // 2, np.flatnonzero(self.n >= least)
            a, b = self.first[:-1][at], self.first[1:][at]
            tag = length[at].astype(np.uint64) * np.uint64(2)
            keys += [mix(self.spans(a, a + half[at]) ^ mix(tag)), mix(self.spans(b - half[at], b) ^ mix(tag + np.uint64(1)))]
            own += [at, at]
        return np.concatenate(keys), np.concatenate(own)

    def deletions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each line without one word, as a line of its own; which line; the word's position."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        word = np.arange(len(self.words))
        a, b = self.first[line], self.first[line + 1]
        up = _powers(_BASE, int(self.n.max()) if len(self.n) else 0)
        tail = self.spans(word + 1, b) * up[word - a]
        return mix(self.spans(a, word) + tail + (self.n[line] - 1).astype(np.uint64)), line, word - a


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            lines = Lines(piece.column(1))
            keys, own = lines.halves(least)
            order = np.argsort(own, kind="stable")
            halves = pa.ListArray.from_arrays(pa.array(np.searchsorted(own[order], np.arange(len(lines.n) + 1)), pa.int32()), pa.array(keys[order].view(np.int64)))
            yield _batch(id=piece.column(0).take(pa.array(lines.text)), line=lines.number, h=lines.hashes().view(np.int64), n=lines.n, halves=halves)

    return run


def _words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            lines = Lines(piece.column(1))
            own = np.flatnonzero(lines.n >= least)
            at = np.repeat(lines.first[own], lines.n[own]) + np.arange(int(lines.n[own].sum())) - np.repeat(np.cumsum(lines.n[own]) - lines.n[own], lines.n[own])
            ends = np.concatenate(([0], np.cumsum(lines.n[own])))
            yield _batch(h=lines.hashes()[own].view(np.int64), words=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines.words[at].view(np.int64))))

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of key, position (-1 for the line itself) and the line, from rows of a line and its words."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            lists = part.column(1)
            ends = lists.offsets.to_numpy()
            lines = Lines.__new__(Lines)
            lines.words = lists.flatten().to_numpy().view(np.uint64)
            lines.first = (ends - ends[0]).astype(np.int64)
            lines.n = np.diff(lines.first)
            lines.sums = np.concatenate(([np.uint64(0)], np.cumsum(lines.words * _powers(_BASE, len(lines.words))[:-1])))
            lines.down = _powers(_INVERSE, len(lines.words))
            key, own, at = lines.deletions()
            own = np.concatenate([own, np.arange(len(lines.n))])
            yield _batch(key=np.concatenate([key, lines.hashes()]).view(np.int64), at=pa.array(np.concatenate([at, np.full(len(lines.n), -1)]), pa.int32()), h=part.column(0).take(pa.array(own)), first=part.column(2).take(pa.array(own)))


def _agreeing(x: np.ndarray, y: np.ndarray, x0: np.ndarray, y0: np.ndarray, m: np.ndarray, step: int) -> np.ndarray:
    """How many of the m words from x0 in x and y0 in y on, forwards or backwards, are equal before the first that differ."""
    out, some = m.copy(), np.flatnonzero(m)
    size = m[some]
    ends = np.cumsum(size)
    row = np.repeat(some, size)
    k = np.arange(len(row)) - np.repeat(ends - size, size)
    equal = x[x0[row] + step * k] == y[y0[row] + step * k]
    if len(some):
        out[some] = np.minimum.reduceat(np.where(equal, m[row], k), ends - size)
    return out


def one_edit(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the lists of a row in a and b are equal or one substitution, insertion or deletion apart: but for one word, the longer is their common head and tail."""
    (x, i), (y, j) = ((c.flatten().to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (a, b))
    i, j = i - i[0], j - j[0]
    n, o = np.diff(i), np.diff(j)
    m = np.minimum(n, o)
    head = _agreeing(x, y, i[:-1], j[:-1], m, 1)
    tail = _agreeing(x, y, i[1:] - 1, j[1:] - 1, m, -1)
    return (abs(n - o) <= 1) & (head + tail >= np.maximum(n, o) - 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(one_edit(batch.column("words"), batch.column("words2")))).select(["h", "partner"])


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled: it grows with the lines, so it is not to be broadcast even where it is small."""
    return df.hint("merge")


def copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each line that an earlier one is a copy of: doc_id, line_no (from 0), first_doc_id, first_line_no (the earliest copy), edits (0 or 1).

    Lines of fewer than least_words words (2 at least) are copies only of equal ones.
    """
    if least_words < 2:
        raise ValueError(f"least_words: {least_words}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    lines = saved(rows.mapInArrow(_scan(least_words), "id bigint, line bigint, h bigint, n bigint, halves array<bigint>"), "lines")
    place = F.struct("id", "line")
    unique = saved(lines.groupBy("h", "n").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("halves").alias("halves")), "unique-lines")

    half = unique.where(f"n >= {least_words}").select("h", F.explode("halves").alias("half"))
    common = half.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("half")
    partners = half.join(_shuffled(saved(common, "common-halves")), "half", "left_semi").select("h").distinct()
    able = saved(unique.select("h", "first").join(_shuffled(saved(partners, "partners")), "h", "left_semi"), "lines-with-partners")
    owners = small_side(saved(able.select(F.col("first.id").alias("id")).distinct(), "owners"))
    texts = rows.join(owners.withColumnRenamed("id", "owner"), F.col("id").eqNullSafe(F.col("owner")), "left_semi")
    worded = texts.mapInArrow(_words(least_words), "h bigint, words array<bigint>").join(small_side(able), "h").groupBy("h").agg(F.any_value("words").alias("words"), F.min("first").alias("first"))
    worded = saved(worded, "worded-lines")

    keys = saved(worded.select("h", "words", "first").mapInArrow(_keys, "key bigint, at int, h bigint, first struct<id:bigint,line:bigint>"), "deletion-keys")
    who = F.struct("first", "h")
    whole, partial = F.when(F.col("at") < 0, who), F.when(F.col("at") >= 0, who)
    by_key = saved(keys.groupBy("key").agg(F.min(whole).alias("whole"), F.min(partial).alias("part"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-keys")
    shared = keys.join(_shuffled(by_key), "key")
    by_place = saved(shared.where("at >= 0").groupBy("key", "at").agg(F.min(who).alias("same"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-places")
    pairs = shared.select("h", F.when(F.col("at") < 0, F.col("part")).otherwise(F.col("whole")).alias("p")).unionByName(shared.join(_shuffled(by_place), ["key", "at"]).select("h", F.col("same").alias("p")))
    pairs = saved(pairs.where("p is not null and p.h <> h").groupBy("h").agg(F.min("p").alias("partner")), "line-pairs")
    words = worded.select("h", "words")
    tested = pairs.join(words, "h").join(words.select(F.col("h").alias("h2"), F.col("words").alias("words2")), F.col("partner.h") == F.col("h2"))
    near = saved(tested.select("h", "partner", "words", "words2").mapInArrow(_verified, "h bigint, partner struct<first:struct<id:bigint,line:bigint>,h:bigint>").select("h", F.col("partner.first").alias("near")), "near-lines")

    kept = saved(unique.join(near, "h", "left").select("h", "first", "copies", "near").where("copies > 1 or near < first"), "copied-lines")
    found = lines.select("id", "line", "h").join(_shuffled(kept), "h").withColumn("keep", F.least("first", "near"))
    return found.where(place > F.col("keep")).select(F.col("id").alias("doc_id"), F.col("line").alias("line_no"), F.col("keep.id").alias("first_doc_id"), F.col("keep.line").alias("first_line_no"), F.when(F.col("keep") == F.col("first"), 0).otherwise(1).alias("edits"))
