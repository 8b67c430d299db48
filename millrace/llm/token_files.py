"""Token-ID files of patched frame-of-reference blocks.

Documents are tokenised in ascending order of their id, each with an end id, and written as files of segments, which bound
the memory that a writer or reader needs. In a segment the ids are cut into blocks of BLOCK values. A block stores its minimum, and the values less that minimum packed at the width that
holds PERCENTILE of them; the high bits of the others are in the block's exception list (position and value). The index
has each block's start, so a range of ids is read without what comes before it.

Segment: header (magic, counts and section sizes), document ids with a null mask, ids in each document, block minima, widths,
exception counts, block starts (in 64-bit words), packed words, exception positions and values.

Texts are cut where the tokenizer always cuts (before a space that follows a letter or mark, around a single line end between such, and before a mark that
follows a letter), each distinct piece is encoded once with the tokenizer and kept for the worker's later batches; a piece
that is one word goes to the tokenizer's model directly. Texts with one of the tokenizer's added tokens, which a cut could
part, are encoded whole.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows with equal ids
are documents of their own, in the order of a hash of the text; an empty table writes no file and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._arrow import slices, span_hashes, utf8
from ._files import read_file, write_file
from ._store import in_tasks, new_folder, saved

BLOCK = 128
PERCENTILE = 90
END_ID = 2
SEGMENT_TOKENS = 1_000_000
FILE_BYTES = 48 << 20
KEPT_PIECES = 2_500_000
ENCODE_AT_ONCE = 20_000
ENCODE_BYTES = 2 << 20
_MAGIC = b"MRTOKPF1"
_HEAD = struct.Struct("<8sQQQQQQ")  # magic, bytes of the segment, documents, ids, blocks, words, exceptions


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 64-bit words."""
    out = np.zeros((BLOCK * width // 64, len(v)), dtype=np.uint64)
    for j, x in enumerate(np.ascontiguousarray(v.T)):
        at, shift = divmod(j * width, 64)
        out[at] |= x << np.uint64(shift)
        if shift + width > 64:
            out[at + 1] |= x >> np.uint64(64 - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out, w, mask = np.empty((BLOCK, len(words)), dtype=np.uint64), np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 64)
        x = w[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (w[at + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return out.T


def to_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents with these ids (or None), counts[i] token ids each, in order."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.concatenate([ids.astype(np.uint64), np.full(blocks * BLOCK - n, ids[-1] if n else 0, dtype=np.uint64)]).reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint64)
    rest = full - least[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.ceil(np.log2(np.partition(rest, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.uint8) if blocks else np.zeros(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))))
    packed = np.zeros(starts[-1], dtype=np.uint64)
    high = rest >> width[:, None].astype(np.uint64)
    block, position = np.nonzero(high)
    low = rest & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1))
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed[starts[own][:, None] + np.arange(int(w) * BLOCK // 64)] = _pack(low[own], int(w))
    exceptions = np.bincount(block, minlength=blocks).astype("<u1")
    known = np.array([x is not None for x in doc_ids], dtype="<u1")
    parts = [np.array([x or 0 for x in doc_ids], dtype="<i8"), known, counts.astype("<i8"), least.astype("<u4"), width, exceptions, starts[:-1].astype("<i8"), packed.astype("<u8"), position.astype("<u1"), high[block, position].astype("<u4")]
    body = b"".join(x.tobytes() for x in parts)
    return _HEAD.pack(_MAGIC, _HEAD.size + len(body), len(doc_ids), n, blocks, len(packed), len(block)) + body


def segments(data: bytes) -> Iterator[Segment]:
    """The segments of a file, in order."""
    at = 0
    while at < len(data):
        size = _HEAD.unpack_from(data, at)[1]
        if size < _HEAD.size:
            raise ValueError("not a token file")
        yield Segment(data[at : at + size])
        at += size


class Segment:
    """Reads what to_bytes wrote: doc_ids, counts, and ids by range."""

    def __init__(self, data: bytes):
        magic, _, docs, self.n, blocks, words, exceptions = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at, sections = _HEAD.size, []
        for kind, count in (("<i8", docs), ("<u1", docs), ("<i8", docs), ("<u4", blocks), ("<u1", blocks), ("<u1", blocks), ("<i8", blocks), ("<u8", words), ("<u1", exceptions), ("<u4", exceptions)):
            sections.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
            at += count * np.dtype(kind).itemsize
        if at != len(data):
            raise ValueError("token file has the wrong length")
        names, known, self.counts, self.least, self.width, per_block, self.starts, self.words, self.position, self.high = sections
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=True)]
        self.patches = np.concatenate(([0], np.cumsum(per_block.astype(np.int64))))
        if int(self.counts.sum()) != self.n:
            raise ValueError("token file counts disagree")

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids start to stop; only their blocks are unpacked."""
        stop = self.n if stop is None else stop
        first, last = start // BLOCK, -(-stop // BLOCK)
        width = self.width[first:last]
        out = np.zeros((last - first, BLOCK), dtype=np.uint64)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                out[own] = _unpack(self.words[self.starts[first + own][:, None] + np.arange(int(w) * BLOCK // 64)], int(w))
        a, b = self.patches[first], self.patches[last]
        block = np.repeat(np.arange(last - first), np.diff(self.patches[first : last + 1]))
        out[block, self.position[a:b]] |= self.high[a:b].astype(np.uint64) << width[block].astype(np.uint64)
        out += self.least[first:last, None].astype(np.uint64)
        return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)


_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# the characters that byte-level models write for bytes: visible ones as they are, the others from U+0100 on
_BYTE_CHARS = np.arange(256, dtype="<u2")
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_CHARS[_HIDDEN] = 0x100 + np.arange(len(_HIDDEN))
_PUNCTUATION = _GRAPHIC & ~_LETTER
_PUNCTUATION[0x30:0x3A] = False


def cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces: every text's start, and places where byte-level pre-tokenisation always cuts, whatever else the text has."""
    n = len(raw)
    mark = np.zeros(n + 1, dtype=bool)
    solid = _GRAPHIC[raw]  # ends a letter or mark: ASCII, or a two-byte character that begins with 0xC3 (none of them is white space)
    solid[1:] |= (raw[1:] >= 0x80) & (raw[:-1] == 0xC3)
    line = raw == 0x0A
    mark[1:n] = solid[:-1] & ((raw[1:] == 0x20) | line[1:])
    mark[1:n] |= _LETTER[raw[:-1]] & _PUNCTUATION[raw[1:]]
    lone = line[1:-1] & solid[:-2] & _GRAPHIC[raw[2:]]
    mark[2:n] |= lone
    mark[off[:-1]] = True
    return np.flatnonzero(mark[:n])


def single_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Pieces of letters only (ASCII, and U+00C0 to U+00FF), after one space perhaps."""
    second = np.zeros(len(raw), dtype=bool)
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    letter = _LETTER[raw] | second
    letter[:-1] |= second[1:]
    other = np.concatenate(([0], np.cumsum(~letter)))
    first = start + ((raw[start] == 0x20) & (end - start > 1))
    return other[end] == other[first]


class Pieces:
    """Encodes each distinct piece of text once; what is kept is bounded by KEPT_PIECES and costs only time when it is dropped."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        # a single word then is one unit of the model, which needs no pre-tokeniser
        self.by_model = isinstance(self.tokenizer.model, models.BPE) and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _append(self, new: np.ndarray) -> None:
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(new)), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)

    def _encode_new(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of these pieces to flat; where each one's begin, and how many it has."""
        begin, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        word = single_words(raw, start, end) if self.by_model else np.zeros(len(start), dtype=bool)
        data, chars, model = raw.tobytes(), _BYTE_CHARS[raw].tobytes().decode("utf-16-le"), self.tokenizer.model
        for own, by_model in ((np.flatnonzero(word), True), (np.flatnonzero(~word), False)):
            for k in range(0, len(own), ENCODE_AT_ONCE):
                some = own[k : k + ENCODE_AT_ONCE]
                spans = zip(start[some].tolist(), end[some].tolist(), strict=True)
                if by_model:
                    got = (model.tokenize(chars[a:b]) for a, b in spans)
                    ids, stops = [], []
                    for tokens in got:
                        ids += [t.id for t in tokens]
                        stops.append(len(ids))
                    new, length[some] = np.array(ids, dtype=np.uint32), np.diff(stops, prepend=0)
                else:
                    ids = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in spans], add_special_tokens=False)]
                    length[some] = np.fromiter(map(len, ids), np.int32, len(ids))
                    new = np.fromiter(chain.from_iterable(ids), np.uint32, int(length[some].sum()))
                begin[some] = self.used + np.cumsum(length[some], dtype=np.int64) - length[some]
                self._append(new)
        return begin, length

    def _with_added(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The texts that have an added token."""
        data, found = raw.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                doc = int(np.searchsorted(off, at, side="right")) - 1
                inside = at + len(token) <= off[doc + 1]
                if inside:
                    found.add(doc)
                at = data.find(token, int(off[doc + 1]) if inside else at + 1)
        return np.array(sorted(found), dtype=np.int64)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with END_ID behind it, and how many each has."""
        off = off - off[0]
        whole = self._with_added(raw, off)
        if not len(whole):
            return self._encode_cut(raw, off)
        size = np.diff(off)
        other = np.ones(len(size), dtype=bool)
        other[whole] = False
        ids, counts = self._encode_cut(raw[np.repeat(other, size)], np.concatenate(([0], np.cumsum(np.where(other, size, 0)))))
        parts, at = [], 0
        ends = np.cumsum(counts)
        for k in whole.tolist():
            text = raw[off[k] : off[k + 1]].tobytes().decode()
            own = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype=np.uint32)
            parts += [ids[at : ends[k] - 1], own]
            at, counts[k] = ends[k], len(own)
        return np.concatenate([*parts, ids[at:]]), counts

    def _encode_cut(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(off) - 1
        if not len(raw):
            return np.full(docs, END_ID, np.uint32), np.ones(docs, np.int64)
        start = cuts(raw, off)
        end = np.append(start[1:], len(raw))
        unique, first, inverse = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT_PIECES:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            begin, length = self._encode_new(raw, start[first[new]], end[first[new]])
            self.hashes = np.insert(self.hashes, at[new], unique[new])
            self.begin = np.insert(self.begin, at[new], begin)
            self.length = np.insert(self.length, at[new], length)
        which = np.searchsorted(self.hashes, unique)[inverse]
        length = self.length[which].astype(np.int64)
        stop = np.cumsum(length)
        ids = self.flat[np.repeat(self.begin[which] - (stop - length), length) + np.arange(stop[-1])]
        before = np.concatenate(([0], stop))[np.searchsorted(start, off)]
        return np.insert(ids, before[1:], np.uint32(END_ID)), np.diff(before) + 1


_pieces: dict[str, Pieces] = {}


def _writer(id_col: str, text: str, folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _pieces:
            _pieces[tokenizer] = Pieces(tokenizer)
        part, rows, data, totals = TaskContext.get().partitionId(), [], [], [0, 0, 0]
        names, counts, ids, held = [], [], [], 0

        def end_segment() -> None:
            nonlocal names, counts, ids, held
            if names:
                data.append(to_bytes(names, np.concatenate(counts), np.concatenate(ids)))
                totals[:] = [totals[0] + len(names), totals[1] + held, totals[2] + len(data[-1])]
                names, counts, ids, held = [], [], [], 0

        def end_file() -> None:
            end_segment()
            if data:
                path = write_file(folder, f"tokens-{part:06d}-{len(rows):06d}.bin", b"".join(data))
                rows.append((part, len(rows), path, *totals[:2]))
                data.clear()
                totals[:] = [0, 0, 0]

        for piece in slices(batches, text, ENCODE_BYTES):
            got, each = _pieces[tokenizer].encode(*utf8(piece.column(piece.schema.get_field_index(text))))
            names += piece.column(piece.schema.get_field_index(id_col)).to_pylist()
            counts.append(each)
            ids.append(got)
            held += len(got)
            if held >= SEGMENT_TOKENS:
                end_segment()
            if totals[2] >= FILE_BYTES:
                end_file()
        end_file()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"])

    return write


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' token files in ascending order of id; the manifest: part, seq, path, n_docs, n_ids, and start, the ids in all files before."""
    folder = new_folder(docs.sparkSession, "token-files")
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    manifest = saved(ordered.mapInArrow(_writer("id", "text", folder, tokenizer), "part int, seq int, path string, n_docs bigint, n_ids bigint"), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            start, docs = row["start"], 0
            for part in segments(read_file(row["path"])):
                ids, ends = part.ids().astype("<u4"), np.cumsum(part.counts)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - part.counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part.doc_ids, pa.int64()), pa.array(start + ends - part.counts), pa.array(part.counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                start, docs = start + part.n, docs + len(part.doc_ids)
            if (docs, start - row["start"]) != (row["n_docs"], row["n_ids"]):
                raise ValueError(f"{row['path']} differs from its manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """Per document of the files of a manifest: doc_id, start, n_tokens, ids_crc32."""
    return in_tasks(manifest.select("path", "n_docs", "n_ids", "start")).mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
