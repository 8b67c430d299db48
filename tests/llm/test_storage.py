"""Token files, WARC archives and shards: exact round trips, damage, edge cases."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import sharding, token_files as tf, warc
from millrace.llm._arrow import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
PIECES = tf.Pieces(PATH)


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=8))
def test_segments_round_trip(docs):
    ids = np.array([i for d in docs for i in d], dtype=np.uint32)
    names = [None if k % 3 == 2 else k - 5 for k in range(len(docs))]
    back = tf.Segment(tf.to_bytes(names, np.array([len(d) for d in docs], dtype=np.int64), ids))
    assert back.doc_ids == names and back.counts.tolist() == [len(d) for d in docs] and (back.ids() == ids).all()
    for a, b in ((0, len(ids) // 2), (len(ids) // 3, len(ids)), (len(ids) // 2, len(ids) // 2)):
        assert (back.ids(a, b) == ids[a:b]).all()


def test_outliers_are_exceptions_and_the_rest_is_narrow():
    ids = np.arange(1280, dtype=np.uint32) % 16 + 1000
    ids[::100] = 4_000_000_000
    data = tf.to_bytes([1], np.array([1280]), ids)
    assert len(data) < 1280 and (tf.Segment(data).ids() == ids).all()


def test_damaged_segments_are_refused():
    data = tf.to_bytes([1], np.array([5]), np.arange(5, dtype=np.uint32))
    for bad in (b"x" + data[1:], data[:-3]):
        with pytest.raises(Exception):
            tf.Segment(bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ éß×÷ 　 \n\t\r 12.,!'s<|>🙂")), max_size=40), max_size=6))
def test_pieces_encode_as_the_whole_text(texts):
    ids, counts = PIECES.encode(*utf8(pa.array(texts, pa.large_string())))
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids + [tf.END_ID] for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_added_tokens_are_encoded_as_the_library_does(make):
    plain = Tokenizer.from_file(PATH)
    texts = ["a text <|endoftext|> more", "", "plain text", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n<|endoftext|>", "ends with <|endof", "text|> begins", "some <|endoftext| text"]
    want = [plain.encode(t, add_special_tokens=False).ids + [tf.END_ID] for t in texts]
    assert any(50256 in x for x in want)
    ids, counts = PIECES.encode(*utf8(pa.array(texts, pa.large_string())))
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    got = {r.doc_id: r for r in tf.read_back(tf.write(make([(k, t, "s") for k, t in enumerate(texts)]), PATH)).collect()}
    for k, x in enumerate(want):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (sum(map(len, want[:k])), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()))


def expected_tokens(rows):
    at, out = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [tf.END_ID], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_token_files_of_odd_and_empty_tables(odd, none, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_TOKENS", 1000)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, tf.read_back(tf.write(odd, PATH)).collect()), key=str) == expected_tokens(rows)
    assert tf.read_back(tf.write(none, PATH)).count() == 0


def test_token_files_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, tf.read_back(tf.write(docs, PATH)).collect()), key=str) == expected_tokens(rows)


# WARC


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected_pages(rows):
    top = {}
    for i, _, html in rows:
        old = top.get(html or "")
        top[html or ""] = i if old is None else old if i is None else max(i, old)
    out = []
    for i, _, html in rows:
        first = top[html or ""]
        again = i != first and first is not None
        out.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    long = "<p>é" + "long text " * 200_000
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", long), (9, "u", "<p>x</p>"), (9, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (None, "u", "only without an id"), (7, "ü", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, id long, digest string")
    assert sorted(map(tuple, warc.read_back(warc.write(pages)).collect()), key=str) == expected_pages(rows)
    assert warc.read_back(warc.write(pages.where("false"))).count() == 0


def test_archives_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    manifest = warc.write(pages)
    assert sorted(map(tuple, warc.read_back(manifest).collect()), key=str) == expected_pages(rows)
    data = warc.read_file(manifest.first().path)
    html = {i: h for i, _, h in rows}
    assert all(r["payload"].decode() == html[r["page_id"]] for r in warc.records(data))


def archive(records, dictionary=None):
    import zstandard

    dictionary = dictionary or warc.train([b"<html>some page</html>"])
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(coder.compress(r) for r in records)


def test_damaged_archives_are_refused():
    good = warc.to_record(1, "u", b"payload", digest("payload"), None, False)
    assert [r["payload"] for r in warc.records(archive([good, good]))] == [b"payload"] * 2
    whole = archive([good])
    damaged = [b"", whole[4:], whole[:-5], archive([good.replace(b"payload\r\n", b"pAyload\r\n")]), archive([good.replace(b"Content-Length: 7", b"Content-Length: 8")]), archive([good.replace(b"WARC-Date", b"WARC-Gone")]), archive([good.replace(b"WARC/1.1", b"HTTP/1.1")])]
    for data in damaged:
        with pytest.raises(warc.ArchiveError):
            list(warc.records(data))


def test_a_compressed_dictionary_is_read():
    import zstandard

    raw = b"<!DOCTYPE html><html><body>" * 20
    good = warc.to_record(1, "u", b"p", digest("p"), None, False)
    coder, packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)), zstandard.ZstdCompressor().compress(raw)
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + coder.compress(good)
    assert [r["page_id"] for r in warc.records(data)] == [1]


# shards


def test_shards_keep_every_row(odd, none):
    back = sharding.sharded(odd, arrivals=3)
    cells = lambda df: sorted((tuple(r) for r in df.select(*odd.columns).collect()), key=str)
    assert cells(back) == cells(odd) and sharding.sharded(none, arrivals=2).count() == 0


def test_compaction_versions_and_conflicts(spark, tmp_path):
    rows = spark.range(400).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(20)).alias("text"))
    store = sharding.Store(spark, f"file://{tmp_path}/store", rows.schema, target_bytes=200_000)
    for k in range(8):
        store.append(rows.where(F.col("id") % 8 == k).repartition(2))
    before = store.shards()
    newest = store.compact()
    after = store.shards()
    assert len(before) == 16 and len(after) <= 6 and sum(s.rows for s in after) == 400 and newest == 9
    assert max(s.size for s in after) < 400_000
    assert store.read(8).count() == store.read().count() == 400 and store.read(3).count() == 150
    with pytest.raises(sharding.CommitConflict):
        store.commit(newest, [])
    assert store.shards() == after
    assert store.vacuum() == 16 and store.versions() == [newest] and store.read().count() == 400


def test_shard_columns_describe_the_files_that_hold_the_rows(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(5)).alias("text"))
    rows = sharding.sharded(docs, folder=f"file://{tmp_path}/store").collect()
    files = {p.name: p for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    newest = max(int(p.stem) for p in (tmp_path / "store" / "versions").glob("*.json") if not p.name.startswith("."))
    assert sorted(r.doc_id for r in rows) == list(range(500)) and {r.shard_version for r in rows} == {newest}
    for name in {r.shard_file for r in rows}:
        own = [r for r in rows if r.shard_file == name]
        assert {r.shard_bytes for r in own} == {files[name].stat().st_size}
        assert sorted(pq.read_table(files[name], columns=["doc_id"])["doc_id"].to_pylist()) == sorted(r.doc_id for r in own)
    assert {r.shard_file for r in rows} == set(files)


def test_files_are_read_in_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 10)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc.write(pages)
    assert manifest.count() > 3 and warc.read_back(manifest).rdd.getNumPartitions() == manifest.count()


def test_words_go_to_the_model_as_the_library_encodes_them():
    texts = ["plain Words über Straße ÀÉ×÷ x", " ", " a", "é", "Ã ÃÃ", "don't we'll 12ab ab12 foo.bar(baz)", "naïve\ncoöperate\r\nfin \u00a0x\u3000y"]
    ids, counts = PIECES.encode(*utf8(pa.array(texts, pa.large_string())))
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids + [tf.END_ID] for t in texts]
    assert PIECES.by_model and counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
