"""Benchmark decontamination: planted passages with substituted words, clean documents, edge cases."""

import random
import time
from itertools import combinations

import pyarrow as pa

from millrace.llm import decontamination as dc


def words(rng, n, tag="w"):
    return [f"{tag}{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages_are_found_and_clean_documents_left(spark, make):
    rng = random.Random(2)
    items = [words(rng, n) for n in (5, 8, 15, 30, 59, 200)]
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, ""), (92, "of the")], "item_id long, text string")
    rows, expected = [], set()
    for k, item in enumerate(items):
        for change in range(4):
            copy = list(item)
            if len(item) >= 15:
                for at in range(3, len(copy), 7):  # one word in seven is another one
                    copy[at] = f"other{change}" if change % 2 else copy[at]
            text = " ".join(words(rng, 40, "d")) + ".\n" + ", ".join(copy).upper() + "! " + " ".join(words(rng, 40, "d"))
            expected.add((len(rows), k))
            rows.append((len(rows), text, "s"))
    clean = [(1000 + k, " ".join(words(rng, 60, "d") + items[3][:6] + words(rng, 60, "d")) + " of the", "s") for k in range(20)]
    docs = make(rows + clean)
    found = dc.overlaps(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    exact = {(r.doc_id, r.item_id): r for r in found.collect()}[12, 3]
    assert (exact.doc_start, exact.item_start, exact.length, exact.matched) == (40, 0, 30, 30)
    kept = dc.clean(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in clean) and kept.columns == docs.columns


def test_edge_cases(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "same words in a row that repeats here"), (None, "a text without an id but with some words in it"), (1, "same words in a row that repeats here")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.matched) for r in dc.overlaps(odd, benchmark).collect()), key=str)
    assert got == [(5, 1, 8)] * 4 + [(None, None, 11)]
    assert sorted((r.doc_id for r in dc.clean(odd, benchmark).collect()), key=str) == [1, 2, 3, 4, 6, 7, 8]
    assert dc.overlaps(none, benchmark).count() == 0 and dc.overlaps(odd, benchmark.where("false")).count() == 0 and dc.clean(odd, benchmark.where("false")).count() == odd.count()


def test_chunks_find_the_same(spark, make, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(words(rng, 20)) for _ in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make([(k, f"before {t} after", "s") for k, t in enumerate(items)])
    whole = sorted(map(tuple, dc.overlaps(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "CHUNK_TOKENS", 200)
    assert sorted(map(tuple, dc.overlaps(docs, benchmark).collect())) == whole and len(whole) == 12


def test_masks_bear_a_substitution_at_any_place():
    rng = random.Random(5)
    item = words(rng, 18)
    index = dc.Index([0], pa.array([" ".join(item)], pa.large_string()))
    for at in range(18):
        copy = list(item)
        copy[at] = "other"
        assert [(x[0], x[1]) for x in index.overlaps(pa.array([" ".join(copy)], pa.large_string()))] == [(0, 0)]


def overlapping(n, places):
    """Whether an item of n tokens with others at these places has an overlap: any segment with three equal in four that has enough of them."""
    same = [k not in places for k in range(n)]
    spans = (same[a:b] for a in range(n) for b in range(a + 1, n + 1))
    return any(4 * sum(x) >= 3 * len(x) and (sum(x) >= dc.MATCHES or 5 * sum(x) >= 4 * n) for x in spans)


def test_every_single_and_double_substitution_of_short_items_is_found():
    rng = random.Random(6)
    for n in range(5, 21):
        item = words(rng, n)
        index = dc.Index([0], pa.array([" ".join(item)], pa.large_string()))
        placings = [c for r in (0, 1, 2) for c in combinations(range(n), r)]
        texts = [" ".join(words(rng, 9, "d") + [f"other{k}" if k in c else w for k, w in enumerate(item)] + words(rng, 9, "d")) for c in placings]
        found = {x[0] for x in index.overlaps(pa.array(texts, pa.large_string()))}
        assert found == {k for k, c in enumerate(placings) if overlapping(n, c)}


def test_tokens_are_letters_and_digits():
    one = dc.tokens(pa.array(["“Été” — l'an 2000!", "été l an 2000"], pa.large_string()))
    assert (one[0][:4] == one[0][4:]).all() and one[1].tolist() == [0, 4, 8]


def test_repeated_tokens_take_little_time_and_find_what_all_pairs_find(monkeypatch):
    item = pa.array(["again " * 200], pa.large_string())
    index = dc.Index([0], item)
    start = time.perf_counter()
    assert [x[-2:] for x in index.overlaps(pa.array(["again " * 20_000, "other " + "again " * 150], pa.large_string()))] == [(200, 200), (150, 150)]
    assert time.perf_counter() - start < 5
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(6)]
    index = dc.Index([0, 1], pa.array([" ".join(rng.choice("ab") for _ in range(40)), "a " * 30], pa.large_string()))
    found = {}
    for often in (0, 10_000, 10**9):
        monkeypatch.setattr(dc, "OFTEN", often)
        found[often] = list(index.overlaps(pa.array(texts, pa.large_string())))
    assert found[0] == found[10_000] == found[10**9] and found[0]


def test_against_every_shift():
    """Documents and items of few different tokens: what is found reaches the most equal tokens over all shifts, and nothing is lost."""
    rng, pairs = random.Random(11), 0
    items = [words(rng, n) for n in (5, 7, 9, 12, 14, 16, 24)]
    index = dc.Index(list(range(len(items))), pa.array([" ".join(x) for x in items], pa.large_string()))
    texts = []
    for _ in range(400):
        copy = list(rng.choice(items))
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 3])):
            copy[at] = f"other{at}"
        texts.append(words(rng, rng.randrange(12), "d") + copy[rng.choice([0, 0, 1]) :] + words(rng, rng.randrange(12), "d"))
    found = {x[:2]: x[-1] for x in index.overlaps(pa.array([" ".join(t) for t in texts], pa.large_string()))}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            least, best = min(dc.MATCHES, -(-4 * len(item) // 5)), 0
            for shift in range(1 - len(item), len(text)):
                same = [0 <= shift + k < len(text) and text[shift + k] == item[k] for k in range(len(item))]
                if sum(same) >= least:
                    spans = (same[a:b] for a in range(len(same)) for b in range(a + 1, len(same) + 1))
                    best = max([best, *(sum(x) for x in spans if 4 * sum(x) >= 3 * len(x))])
            assert ((t, i) in found) == (best >= least) and found.get((t, i), 0) <= best
            pairs += best >= least
    assert pairs > 200
