"""Near-duplicates against brute force over all pairs; signature trees against all pairs of sets."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import near_duplicates as nd


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """n_shingles and component of each row, by the definition."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    smallest = {}
    for k, (i, *_) in enumerate(rows):
        old = smallest.get(root(k))
        smallest[root(k)] = i if old is None else old if i is None else min(i, old)
    return sorted(((i, len(sets[k]), smallest[root(k)]) for k, (i, *_) in enumerate(rows)), key=str)


def corpus(seed, n=160):
    rng, rows = random.Random(seed), []
    common = [f"licence{k}" for k in range(70)]
    while len(rows) < n:
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 4, 5, 6, 20, 60, 150]))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy).title() if rng.random() < 0.2 else "\n ".join(copy), "s"))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_against_all_pairs(make, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BUCKET_SHINGLES", 2000)
    monkeypatch.setattr(nd, "PART_SETS", 50)
    rows = corpus(block)
    assert sorted(map(tuple, nd.components_of(make(rows)).collect()), key=str) == brute(rows)


def test_edge_cases(odd, none):
    got = sorted(map(tuple, nd.components_of(odd).collect()), key=str)
    assert got == brute([tuple(r) for r in odd.select("doc_id", "text", "source").collect()])
    assert nd.components_of(none).count() == 0
    kept = nd.deduplicated(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert nd.deduplicated(none).count() == 0


def test_one_document_of_each_component_stays(make):
    rows = corpus(3)
    kept = [r.doc_id for r in nd.deduplicated(make(rows)).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(rows)})


def test_texts_that_share_an_id_or_have_none_stay(make):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    near = "zz " + texts[5]
    rows = [(None, texts[0], "s"), (3, texts[0], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (7, texts[3], "s"), (7, texts[4], "s"), (7, texts[4], "s"),
            (8, texts[5], "s"), (8, near, "s"), (None, near, "s"), (None, "", "s"), (7, " ", "s"), (None, texts[2], "s")]
    kept = sorted(((r.doc_id, r.text) for r in nd.deduplicated(make(rows)).collect()), key=str)
    assert kept == sorted([(3, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, min(near, texts[5])), (None, ""), (7, " ")], key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.sampled_from([9, 12]))
def test_trees_find_every_component(seed, n, width):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, size=int(rng.integers(1, 60))).astype(np.uint64) for _ in range(max(1, n // 5))]
    grams = []
    for _ in range(n):
        b = base[int(rng.integers(0, len(base)))]
        keep = b[rng.random(len(b)) < 0.95]
        grams.append(np.unique(np.concatenate([keep if len(keep) else b, rng.integers(0, 1 << 63, size=int(rng.integers(0, 4))).astype(np.uint64)])))
    labels = np.arange(n)

    def components(pairs, m):
        label = list(range(m))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k in range(m) if label[k] == x) for x in label}

    every = [(a, b) for a in range(n) for b in range(a) if nd._linked(grams[a], grams[b], 75)]
    assert components(nd.tree_join(nd.Tree(grams, labels, width), None, 75), n) == components(every, n)
    half = n // 2
    if half:
        across = [(a, b) for b, a in every if a < half <= b]
        got = [(a, b + half) for a, b in nd.tree_join(nd.Tree(grams[:half], labels[:half], width), nd.Tree(grams[half:], labels[half:], width), 75)]
        assert components(got, n) == components(across, n)


def test_components_of_a_long_chain(spark):
    from millrace.llm._graph import components

    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[100] == got[101] == 100
    assert components(links.where("false")).count() == 0


def test_unrelated_texts_under_repeated_and_null_ids_stay(make):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(8)]
    rows = [(i, t, "s") for i, t in zip([1, 1, 2, 2, None, None, None, 3], texts)] + [(7, texts[0], "s")]
    assert sorted(r.text for r in nd.deduplicated(make(rows)).collect()) == sorted(texts)


def test_smaller_shingles_are_enough():
    """Whatever two sets link, the looked at parts of both have the stated number in common."""
    rng = np.random.default_rng(1)
    for spread in (nd.SPREAD, nd.TOKEN_SPREAD):
        for _ in range(400):
            n, m = rng.integers(1, 80, 2)
            common = int(np.ceil(75 * (n + m) / 175))
            if common > min(n, m):
                continue
            pool = rng.permutation(10_000)[: n + m - common]
            x, y = np.sort(pool[:n]), np.sort(pool[n - common :])
            (p, k), (q, l) = nd._prefix(n, 75, spread), nd._prefix(m, 75, spread)
            assert len(set(x[:p].tolist()) & set(y[:q].tolist())) >= max(k, l)
