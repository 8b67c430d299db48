"""Line dedup, quality rules and mixing against brute force; edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import line_dedup as ld, mixing, quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# line dedup


def one_edit(a, b):
    """Edit distance of word lists of 1 at most, by dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.integers(0, 1), max_size=6)] * 2), min_size=1, max_size=8), st.integers(0, 3))
def test_one_edit(pairs, skip):
    a, b = (pa.array([p[k] for p in pairs], pa.list_(pa.int64())).slice(min(skip, len(pairs) - 1)) for k in (0, 1))
    assert ld.one_edit(a, b).tolist() == [one_edit(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]


def brute_lines(rows, least=ld.LEAST_WORDS):
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    lines = [(i, k, tuple(WORD.findall(lower(line)))) for i, t, _ in rows for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for i, k, w in sorted(lines, key=key):
        first.setdefault(w, (i, k))
    near = {}
    for w, p in first.items():
        near[w] = p, 0
        if len(w) >= least:
            for v, q in first.items():
                if len(v) >= least and v != w and abs(len(v) - len(w)) < 2 and key(q) < key(near[w][0]) and one_edit(v, w):
                    near[w] = q, 1
    return sorted(((i, k, *near[w][0], near[w][1]) for i, k, w in lines if key((i, k)) > key(near[w][0])), key=str)


def test_lines_against_all_pairs(make):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(12)}" for _ in range(rng.choice([3, 7, 8, 9, 12, 13, 40]))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(5):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(line)), rng.randrange(3)
                line[at : at + (kind != 2)] = [] if kind == 0 else [f"x{rng.randrange(4)}"]
            text.append((" " if rng.random() < 0.5 else "\t ").join(line).title())
        rows.append((i * 7 % 61, "\n".join(text), "s"))
    got = sorted(map(tuple, ld.copies(make(rows)).collect()), key=str)
    assert got == brute_lines(rows) and any(r[-1] for r in got)
    short = sorted(map(tuple, ld.copies(make(rows), least_words=2).collect()), key=str)
    assert short == brute_lines(rows, 2) and sum(r[-1] for r in short) > sum(r[-1] for r in got)
    with pytest.raises(ValueError):
        ld.copies(make(rows), least_words=1)


def test_lines_of_odd_and_empty_tables(odd, none):
    rows = [tuple(r) for r in odd.where("doc_id <> 4 or doc_id is null").select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, ld.copies(odd).collect()), key=str) == brute_lines(rows)
    assert ld.copies(none).count() == 0


# quality rules


def figures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {p for k, w in enumerate(windows) if seen[w] > 1 for p in (k, k + 1, k + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def brute_rules(rows, max_share, min_documents, min_left):
    normal = lambda x: lower(re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" "))
    documents, lines_of = {}, {}
    for _, t, s in rows:
        documents.setdefault(s, set()).add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines_of.setdefault((s, normal(x)), set()).add(t or "")
    out = []
    for i, t, s in rows:
        own = [x for x in (t or "").split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in own if len(lines_of[s, normal(x)]) >= min_documents and len(lines_of[s, normal(x)]) > max_share * len(documents[s]))
        f = figures(t)
        out.append((i, *f, gone, not f[-1] and f[0] - gone >= min_left * f[0]))
    return sorted(out, key=str)


def test_rules_against_brute_force(make):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 6))]
        host = rng.choice(["a", "b", None])
        if host == "a" and rng.random() < 0.5:
            lines += [f"Copyright  {1990 + i % 3} all rights\treserved here"] * rng.randrange(1, 3)
        if host == "b" and rng.random() < 0.3:
            lines = ["menu " * 80] + lines[:1]
        if rng.random() < 0.1:
            lines += ["do it | again #1 and"] * 40
        rows.append((i, "\n".join(lines), host))
    got = sorted(map(tuple, qr.rate(make(rows)).collect()), key=str)
    assert got == brute_rules(rows, qr.MAX_SHARE, qr.MIN_DOCUMENTS, qr.MIN_LEFT) and any(r[-2] for r in got)
    kept = {r.doc_id: r for r in qr.clean(make(rows)).collect()}
    assert set(kept) == {r[0] for r in got if r[-1]}
    for i, t, s in rows:
        if i in kept and "Copyright" in t:
            assert "Copyright" not in kept[i].text and kept[i].n_chars == len(kept[i].text)


@pytest.mark.parametrize("size", [400, 1000])
def test_long_lines_count_as_short_ones(make, size):
    rng = random.Random(size)
    text = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    long = text(size)
    rows = [(i, f"{long}\n{text(60)}" if i < 60 else text(200), "a") for i in range(100)]
    got = {r.doc_id: r for r in qr.rate(make(rows)).collect()}
    assert all(got[i].removed_words == (size if i < 60 else 0) for i in got)
    assert {i for i in got if got[i].kept} == set(range(60, 100))


def test_exact_copies_count_once_and_numbers_differ(make):
    rng = random.Random(5)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6))
    copied = text()
    rows = [(i, copied if i < 60 else text() + f"\nrow {i} of the table", "a") for i in range(120)]
    assert all(r.kept and not r.removed_words for r in qr.rate(make(rows)).collect())


@pytest.mark.parametrize(("n", "templated", "share"), [(300, 150, 0.95), (300, 75, 0.86), (400, 120, 0.9)])
def test_template_pages_with_text_of_their_own_count_one_by_one(make, n, templated, share):
    rng, size = random.Random(n + templated), 240
    template = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(12)) for _ in range(int(size * share) // 12)]
    text = lambda k: " ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(10**6):x}" for _ in range(k))
    rows = [(i, "\n".join([*template, text(size - 12 * len(template))]) if i < templated else text(size), "a") for i in range(n)]
    rows += [(n + i, rows[i][1], "a") for i in range(5)]
    got = {r.doc_id: r for r in qr.rate(make(rows)).collect()}
    assert all(got[i].removed_words == 12 * len(template) for i, *_ in rows if i < templated or i >= n)
    assert {i for i in got if got[i].kept} == set(range(templated, n))


def test_rules_of_odd_and_empty_tables(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, qr.rate(odd).collect()), key=str) == brute_rules(rows, qr.MAX_SHARE, qr.MIN_DOCUMENTS, qr.MIN_LEFT)
    assert qr.rate(none).count() == 0 and qr.clean(none).count() == 0
    kept = qr.clean(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [4]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abf #|\n\t\x0b\x0c\x1f é")), max_size=60), min_size=1, max_size=6))
def test_figures_of_any_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = qr.figures(rows).select("i", *qr.FIGURES, "base_failed").orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [figures(t) for t in texts]


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]  # 5:2:1 of 450 is 281.25, 112.5, 56.25; the first stops at 200
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 12))]
        goal = mixing.targets(sizes)
        assert abs(sum(goal) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(goal, sizes))


def test_split_tree_deals_exact_quotas():
    quotas = [1000, 1, 0, 37, 250]
    counts = mixing.split_tree(quotas, 7, seed=3)
    assert [sum(c) for c in counts] == quotas and counts == mixing.split_tree(quotas, 7, seed=3)
    per_shard = [sum(c) for c in zip(*counts)]
    assert max(per_shard) - min(per_shard) <= 3
    # the mean of many draws is the even split
    mean = np.mean([mixing.split_tree([300, 100], 4, seed=s)[0] for s in range(300)], axis=0)
    assert np.abs(mean - 75).max() < 1.5


def test_mix_takes_targets_from_disjoint_blocks(make):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.choice([0, 1, 50, 400, 3000]))), rng.choice(["s1", "s2", "s3", "", None])) for i in range(300)]
    docs = make(rows)
    got = mixing.taken(docs, shard_words=20_000).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    assert len(got) == 300 and all(r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"] for r in got)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    totals = [sum(size[i] for i, _, s in rows if s == name) for name in names]
    for name, total, goal in zip(names, totals, mixing.targets(totals), strict=True):
        own = [r for r in got if rows[r.doc_id][2] == name]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(total, round(goal, 6))}
        assert abs(sum(r.taken for r in own) - goal) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, mixing.taken(docs.repartition(3), shard_words=20_000).collect())) == sorted(map(tuple, got))
    sized, draws = mixing.draw(docs, ["doc_id"], shard_words=20_000)
    assert draws.groupBy("row_id", "block", "pass").count().where("count > 1").count() == 0
    per_shard = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert len(per_shard) > 3 and max(per_shard) - min(per_shard) <= len(per_shard)


def test_mixed_documents(make):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(20)), rng.choice("abc")) for i in range(200)] + [(500, "same words here", "a")] * 5
    docs = make(rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(n <= 2 for i, n in times.items() if i != 500) and times.get(500, 0) <= 10
    words = sum(20 * n for i, n in times.items() if i != 500) + 3 * times.get(500, 0)
    assert abs(words - 1.5 * (20 * 200 + 15)) <= 60


def test_mix_of_odd_and_empty_tables(odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r["size"] for r in got) and all(r["size"] == 0 for r in got if r.doc_id in (1, 2, 3, 6))
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_the_mix_comes_from_the_leaves_of_the_tree(make, monkeypatch):
    docs = make([(i, " ".join(f"w{k}" for k in range(300)), "ab"[i % 2]) for i in range(80)])
    whole = {r.doc_id: r.taken for r in mixing.taken(docs, shard_words=5_000).collect()}
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: [[n // 2 for n in c] for c in tree(quotas, shards, seed)])
    half = {r.doc_id: r.taken for r in mixing.taken(docs, shard_words=5_000).collect()}
    assert 0.3 * sum(whole.values()) < sum(half.values()) < 0.6 * sum(whole.values())
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: [[0] * shards for _ in quotas])
    assert not any(r.taken for r in mixing.taken(docs, shard_words=5_000).collect())


def test_taken_against_a_plain_draw(make):
    """The blocks are the first ones of each source's order, as often as its target needs, computed a second time in plain loops."""
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 100, 129, 700]))), rng.choice(["a", "b", None])) for i in range(90)]
    docs = make(rows)
    sized, draws = mixing.draw(docs, ["doc_id"], shard_words=3_000)
    number = {r.row_id: r.doc_id for r in sized.collect()}
    got = {r.doc_id: r.taken for r in mixing.taken(docs, shard_words=3_000).collect()}
    totals, taken = {}, {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len(t.split())
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, rest, open_ = {}, 1.5 * sum(totals.values()), set(names)
    while any(rest * weight[s] / sum(weight[x] for x in open_) > 2 * totals[s] for s in open_):
        s = max(open_, key=lambda s: weight[s] / totals[s])
        goal[s] = 2.0 * totals[s]
        rest -= goal[s]
        open_.remove(s)
    goal |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for r in draws.collect():
        taken[number[r.row_id]] = taken.get(number[r.row_id], 0) + r.words
    assert got == {i: taken.get(i, 0) for i, *_ in rows}
    for s in names:
        own = sum(got[i] for i, _, x in rows if x == s)
        assert abs(own - goal[s]) <= mixing.BLOCK_WORDS and all(got[i] >= len(t.split()) * int(goal[s] // totals[s]) for i, t, x in rows if x == s)


def test_draws_beyond_numpys_limit_are_hypergeometric(monkeypatch):
    want = np.random.default_rng(1).hypergeometric(4_000, 6_000, 2_500, 20_000)
    monkeypatch.setattr(mixing, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(2)
    got = np.array([mixing._hypergeometric(rng, 4_000, 6_000, 2_500) for _ in range(4_000)])
    assert abs(got.mean() - want.mean()) < 1.5 and abs(got.std() / want.std() - 1) < 0.05
    few = [mixing._hypergeometric(rng, 3, 2, 2) for _ in range(4_000)]
    assert np.abs(np.bincount(few, minlength=3) / 4_000 - [0.1, 0.6, 0.3]).max() < 0.03
    large = [mixing._hypergeometric(rng, 10**11, 2 * 10**11, 10**10) for _ in range(20)]
    assert abs(np.mean(large) / (10**10 / 3) - 1) < 1e-4


def test_shards_are_shuffled_inside(make):
    docs = make([(i, "ten words " * 5, "a") for i in range(400)])
    shards = mixing.mixed(docs, shard_words=1_000).select("doc_id", F.spark_partition_id().alias("p")).collect()
    lists = {}
    for r in shards:
        lists.setdefault(r.p, []).append(r.doc_id)
    assert len(lists) > 2 and all(x != sorted(x) for x in lists.values() if len(x) > 9)


def test_columns_of_any_name_keep_their_values(make, spark):
    from millrace.llm import decontamination, near_duplicates

    docs = make([(i, " ".join(f"w{i}x{k}" for k in range(60)) + "\nshared line", "a") for i in range(30)])
    benchmark = spark.createDataFrame([(1, "nothing in common with any of them at all")], "item_id long, text string")
    names = docs.columns[13:]
    want = tuple(docs.select(*names).first())
    for out in (qr.clean(docs), decontamination.clean(docs, benchmark), near_duplicates.deduplicated(docs), mixing.mixed(docs)):
        rows = out.select("doc_id", *names).collect()
        assert out.columns == docs.columns and {tuple(r)[1:] for r in rows} == {want} and len({r.doc_id for r in rows}) == 30


def test_native_operators_run_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (qr.rate(docs), mixing.taken(docs), qr.figures(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
