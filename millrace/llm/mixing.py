"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in native expressions only.

Documents are cut into blocks of words. Every source gets a target in words and from it an exact quota of blocks: whole
passes over the source, then the first blocks of its permuted order that come nearest to the rest. A binary tree over the
output shards splits the vector of quotas: at each node the left half's blocks are a multivariate hypergeometric draw.
Each leaf takes its counts of every source as a range of the source's permuted order, so shards draw disjoint blocks; what no
leaf takes is not in the mix. Within a shard the blocks are shuffled: they are in the order of shuffle_key.

The permuted order is by hash. Its ranks and running word counts come from two levels of windows: within buckets of the
hash, and over the buckets' sums; a source has about as many buckets as a bucket has blocks, so no task gets a whole source.
On the driver there is only the plan: a row per source, and a count per source and shard. MOST_COUNTS of these are allowed:
sources are corpora here, not hosts, and more sources need larger shards.

Defined cases: null or blank texts have size 0 and no blocks; a null source comes last in the order of sources; rows that
repeat are documents of their own; an empty table gives an empty mix; further columns are ignored by draw() and kept by
mixed(), whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ._store import saved, small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 128
SHARD_WORDS = 20_000_000
SEED = 7
NUMPY_LIMIT = 1_000_000_000
MOST_COUNTS = 2_000_000


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> list[float]:
    """Words for each source, in the order of sources: share x all sizes by repeating weights, none above most_times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        above = {i for i in open_ if rest * w[i] / total > most_times * sizes[i]}
        for i in above or open_:
            out[i] = float(most_times * sizes[i]) if above else rest * w[i] / total
        rest -= sum(out[i] for i in above)
        open_ = open_ - above if above else set()
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source for each shard: shard totals differ by one at most, and every way to deal the blocks is equally likely."""
    rng = np.random.default_rng(seed)

    def go(left: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [left]
        half = n // 2
        drawn = _draw(rng, left, int(left.sum()) * half // n)
        return go(drawn, half) + go(left - drawn, n - half)

    return [list(map(int, x)) for x in zip(*go(np.array(quotas, dtype=np.int64), shards), strict=True)] if quotas else []


def _draw(rng, colours: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw by its conditional univariate ones."""
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, k in enumerate(map(int, colours)):
        rest -= k
        out[i] = _hypergeometric(rng, k, rest, n)
        n -= int(out[i])
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """How many of n drawn ones are good; beyond numpy's limit by inversion, with the probabilities' ratios added up from the mode to 12 standard deviations."""
    low, high, total = max(0, n - bad), min(good, n), good + bad
    if low == high:
        return low
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    p = good / total
    mode, far = (n + 1) * (good + 1) // (total + 2), int(12 * (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5) + 50
    k = np.arange(max(low, mode - far), min(high, mode + far) + 1)
    here = k[:-1].astype(np.float64)
    steps = np.log(good - here) + np.log(n - here) - np.log(here + 1) - np.log(bad - n + here + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(len(k) - 1, np.searchsorted(chance, rng.random() * chance[-1], side="right"))])


def _plan(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("p")).select("p.*")


def draw(docs: DataFrame, key: list[str], text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES,
         block_words: int | None = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents (key, row_id, size, source_size, target) and the drawn blocks (row_id, block, start_word, words, pass, shard, shuffle_key).

    block_words None makes each document one block. row_id numbers the rows of the first table.
    """
    sized = saved(docs.select(*key, F.expr("coalesce(concat('=', `{}`), '')".format(source)).alias("_source"),
                              F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
                              F.xxhash64(F.lit(seed), *key, text).alias("_hash")).withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")
    n = F.expr("if(size > 0, 1, 0)") if block_words is None else F.ceil(F.col("size") / block_words)
    names = sized.groupBy("_source").agg(F.sum("size").alias("size"), F.sum(n.cast("long")).alias("blocks")).collect()
    names.sort(key=lambda r: (r._source == "", r._source.encode()))
    goals = targets([r["size"] for r in names], weights, share, most_times)
    plan = [{"s": r._source, "size": r["size"], "target": t, "passes": int(t // r["size"]) if r["size"] else 0, "blocks": r.blocks, "buckets": max(1, round(r.blocks**0.5))} for r, t in zip(names, goals, strict=True)]
    sources = F.broadcast(_plan(docs, plan, "s:string,size:bigint,target:double,passes:int,blocks:bigint,buckets:bigint").withColumnsRenamed({"s": "_source", "size": "source_size"}))
    sized = sized.join(sources, "_source", "left")

    pieces = sized.select("_source", "row_id", "size", "_hash", "source_size", "target", "passes", "blocks", "buckets", F.explode(F.expr(f"if(size > 0, sequence(0L, {'0L' if block_words is None else f'(size - 1) div {block_words}'}), array())")).alias("block"))
    parts = "1L" if block_words is None else f"((size - 1) div {block_words} + 1)"
    pieces = pieces.withColumns({
        "start_word": F.expr(f"block * size div {parts}"), "words": F.expr(f"(block + 1) * size div {parts} - block * size div {parts}"),
        "_order": F.xxhash64("_hash", "block"),
    }).withColumn("_bucket", F.least(F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * F.col("buckets")), F.col("buckets") - 1))
    pieces = saved(pieces.select("_source", "row_id", "block", "start_word", "words", "_order", "_bucket"), "mix-blocks")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("_source", "_bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n")).select(
        "_source", "_bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "row_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.withColumns({"_w": F.coalesce(F.sum("words").over(inside), F.lit(0)), "_n": F.count("words").over(inside)}).join(offsets, ["_source", "_bucket"]).join(sources, "_source")
    half = F.col("_w0") + F.col("_w") + F.col("words") / 2
    ranked = saved(ranked.select("_source", "row_id", "block", "start_word", "words", "_order", "passes", "blocks", (F.col("_n0") + F.col("_n")).alias("_rank"),
                                 (half <= F.col("target") - F.col("passes") * F.col("source_size")).alias("_more")), "mix-ranks")

    more = {r._source: r.n for r in ranked.where("_more").groupBy("_source").agg(F.count("*").alias("n")).collect()}
    quotas = [p["passes"] * p["blocks"] + more.get(p["s"], 0) for p in plan]
    shards = max(1, round(sum(goals) / shard_words))
    if shards * len(plan) > MOST_COUNTS:
        raise ValueError(f"{len(plan)} sources in {shards} shards are more than {MOST_COUNTS} counts; use fewer sources or a larger shard_words")
    bounds = [{"s": p["s"], "bounds": [int(x) for x in np.cumsum(c)]} for p, c in zip(plan, split_tree(quotas, shards, seed), strict=True)]
    shares = F.broadcast(_plan(docs, bounds, "s:string,bounds:array<bigint>").withColumnRenamed("s", "_source"))
    draws = ranked.withColumn("pass", F.explode(F.expr("if(passes + int(_more) > 0, sequence(0, passes + int(_more) - 1), array())"))).join(shares, "_source")
    steps = max(1, shards.bit_length())
    draws = draws.withColumn("_at", F.expr("pass * blocks + _rank")).where("_at < element_at(bounds, -1)").withColumn("shard", F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {shards - 1}), (a, x) -> if(a.lo >= a.hi, a, if(element_at(bounds, int((a.lo + a.hi) div 2) + 1) <= _at, named_struct('lo', int((a.lo + a.hi) div 2 + 1), 'hi', a.hi), named_struct('lo', a.lo, 'hi', int((a.lo + a.hi) div 2)))), a -> a.lo)"))
    return sized.select(*key, "row_id", "size", "source_size", "target"), draws.select("row_id", "block", "start_word", "words", "pass", "shard", F.xxhash64(F.lit(seed), F.lit("shuffle"), "_order", "pass").alias("shuffle_key"))


def taken(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """Per row of docs: id_col, size, source_size, target, taken and the number of shards that got words of it."""
    sized, draws = draw(docs, [id_col], **settings)
    sums = draws.groupBy("row_id").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("shards"))
    none = F.lit(0).cast("long")
    return sized.join(sums, "row_id", "left").select(id_col, "size", F.coalesce("source_size", none).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", none).alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **settings) -> DataFrame:
    """docs as the mix takes them, whole documents as blocks: each row as often as it is drawn, with its columns as they are.

    A shard's rows are in one partition, in the order of their shuffle_key.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    keyed = rows.withColumns({"_m1": F.xxhash64("_row"), "_m2": F.xxhash64(F.lit("mix"), F.length("_text"), "_from", "_row")})
    sized, draws = draw(keyed, ["_m1", "_m2"], "_text", "_from", block_words=None, **settings)
    takes = saved(sized.select("row_id", "_m1", "_m2").join(draws.select("row_id", "shard", "shuffle_key"), "row_id").drop("row_id"), "mix-draws")
    shards = (takes.agg(F.max("shard")).first()[0] or 0) + 1
    doubles = saved(sized.groupBy("_m1", "_m2").agg(F.count("*").alias("n")).where("n > 1").select("_m1", "_m2"), "mix-doubles")
    if doubles.limit(1).count():  # rows that repeat exactly: one of them stands for all
        again = keyed.join(doubles, ["_m1", "_m2"], "left_semi").dropDuplicates(["_m1", "_m2"])
        keyed = keyed.join(doubles, ["_m1", "_m2"], "left_anti").unionByName(again)
    drawn = keyed.select("_m1", "_m2", "_row").join(small_side(takes), ["_m1", "_m2"])
    return drawn.repartition(shards, "shard").sortWithinPartitions("shard", "shuffle_key", "_m1").select("_row.*")
