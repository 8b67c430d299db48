"""N-gram Jaccard join by signature trees.

A document's set is its distinct 5-word shingles (hashed to 64 bits). Two documents link if the sets' Jaccard similarity is
at least 0.75, compared in whole numbers. Every link is found; equal sets are one node, so copies are not expanded.

1. scan: size and digest of each document's set; documents with equal digests are one set.
2. A set can only link if 75 % of its shingles are in another set, so of its some 44 % smallest shingles 43 % at least are
   among those of another one. These are dealt by hash as packed blocks, where a task sends a shingle that several of its
   sets have only once, and each set learns how many are shared; sets with too few go.
3. Of sets that remain, the rarest shingles that a partner must have one of are its tokens; in the same way, 62 % of a set's
   shingles are enough to look at.
4. Sets that tokens connect are candidates of each other and are joined by signature trees: nodes hold OR-combined
   bitmaps of shingles and size ranges, and two trees are traversed together; a pair of nodes is left out if its largest
   possible overlap is too small, its sizes are too far apart, or all of its sets are linked already. Pairs of leaves are
   verified on the exact sets. Candidates of up to BLOCK sets are one tree. More are cut into blocks: first blocks of sets
   with a common token, then the pairs of blocks whose root nodes (bitmap, sizes, labels) can hold a link between sets not
   linked already; root nodes are compared in tiles, before any set is sent.
5. Components of the links, by contraction in Spark.

Hash collisions of 64-bit shingles or 128-bit set digests are the only approximation.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer than five words is one
shingle; a null id counts as larger than every id, and its component is null only if no id is known; rows that repeat are
copies; an empty table gives an empty result; further columns are ignored by components_of and kept by deduplicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _graph
from ._arrow import lower_ascii, mix, slices, span_hashes, utf8, window_hashes, words
from ._store import saved, small_side

WORDS = 5
PERCENT = 75
BUCKET_SHINGLES = 600_000
SPREAD = 4
TOKEN_SPREAD = 2
KNOWN = 1_000_000
PART_SETS = 20_000
MOST_ROWS = 2_000_000
BLOCK = 512
FANOUT = 8
TILE = 64


def shingle_sets(column: pa.Array, n_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingles of each text that has words."""
    raw, off = utf8(column)
    raw = lower_ascii(raw)
    start, end, doc = words(raw, off)
    hashes, at = window_hashes(span_hashes(raw, start, end), doc, n_words)
    order = np.argsort(at, kind="stable")
    hashes, at = hashes[order], at[order]
    cut = np.flatnonzero(np.diff(at)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
        if b > a:
            s = np.sort(hashes[a:b])
            yield int(at[a]), s[np.concatenate(([True], s[1:] != s[:-1]))]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(np.add.reduce(mix(s ^ np.uint64(salt))).astype(np.int64)) or 1 for salt in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557))


def _text(piece: pa.RecordBatch) -> pa.Array:
    return piece.column(piece.schema.get_field_index("text"))


def _scan(n_words: int):
    def run(batches):
        for piece in slices(batches, "text"):
            n, d1, d2 = np.zeros(piece.num_rows, np.int64), [None] * piece.num_rows, [None] * piece.num_rows
            for i, s in shingle_sets(_text(piece), n_words):
                n[i], (d1[i], d2[i]) = len(s), _digest(s)
            own = [piece.column(piece.schema.get_field_index(c)) for c in ("row1", "row2")]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *own], names=["id", "n", "set1", "set2", "row1", "row2"])

    return run


def _prefix(n: np.ndarray, percent: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of n shingles: how many of the smallest ones are looked at, and how many of these any partner has among its own.

    A partner has t = percent % of n at least. Of the n - t + k smallest shingles, k at least are common ones, and among as many of
    the partner's: k grows no faster than t, so the larger t of the two makes up for the larger k.
    """
    t = -(-percent * n // 100)
    k = np.minimum(t, 1 + t // spread)
    return n - t + k, k


def _postings(n_words: int, buckets: int, percent: int):
    """Rows of bucket, shingles and sets, packed: the smallest shingles of each set (32 bits of each; the bucket is of the others).

    A set of 0 stands for two sets or more: a task sends a shingle that several of its sets have only once, and remembers up to
    KNOWN of them. Buckets below 0: what is known to be shared, as counts and sets. A set may be counted more than once, which
    only makes it pass.
    """

    def run(batches):
        seen, known = set(), np.zeros(0, np.uint64)
        for piece in slices(batches, "text"):
            shingles, sets = [], []
            for _, s in shingle_sets(_text(piece), n_words):
                key = _digest(s)[0]
                if key not in seen:
                    seen.add(key)
                    shingles.append(s[: _prefix(np.int64(len(s)), percent, SPREAD)[0]])
                    sets.append(np.full(len(shingles[-1]), key, np.int64))
            if len(seen) > KNOWN:
                seen.clear()
            if not shingles:
                continue
            h, d = np.concatenate(shingles), np.concatenate(sets)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            old = np.zeros(len(h), dtype=bool)
            if len(known):
                old = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            twice = np.zeros(len(h), dtype=bool)
            twice[1:] = h[1:] == h[:-1]
            twice[:-1] |= twice[1:]
            local, count = np.unique(d[twice | old], return_counts=True)
            several = np.unique(h[twice & ~old])
            if len(known) < KNOWN:
                known = np.union1d(known, several)
            h, d = np.concatenate([h[~twice & ~old], several]), np.concatenate([d[~twice & ~old], np.zeros(len(several), np.int64)])
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((d, bucket))
            bucket, h, d = bucket[order], h[order].astype(np.uint32), d[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            ends = [x for x in zip([0, *cut.tolist()], [*cut.tolist(), len(h)], strict=True) if x[0] < x[1]]
            rows = [(int(bucket[a]), h[a:b].tobytes(), d[a:b].tobytes()) for a, b in ends]
            if len(local):
                rows.append((-1 - int(mix(local[:1].astype(np.uint64))[0] % np.uint64(buckets)), count.astype(np.uint32).tobytes(), local.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shingles", "sets"])

    return run


def _shared(parts: int):
    """Sums a bucket's rows to rows of part, sets and counts (packed): which sets have how many shared shingles there, dealt by set to `parts` parts."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = _shared_counts(group)
        part = (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        spans = [x for x in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True) if x[0] < x[1]]
        return pa.table({"part": pa.array([int(part[a]) for a, _ in spans], pa.int32()), "sets": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())})

    return run


def _sums(group: pa.Table) -> pa.Table:
    keys, inverse = np.unique(np.frombuffer(b"".join(group["sets"].to_pylist()), np.int64), return_inverse=True)
    counts = np.bincount(inverse, weights=np.frombuffer(b"".join(group["counts"].to_pylist()), np.int64)).astype(np.int64)
    return pa.table({"set1": pa.array(keys, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _shared_counts(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(group["shingles"].to_pylist()), np.uint32)
    d = np.frombuffer(b"".join(group["sets"].to_pylist()), np.int64)
    if group["bucket"][0].as_py() < 0:
        keys, inverse = np.unique(d, return_inverse=True)
        counts = np.bincount(inverse, weights=h.astype(np.float64)).astype(np.int64)
    else:
        order = np.argsort(h)
        h, d = h[order], d[order]
        same = np.concatenate((h[1:] == h[:-1], [False]))
        run = same.copy()
        run[1:] |= same[:-1]  # in a run of two rows or more
        h, d = h[run], d[run]
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, bool)
        h, d = h[first], d[first]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        number = np.diff(np.append(heads, len(h)))
        several = np.add.reduceat((d == 0).astype(np.int64), heads) + number >= 2 if len(heads) else np.zeros(0, bool)
        own = np.repeat(several, number) & (d != 0)
        keys, counts = np.unique(d[own], return_counts=True)
    return keys, counts.astype(np.int64)


def _sets(n_words: int):
    def run(batches):
        for piece in slices(batches, "text"):
            keys, grams = [], []
            for _, s in shingle_sets(_text(piece), n_words):
                keys.append(_digest(s)[0])
                grams.append(s.view(np.int64))
            if keys:
                ends = np.concatenate(([0], np.cumsum([len(g) for g in grams])))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))], names=["set1", "n", "grams"])

    return run


class Tree:
    """A signature tree over sets: levels[0] are the sets, a node of the next level has FANOUT nodes of the one below.

    Each level: bits (OR of the bitmaps below), least and most (sizes), slack (shingles that fall on a bit another one of the
    same set has, most of any set below), low and high (labels below).
    """

    def __init__(self, grams: list[np.ndarray], labels: np.ndarray, width: int):
        shift, self.grams = np.uint64(64 - width), grams
        bits = np.zeros((len(grams), 1 << (width - 6)), dtype=np.uint64)
        sizes = np.array([len(g) for g in grams])
        at = np.concatenate(grams) >> shift
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(grams)), sizes), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        level = (bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64), labels, labels)
        self.levels = [level]
        while len(level[0]) > 1:
            heads = np.arange(0, len(level[0]), FANOUT)
            level = tuple(f.reduceat(x, heads, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the level below, and the position in nodes that each belongs to."""
        first = nodes * FANOUT
        n = np.minimum(FANOUT, len(self.levels[level - 1][0]) - first)
        owner = np.repeat(np.arange(len(nodes)), n)
        return first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs (i of level a, j of level b) can hold a link between sets of different labels: by size ranges, then by the largest possible overlap."""
    ok = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    ok &= ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
    k = np.flatnonzero(ok)
    for part in np.array_split(k, max(1, len(k) * a[0].shape[1] // 1_000_000)):
        x, y = i[part], j[part]
        most = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1).astype(np.int64) + np.minimum(a[3][x], b[3][y])
        # an overlap o needs 100 o >= percent * (|x| + |y| - o)
        ok[part] = (100 + percent) * most >= percent * (a[1][x] + b[1][y])
    return ok


def tree_join(left: Tree, right: Tree | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets of two trees (or within one): a spanning set of those that join labels not joined before."""
    right_tree = right or left
    top_a, top_b = len(left.levels) - 1, len(right_tree.levels) - 1
    i = j = np.zeros(1, dtype=np.int64)
    while top_a or top_b:
        if top_a >= top_b and top_a:
            i, owner = left.children(top_a, i)
            j, top_a = j[owner], top_a - 1
        else:
            j, owner = right_tree.children(top_b, j)
            i, top_b = i[owner], top_b - 1
        if right is None and top_a == top_b:
            keep = i <= j
            i, j = i[keep], j[keep]
        ok = possible(left.levels[top_a], i, right_tree.levels[top_b], j, percent)
        i, j = i[ok], j[ok]
    if right is None:
        i, j = i[i < j], j[i < j]
    a, b = left.levels[0], right_tree.levels[0]
    # join labels as links are found, so that sets linked already are not verified again
    names, code = np.unique(np.concatenate([a[4], b[4]]), return_inverse=True)
    la, lb, label = code[: len(a[4])], code[len(a[4]) :], np.arange(len(names))
    out, order = [], np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cut = np.flatnonzero(np.diff(i)) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True):
        if s == e:
            continue
        x, rest = int(i[s]), j[s:e]
        while len(rest := rest[label[lb[rest]] != label[la[x]]]):
            y, rest = int(rest[0]), rest[1:]
            if _linked(left.grams[x], right_tree.grams[y], percent):
                out.append((x, y))
                label[label == label[lb[y]]] = label[la[x]]
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _join_group(percent: int):
    """A group's rows: side 0 (both sides at once) or 1 and 2, set1, label, grams."""

    def run(group: pa.Table) -> pa.Table:
        side, key, label = (group[c].to_numpy() for c in ("side", "set1", "label"))
        grams = _grams(group)
        width = int(min(16, max(9, np.ceil(np.log2(4 * max(1, np.mean([len(g) for g in grams])))))))
        trees, keys = [], []
        for s in (0, 1, 2):
            own = np.flatnonzero(side == s)
            if len(own):
                first = np.array([grams[k][0] for k in own])
                own = own[np.lexsort((first, label[own]))] if s else own[np.argsort(first, kind="stable")]
                trees.append(Tree([grams[k] for k in own], label[own], width))
                keys.append(key[own])
        if side[0] and len(trees) < 2:
            links = []
        else:
            links = tree_join(trees[0], trees[1] if len(trees) > 1 else None, percent)
        return pa.table({"a": pa.array([int(keys[0][x]) for x, _ in links], pa.int64()), "b": pa.array([int(keys[-1][y]) for _, y in links], pa.int64())})

    return run


_NODE = "list bigint, block bigint, bits binary, least bigint, most bigint, slack bigint, low bigint, high bigint"


def _grams(group: pa.Table) -> list[np.ndarray]:
    flat = group["grams"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _root_node(width: int):
    """The root node of a block's tree, as a row."""

    def run(group: pa.Table) -> pa.Table:
        bits, *rest = Tree(_grams(group), group["label"].to_numpy(), width).levels[-1]
        row = [group["list"][0].as_py(), group["block"][0].as_py(), bits[0].tobytes(), *(int(x[0]) for x in rest)]
        return pa.table([pa.array([x]) for x in row], names=[c.split()[0] for c in _NODE.split(", ")])

    return run


def _node_pairs(percent: int):
    """Pairs of blocks (block <= other) of two tiles, or of one, whose root nodes can hold a link."""

    def level(group: pa.Table, own: np.ndarray) -> tuple:
        bits = np.frombuffer(b"".join(group["bits"].take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1)
        return bits, *(group[c].to_numpy()[own] for c in ("least", "most", "slack", "low", "high"))

    def run(group: pa.Table) -> pa.Table:
        side, block = group["side"].to_numpy(), group["block"].to_numpy()
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
        if not side[0]:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            ok = possible(level(group, left), i, level(group, right), j, percent)
            i, j = i[ok], j[ok]
        x, y = block[left[i]], block[right[j]]
        return pa.table({"list": pa.array(np.full(len(x), group["list"][0].as_py()), pa.int64()), "block": pa.array(np.minimum(x, y), pa.int64()), "other": pa.array(np.maximum(x, y), pa.int64())})

    return run


def _tokens(sets: DataFrame, percent: int) -> DataFrame:
    """set1, n, of, nth, df, token: of the smallest shingles of each set, those that other sets have there too, in the order of rarity, but for the last ones that any partner's tokens make up for."""
    t = f"((n * {percent} + 99) div 100)"
    k = f"least({t}, 1 + {t} div {TOKEN_SPREAD})"
    grams = sets.select("set1", "n", F.explode(F.expr(f"slice(grams, 1, cast(n - {t} + {k} as int))")).alias("token"))
    common = saved(grams.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    chosen = grams.join(common, "token").groupBy("set1", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    chosen = chosen.withColumn("own", F.expr(f"slice(own, 1, cast(greatest(0, size(own) - {k} + 1) as int))"))
    return saved(chosen.select("set1", "n", F.size("own").alias("of"), F.posexplode("own").alias("nth", "t")).select("set1", "n", "of", "nth", "t.df", "t.token"), "tokens")


def _joined(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links by trees: each (list, block, other) is a group, of one block (side 0) or of two (sides 1 and 2)."""
    return sets.select("set1", "grams").join(small_side(placed, MOST_ROWS), "set1").groupBy("list", "block", "other").applyInArrow(_join_group(percent), "a bigint, b bigint")


def _row_key(id_col: str, text: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text."""
    i, t = F.col(id_col).cast("long"), F.col(text).cast("string")
    return F.xxhash64(i.isNull(), i, t), F.xxhash64(t, F.length(t), i, i.isNull())


def links(docs: DataFrame, id_col: str, text: str, n_words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scan (id, n, set1, set2, row1, row2), a spanning set of the links (a, b: sets) and the sets' first ids (set1, rep, copies)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    keyed = rows.withColumns(dict(zip(("row1", "row2"), _row_key("id", "text"), strict=True)))
    scan = saved(keyed.mapInArrow(_scan(n_words), "id bigint, n bigint, set1 bigint, set2 bigint, row1 bigint, row2 bigint"), "shingle-scan")
    unique = saved(scan.where("n > 0").groupBy("set1", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "shingle-sets")
    total, n_sets = unique.agg(F.sum("n"), F.count("*")).first()
    buckets = max(1, round((total or 0) / 2 / BUCKET_SHINGLES))
    shared = rows.mapInArrow(_postings(n_words, buckets, percent), "bucket int, shingles binary, sets binary").groupBy("bucket").applyInArrow(_shared(max(1, n_sets // PART_SETS)), "part int, sets binary, counts binary")
    t = f"(n * {percent} + 99) div 100"
    able = saved(shared.groupBy("part").applyInArrow(_sums, "set1 bigint, shared bigint").join(unique, "set1").where(f"shared >= least({t}, 1 + {t} div {SPREAD})").select("set1", "rep"), "linkable")
    able = small_side(able, MOST_ROWS)
    texts = rows.join(able.select("rep").distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.mapInArrow(_sets(n_words), "set1 bigint, n bigint, grams array<bigint>")
    sets = saved(sets.join(able.select("set1"), "set1", "left_semi"), "linkable-sets")
    if sets.count() > able.count():  # rows that share the smallest id of a set
        sets = saved(sets.dropDuplicates(["set1"]), "linkable-sets")

    tokens = _tokens(sets, percent)
    first = tokens.groupBy("token").agg(F.min("set1").alias("b"))
    near = _graph.components(tokens.join(first, "token").select(F.col("set1").alias("a"), "b"))
    sized = near.join(small_side(saved(near.groupBy("root").agg(F.count("*").alias("size")), "candidate-sizes"), MOST_ROWS), "root")
    placed = saved(sized.select(F.col("node").alias("set1"), F.col("root").alias("list"), "size"), "candidates")
    found = saved(_joined(placed.where(F.col("size") <= BLOCK).select("list", "set1", F.col("set1").alias("label"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("side")), sets, percent), "links-in-blocks")

    large = saved(tokens.join(placed.where(F.col("size") > BLOCK), "set1"), "large-candidates")
    if large.limit(1).count():
        found = found.unionByName(_large(large, sets, percent))
    return scan, found, unique


def _large(tokens: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of candidates that don't fit a block: first by blocks that share a token, then by the pairs of blocks that can still have a link."""
    # three tokens of each set: the rarest, the middle and the most common one of its prefix; long lists in blocks by a hash of the set
    which = F.when(F.col("nth") == F.col("of") - 1, 2).when(F.col("nth") == 0, 0).otherwise(1)
    lists = tokens.where("nth = 0 or nth = of - 1 or nth = of div 2").select(F.xxhash64("token", which).alias("list"), "set1").distinct()
    length = lists.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    block = F.pmod(F.xxhash64("list", "set1"), F.ceil(F.col("length") / (BLOCK // 2)).cast("long"))
    found = saved(_joined(saved(lists.join(length, "list").select("list", "set1", F.col("set1").alias("label"), block.alias("block"), block.alias("other"), F.lit(0).alias("side")), "token-lists"), sets, percent), "links-by-token")

    roots = _graph.components(found)
    labelled = saved(tokens.join(roots.withColumnRenamed("node", "set1"), "set1", "left").select("token", "list", "set1", "n", F.coalesce("root", "set1").alias("label")), "tokens-labelled")
    open_ = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rest = saved(labelled.join(saved(open_, "open-tokens"), "token").select("list", "set1", "n", "label").distinct(), "open-sets")
    # Blocks: a label with many sets fills blocks of its own; sets of small labels are together by size.
    sizes = saved(rest.groupBy("list", "label").agg(F.count("*").alias("own")), "label-sizes")
    total = sizes.groupBy("list").agg(F.sum("own").alias("length"))
    parts = F.ceil(F.col("length") / (BLOCK // 2)).cast("long")
    alone = F.xxhash64(F.lit("label"), "label", F.pmod(F.xxhash64("set1"), F.ceil(F.col("own") / BLOCK).cast("long")))
    shared = F.xxhash64(F.lit("size"), F.floor(F.log("n") / 0.1), F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), parts.cast("double") / 8).cast("long")))
    blocks = saved(rest.join(sizes, ["list", "label"]).join(total, "list").withColumn("block", F.when(F.col("own") > BLOCK // 4, alone).otherwise(shared)).select("list", "set1", "n", "label", "block"), "blocks")
    mean = rest.agg(F.avg("n")).first()[0] or 1.0
    width = int(np.clip(np.ceil(np.log2(16 * mean)), 12, 18))
    nodes = saved(sets.select("set1", "grams").join(small_side(blocks, MOST_ROWS), "set1").groupBy("list", "block").applyInArrow(_root_node(width), _NODE), "block-nodes")
    tiles = nodes.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    nodes = nodes.join(small_side(saved(tiles, "tile-counts"), MOST_ROWS), "list").withColumn("tile", F.pmod(F.xxhash64("block"), "tiles"))
    # a node goes to its tile's pairs: with itself (side 0), as the lower one (1), as the higher one (2)
    sides = F.expr("transform(sequence(0L, tiles - 1), t -> named_struct('low', least(tile, t), 'high', greatest(tile, t), 'side', if(t = tile, 0, if(tile < t, 1, 2))))")
    meeting = nodes.withColumn("p", F.explode(sides)).select("list", "block", "bits", "least", "most", "slack", "low", "high", F.col("p.low").alias("tile1"), F.col("p.high").alias("tile2"), "p.side")
    pairs = saved(meeting.groupBy("list", "tile1", "tile2").applyInArrow(_node_pairs(percent), "list bigint, block bigint, other bigint"), "block-pairs")
    side = F.when(F.col("block") == F.col("other"), 0).otherwise(1)
    left = blocks.join(pairs, ["list", "block"]).withColumn("side", side)
    right = blocks.withColumnRenamed("block", "other").join(pairs.where("block < other"), ["list", "other"]).withColumn("side", F.lit(2))
    more = _joined(saved(left.unionByName(right).select("list", "set1", "label", "block", "other", "side"), "sides"), sets, percent)
    return found.unionByName(saved(more, "links-by-block"))


def _labelled(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """set1, root and component_id (the smallest id) of the sets whose component has two rows or more."""
    named = unique.select("set1", "rep", "copies").join(_graph.components(pairs).withColumnRenamed("node", "set1"), "set1", "left").withColumn("root", F.coalesce("root", "set1"))
    named = saved(named.select("set1", "root", "rep", "copies"), "named-sets")
    first = saved(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members")).where("members > 1"), "first-ids")
    return named.join(small_side(first, MOST_ROWS), "root").select("set1", "root", "component_id")


def components_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (the smallest id that links reach)."""
    scan, pairs, unique = links(docs, id_col, text, n_words, percent)
    labels = _labelled(pairs, unique).drop("root").withColumn("_found", F.lit(True))
    label = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("id"))
    return scan.join(labels, "set1", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of docs, with all their columns, of which one row for each component stays: the one with the smallest id, then the smallest text.

    Components are of sets, so unrelated texts that share an id, or have none, all stay, and so do texts without words.
    """
    scan, pairs, unique = links(docs, id_col, text, n_words, percent)
    members = scan.join(_labelled(pairs, unique), "set1").select("root", F.col("id").eqNullSafe(F.col("component_id")).alias("first"), "row1", "row2")
    members = saved(members, "components-of")
    several = members.where("first").groupBy("root").agg(F.count("*").alias("rows")).where("rows > 1").select("root")
    tied = saved(members.where("first").join(several, "root").select("root", "row1", "row2").distinct(), "tied")
    gone = saved(members.where("not first").select("row1", "row2").unionByName(tied.select("row1", "row2")).distinct(), "duplicates")
    row1, row2 = _row_key(id_col, text)
    keyed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), row1.alias("_row1"), row2.alias("_row2"))

    def same(keys: DataFrame) -> tuple[DataFrame, Column]:
        keys = keys.withColumnsRenamed({"row1": "_own1", "row2": "_own2", "root": "_root"})
        return small_side(keys), (F.col("_row1") == F.col("_own1")) & (F.col("_row2") == F.col("_own2"))

    kept = keyed.join(*same(gone), "left_anti").select("_row")
    if tied.limit(1).count():  # rows that share the smallest id of their component
        nth = F.row_number().over(Window.partitionBy("_root").orderBy("_text"))
        kept = kept.unionByName(keyed.join(*same(tied)).withColumn("_nth", nth).where("_nth = 1").select("_row"))
    return kept.select("_row.*")
