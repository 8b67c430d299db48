"""Quality rules with cross-document line frequency, in native expressions only.

Each document gets the base figures of its own text. Its lines are normalised (A-Z in lower case, runs of white space as one
space, none at the ends) and hashed; for each host (source) the number of distinct documents with the line is counted. Lines
above the host's limit are removed, and documents of which too little is left are rejected.

Documents are distinct by their text: exact copies on a host count once, near copies count one by one. A line goes where more
than MAX_SHARE of the host's documents have it, and MIN_DOCUMENTS at least; a host of few documents so never loses a line.

Defined cases: null or empty text has no words, so it fails the base rule; a null source is a host of its own; rows that
repeat get the same verdict; an empty table gives an empty result; further columns are ignored by rate() and kept by
clean(), whatever their names. Lines without a word are neither counted nor removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import saved, small_side

SPACE = r"[\\x20\\x09-\\x0D]"
MAX_SHARE = 0.08
MIN_DOCUMENTS = 10
#: A document is rejected if less than this share of its words is left.
MIN_LEFT = 0.2
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(line: str) -> str:
    return f"translate(trim(regexp_replace({line}, '{SPACE}+', ' ')), '{_UPPER}', '{_LOWER}')"


def _keyed(docs: DataFrame, text: str, host: str) -> DataFrame:
    """The rows as _row, their text and host, and _k1 and _k2: rows with equal text and host have equal verdicts."""
    return docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("_host")).withColumns(
        {"_k1": F.expr("xxhash64(_host, _text)"), "_k2": F.expr("xxhash64(_text, length(_text), _host)")})


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base figures, base_failed, and _lines: hash and words of each line that has a word."""
    df = docs.withColumn("_whole", F.coalesce(F.col(text), F.lit(""))).withColumns({
        "_words": F.expr(f"filter(split(_whole, '{SPACE}+'), w -> w <> '')"),
        "_rows": F.expr(f"filter(split(_whole, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        "word_chars": F.expr("cast(length(translate(_whole, ' \\t\\n\\u000B\\u000C\\r', '')) as bigint)"),
        "n_symbols": F.expr("cast(length(_whole) - length(translate(_whole, '#*$%&|<>', '')) as bigint)"),
    })
    df = df.withColumns({
        "n_words": F.expr("cast(size(_words) as bigint)"),
        "n_dup_lines": F.expr("cast(size(_rows) - size(array_distinct(_rows)) as bigint)"),
        "_windows": F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(sequence(1, size(_words) - 2), i -> xxhash64(element_at(_words, i), element_at(_words, i + 1), element_at(_words, i + 2))))"),
        "_lines": F.expr(f"transform(transform(_rows, l -> {_normal('l')}), l -> named_struct('h', xxhash64(l), 'w', length(l) - length(replace(l, ' ', '')) + 1))"),
    })
    # only texts in which a window is found twice have their windows sorted
    df = df.withColumn("_sorted", F.expr("if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'p', i))))"))
    df = df.withColumn("_repeated", F.expr("sort_array(transform(filter(_sorted, (x, i) -> coalesce(get(_sorted, i - 1).h = x.h, false) or coalesce(get(_sorted, i + 1).h = x.h, false)), x -> x.p))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(_repeated, named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"))
    return df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_whole", "_words", "_rows", "_windows", "_sorted", "_repeated")


def _removals(rated: DataFrame, max_share: float, min_documents: int) -> DataFrame:
    """_k1, _k2, _removed (hashes of the lines above their host's limit) and _gone (their words), for texts that have such lines."""
    unique = saved(rated.groupBy("_k1", "_k2").agg(F.first(F.struct("_host", "_lines")).alias("d")).select("_k1", "_k2", "d.*"), "quality-texts")
    documents = unique.groupBy("_host").agg(F.count("*").alias("documents"))
    counts = unique.select("_host", F.explode(F.expr("array_distinct(transform(_lines, l -> l.h))")).alias("h")).groupBy("_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
    over = counts.join(small_side(saved(documents, "quality-hosts")), "_host").where(F.col("n") > F.col("documents") * max_share).select("_host", "h")
    lines = unique.select("_k1", "_k2", "_host", F.explode("_lines").alias("l")).select("_k1", "_k2", "_host", "l.h", "l.w")
    return lines.join(small_side(saved(over, "quality-over")), ["_host", "h"]).groupBy("_k1", "_k2").agg(F.collect_set("h").alias("_removed"), F.sum("w").alias("_gone"))


def _rated(docs: DataFrame, text: str, host: str, keep: list, max_share: float, min_documents: int) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(docs, text, host).select(*keep, "_text", "_host", "_k1", "_k2")
    rated = saved(figures(keyed, "_text").drop("_text"), "quality-figures")
    return rated, saved(_removals(rated, max_share, min_documents), "quality-removals")


def rate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_share: float = MAX_SHARE,
         min_documents: int = MIN_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of docs: id_col, the base figures, base_failed, removed_words and kept."""
    rated, removals = _rated(docs, text, host, [F.col("_row").getField(id_col).alias("_id")], max_share, min_documents)
    gone = F.coalesce(F.col("_gone"), F.lit(0)).cast("long")
    return rated.join(small_side(removals.select("_k1", "_k2", "_gone")), ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col), *FIGURES, "base_failed", gone.alias("removed_words"),
        (~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * min_left)).alias("kept"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = MAX_SHARE,
          min_documents: int = MIN_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are kept, with all their columns; lines above the limits are gone from their text (and n_chars, where there is one, counts the text as it is now)."""
    rated, removals = _rated(docs, text, host, [], max_share, min_documents)
    gone = F.coalesce(F.col("_gone"), F.lit(0))
    kept = ~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * min_left)
    # only texts that go or lose lines are joined
    changes = saved(rated.join(small_side(removals), ["_k1", "_k2"], "left").withColumn("_kept", kept).where("not _kept or _removed is not null")
                    .groupBy("_k1", "_k2").agg(F.first("_kept").alias("_kept"), F.first("_removed").alias("_removed")), "quality-changes")
    df = _keyed(docs, text, host).join(small_side(changes), ["_k1", "_k2"], "left").where("coalesce(_kept, true)")
    cut = F.expr(f"array_join(filter(split(_text, '\\n'), l -> not (l rlike '[^\\\\x20\\\\x09-\\\\x0D]') or not array_contains(_removed, xxhash64({_normal('l')}))), '\\n')")
    df = df.withColumn("_cut", F.when(F.col("_removed").isNotNull(), cut))
    new = {text: F.coalesce("_cut", F.col("_row").getField(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut").isNull(), F.col("_row").getField("n_chars")).otherwise(F.length("_cut")).cast(docs.schema["n_chars"].dataType)
    return df.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
