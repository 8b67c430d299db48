"""Labelled texts to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import saved, small_side

PARTS = 16
#: Code points of the labelled texts in sum, above which fewer of them are taken: the driver fits on what comes of them.
MAX_CHARS = 400_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None, id_col: str = "doc_id", text: str = "text", most_chars: int = MAX_CHARS) -> DataFrame:
    """text and label (0 or 1) of about `most` labelled rows, or of all if there are fewer, as a saved table.

    A hash of the id picks them evenly. If their texts have more than most_chars code points, a hash of the text picks as many
    of them as have about that; texts stay whole. where, over the labels' columns, says which rows may be learnt from. Null ids, labels
    and texts are left out.
    """
    rows = (labels if where is None else labels.where(where)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 31)) < int((1 << 31) * (most / n)))
    rows = saved(rows, "labelled-ids")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = saved(texts.join(small_side(rows), "_id").select("text", "label").repartition(PARTS), "labelled")
    chars = out.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > most_chars:
        out = saved(out.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < int((1 << 31) * (most_chars / chars))), "labelled-fewer")
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
