"""Rows of a table told by their id and text, and how to change some of them without moving the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packets import filter_of, might_hold
from .store import fresh

#: Stands for a null doc_id: one value like any other, before all of them.
NEVER = -(1 << 63)


def key_of(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns doc_id and tie, a hash of the text (null: empty), which tell rows apart; equal rows share them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NEVER)).alias("doc_id"), F.xxhash64(text).alias("tie")]


def met(docs: DataFrame, keys: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows that keys cannot hold, the other rows beside what keys carry for them, names of doc_id, tie and the carried columns there).

    keys: kept table (doc_id, tie, carried columns), one row for each key. The first rows neither
    move nor go to Python; of the others those without a key have nulls. Both keep the order and names of the columns of docs.
    """
    id_, tie, *names = fresh(docs, "id", "tie", *carried)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(*columns, *(c.alias(n) for c, n in zip(key_of(), (id_, tie), strict=True)))
    hit = might_hold(filter_of(keys), id_, tie)
    of = keys.select(F.col("doc_id").alias(id_), F.col("tie").alias(tie), *(F.col(c).alias(n) for c, n in zip(carried, names, strict=True)))
    return own.where(~hit).select(*columns), own.where(hit).join(of, [id_, tie], "left"), [id_, tie, *names]
