"""Rows by id, size-checked key filters and small frames shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm.text import give_back_memory
from spanloom.session import staged

#: Key tables up to this many rows are sent to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: The field of a row's key that holds its id.
ROW_ID = "__id"


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns are in ``keys``, a written table.

    ``keys`` holds numbers. It is counted first: up to ``BROADCAST_ROWS`` rows it is broadcast and
    ``df`` is not shuffled; above, Spark joins by shuffle and splits skewed partitions.
    """
    return df.join(sized(keys), list(on), "left_semi")


def sized(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of numbers, marked for broadcast if its rows are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def unique_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``text_col`` with one row per id.

    Of rows that share an id the one with the smallest text stays (a null text is smallest). Rows
    without an id have no place in results by id and are left out.
    """
    df = df.select(id_col, text_col).where(F.col(id_col).isNotNull())
    repeated = staged(df.groupBy(id_col).count().where("count > 1").select(id_col), "repeated-ids")
    if repeated.isEmpty():
        return df
    again = keep_keys(df, repeated, [id_col]).groupBy(id_col).agg(
        F.min(F.struct(F.col(text_col).alias("t"))).getField("t").alias(text_col)
    )
    return df.join(sized(repeated), id_col, "left_anti").unionByName(again)


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart: their id, and where some id has several rows, id and a hash of the text.

    Rows that agree in both are judged alike. The key of a row without id is null.
    """
    known = df.where(F.col(id_col).isNotNull())
    if staged(known.groupBy(id_col).count().where("count > 1").select(id_col), "repeated-ids").isEmpty():
        return F.col(id_col)
    text = F.col(text_col)
    return F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias(ROW_ID), F.xxhash64(text, text.isNull()).alias("text")))


def order_of(df: DataFrame, key: str, column: str) -> Column:
    """The id in a :func:`row_key` ``column``; ``df`` has such keys in its column ``key``."""
    kind = df.schema[key].dataType
    return F.col(column).getField(ROW_ID) if isinstance(kind, StructType) and ROW_ID in kind.names else F.col(column)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to several.

    Each task ends by giving back the memory it no longer needs (:func:`text.give_back_memory`).
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        give_back_memory()

    return df.mapInArrow(run, schema)
