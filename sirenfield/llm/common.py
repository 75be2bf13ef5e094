"""What the operators of this subpackage share: words, sizes, staging in the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of ``text`` in order; none for an empty one. A split at one character costs a third of one at a pattern."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, which also cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by_worker(key: tuple, make: Callable):
    """What ``make`` gave first in this Python worker: Spark runs many tasks in one, and what they learned need not be
    learned again. Functions that travel with a job bring modules of their own, hence a place beside them.
    """
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` that has one row per key, and in ``count`` how many rows bear it.

    Keys of over a thousandth of these rows, at most a thousand of them therefore, go to every task; their rows are dealt
    by a hash of themselves instead of their key, so that no key gathers in one task. ``keys[0]`` is a long.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    brought = F.struct(*[c for c in table.columns if c not in keys])
    often = F.col(count) > total / 1000
    marked = rows.join(F.broadcast(table.where(often).select(*keys, brought.alias("_hot"))), keys, "left")
    hot = F.col("_hot").isNotNull()
    dealt = marked.withColumn("_key", F.when(hot, F.xxhash64(*[F.col(c) for c in rows.columns])).otherwise(F.col(keys[0])))
    cold = table.where(~often).select(F.col(keys[0]).alias("_key"), *keys[1:], brought.alias("_cold"))
    both = dealt.join(cold, ["_key", *keys[1:]], "left").where(hot | F.col("_cold").isNotNull())
    return both.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_b")).select(*rows.columns, "_b.*")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter over computed columns that stays above them: pushed down, it would repeat every expression it is made of."""
    return df.withColumn("_row_no", F.monotonically_increasing_id()).where(condition & (F.col("_row_no") >= 0)).drop("_row_no")
