"""Expectations: every check yields a (check, passed, detail) row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..dimensions import local_table

REPORT = "check_name string, passed boolean, detail string"


def required_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Schema check; reads no data."""
    missing = [c for c in columns if c not in df.columns]
    detail = "missing: " + ", ".join(missing) if missing else "all present"
    return local_table(df.sparkSession, [(f"{name}: required columns", not missing, detail)], REPORT)


def measures(rules: dict[str, tuple[Column, Column]]) -> list[Column]:
    return [m.cast("double").alias(rule) for rule, (m, _) in rules.items()]


def _judged(long: DataFrame, name: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, value) rows to (check, passed, detail)."""
    passed = reduce(lambda acc, kv: acc.when(F.col("rule") == kv[0], kv[1][1]), rules.items(), F)
    return long.select(
        F.concat(F.lit(f"{name}: "), "rule").alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.concat(F.lit("value="), F.coalesce(F.round("value", 4).cast("string"), F.lit("null"))).alias("detail"),
    )


def expect(df: DataFrame, name: str, **rules: tuple[Column, Column]) -> DataFrame:
    """Several checks over one table in a single aggregation.

    Each rule is (measured aggregate, condition over that measure written with
    the column name ``value``).
    """
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("value")) for r in rules])
    return _judged(df.agg(*measures(rules)).select(F.inline(rows)), name, rules)


class Watch:
    """The checks of :func:`expect`, measured while the table is written: no second scan.

    ``over(df)`` is the frame to write; ``report()`` judges what was measured, once the write is done. Measures must not
    be distinct aggregates.
    """

    def __init__(self, name: str, **rules: tuple[Column, Column]):
        self.name, self.rules, self.seen = name, rules, Observation(name)

    def over(self, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        return df.observe(self.seen, *measures(self.rules)) if self.rules else df

    def report(self) -> DataFrame:
        values = self.seen.get if self.rules else {}
        return _judged(local_table(self.spark, [(r, values[r]) for r in self.rules], "rule string, value double"), self.name, self.rules)


def distinct(column: Column) -> Column:
    """Number of different values of a column that has few by its nature (zones, boroughs, bands)."""
    return F.size(F.collect_set(column))


def share(cond: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(cond.cast("int"))


def violations(cond: Column) -> Column:
    """Count of rows that break the condition (NULL counts as broken)."""
    return F.sum(F.when(F.coalesce(cond, F.lit(False)), 0).otherwise(1))


def missing_keys(expected: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Expected keys that the table lacks."""
    return expected.select(*columns).subtract(found.select(*columns))


def key_sets(expected: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """Subset and equality of two key sets, from one count of each difference."""
    e = expected.select(column).distinct().withColumn("e", F.lit(1))
    f = found.select(column).distinct().withColumn("f", F.lit(1))
    both = e.join(f, column, "full").agg(
        F.count(F.when(F.col("f").isNull(), 1)).alias("lacking"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("surplus"),
    )
    checks = F.array(
        F.struct(F.lit("contains all expected").alias("rule"), (F.col("lacking") == 0).alias("passed"), F.col("lacking").alias("n")),
        F.struct(F.lit("equals expected").alias("rule"), (F.col("lacking") + F.col("surplus") == 0).alias("passed"), (F.col("lacking") + F.col("surplus")).alias("n")),
    )
    return both.select(F.inline(checks)).select(
        F.concat(F.lit(f"{name}: "), "rule").alias("check_name"), "passed",
        F.concat(F.lit("value="), F.col("n").cast("string")).alias("detail"),
    )


def report(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def rmse_tier(rmse: Column) -> Column:
    return F.when(rmse > 6.0, "poor").when(rmse > 4.0, "acceptable").otherwise("target met")


def all_passed(report_table: DataFrame) -> DataFrame:
    return report_table.agg(
        F.count("*").alias("checks"), F.sum(F.col("passed").cast("int")).alias("passed"),
        F.coalesce(F.min("passed"), F.lit(True)).alias("ok"),
    )


def zone_keys(spark: SparkSession, column: str) -> DataFrame:
    from ..dimensions import zones

    return zones(spark).select(F.col("zone").alias(column))
