"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
ROWS_PER_BUCKET = 20_000


def water_fill(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """Targets of sources: ``sizes`` (source, source_size) -> plus weight and target.

    Sources in code point order, null last, take ``weights`` in turn and share ``budget`` (default: all sizes; at most
    ``max_epochs`` times them). A source stops at ``max_epochs`` times its size; what it leaves goes to the others by
    weight. Sorted by size over weight the capped sources are a prefix, so the level of the water is a running sum, not a
    loop. One row per source passes one task here, never a document.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")))
    rising = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) if budget is None else F.lit(int(budget)).cast("long")
    level = (total - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    lev = weighed.withColumn("_level", level)
    free = F.when(max_epochs * F.col("source_size") > F.col("_level") * F.col("weight"), F.col("_level"))
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lev = lev.withColumn("_water", F.first(free, ignorenulls=True).over(whole))
    cap = (max_epochs * F.col("source_size")).cast("double")
    return lev.withColumn("target", F.least(cap, F.coalesce(F.col("_water") * F.col("weight"), cap))).drop("_level", "_water")


def mix(
    docs: DataFrame, keep: list[str], weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET, budget: int | None = None,
) -> DataFrame:
    """``keep`` columns of every row, plus size, source_size, target, copies, taken (last five replace clashing names).

    A source is read floor(target / size) times whole; the rest is the start of a seeded order of its documents, up to
    the document whose middle passes the fractional target. The order is by md5 of seed and doc_id, so reruns agree, and
    the sum taken is within half a document of the target. The running sum has two steps, within buckets of the order and
    over bucket totals, so that a source with a third of all rows spreads over many tasks.

    Null text: size 0. Null source: a source of its own. Repeated rows: each is a row of its own. A source without words
    keeps each row once. Empty input: no rows.
    """
    rows = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_id"), F.col("source").alias("source"),
        n_words(text_of()).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
    )
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")
    rows = rows.withColumn("_bucket", place)
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sizes = totals.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = water_fill(sizes, weights, max_epochs, budget)
    prior = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(prior), F.lit(0))).drop("_sum")
    plan = start.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target")
    own = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("_id").asc_nulls_last(), "size")
    cum = rows.withColumn("_cum", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    both = cum.alias("r").join(
        plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._bucket") == F.col("p._bucket"))
    ).select("r.*", "p._start", "p.source_size", "p.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    part = F.col("target") - whole * F.col("source_size")
    extra = (F.col("source_size") > 0) & (part > 0) & (F.col("_start") + F.col("_cum") + F.col("size") / 2 <= part)
    copies = (whole + F.when(extra, 1).otherwise(0)).cast("long")
    new = {"size", "source_size", "target", "copies", "taken"}
    return both.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c not in new],
        "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns unchanged."""
    # one column holds the whole row, beside the three that the mix reads: no name of another can clash
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    taken = mix(whole, ["row"], **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
