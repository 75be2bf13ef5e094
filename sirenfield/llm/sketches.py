"""Document fingerprints as invertible Bloom lookup sketches, by DataFrame functions only.

A sketch is an array of the cells that hold anything, sorted by cell: (cell, count, key, check). Each paragraph digest sits
in one cell of each of three parts of ``width`` cells. Sketches of one width subtract cell by cell; a cell of the difference
with count +-1 and a matching check gives up a digest, which is then taken out of its other cells, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of

WIDTH = 16
PARTS = 3
ROUNDS = 24
#: lines over so many characters are cut after full stops as well
LONG_LINE = 1_000
PER_BUCKET = 500
_CELLS = "array<struct<cell:int,count:int,key:bigint,check:bigint>>"


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs: lines that are not empty, long ones cut after full stops."""
    def cut(line: Column) -> Column:
        return F.when(F.length(line) > LONG_LINE, F.split(F.replace(line, F.lit(". "), F.lit(".\n")), "\n")).otherwise(F.array(line))

    parts = F.filter(F.flatten(F.transform(F.split(text, "\n"), cut)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(PARTS))


def _signed(keys: Column, count: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(count).alias("count")))


def _entries(items: Column, width: Column) -> Column:
    """The cells that ``items`` (key, count) fill: one per key and part."""
    def one(x: Column) -> Column:
        return F.array(*[
            F.struct(
                (F.pmod(F.xxhash64(x["key"], F.lit(j)), width) + j * width).cast("int").alias("cell"), x["count"].alias("count"),
                x["key"].alias("key"), _check(x["key"]).alias("check"),
            ) for j in range(PARTS)
        ])

    return F.flatten(F.transform(items, one))


def _merge(entries: Column) -> Column:
    """Adds up entries of the same cell; cells that come to nothing go."""
    def added(rows: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: ~F.coalesce(F.get(rows, i)["cell"] == F.get(rows, i - 1)["cell"], F.lit(False)))

        def cell(ends_: Column, end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(ends_, k - 1), F.lit(0))
            zero = F.struct(F.lit(0).alias("count"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

            def add(s: Column, x: Column) -> Column:
                return F.struct((s["count"] + x["count"]).alias("count"), s["key"].bitwiseXOR(x["key"]).alias("key"), s["check"].bitwiseXOR(x["check"]).alias("check"))

            # places, not a slice: a slice would copy the whole array for every cell
            return F.aggregate(
                F.sequence(start, end - 1), zero, lambda s, i: let(F.get(rows, i), lambda x: add(s, x)),
                lambda s: F.struct(F.get(rows, start)["cell"].alias("cell"), s["count"].alias("count"), s["key"].alias("key"), s["check"].alias("check")),
            )

        return F.when(F.size(rows) > 0, let(ends, lambda e: F.transform(e, lambda end, k: cell(e, end, k)))).otherwise(F.array().cast(_CELLS))

    full = let(F.sort_array(entries), added)
    return F.filter(full, lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def sketch(keys: Column, width: Column) -> Column:
    return _merge(_entries(_signed(keys, 1), width))


def subtract(left: Column, right: Column) -> Column:
    less = F.transform(right, lambda c: F.struct(c["cell"].alias("cell"), (-c["count"]).alias("count"), c["key"].alias("key"), c["check"].alias("check")))
    return _merge(F.concat(left, less))


def peel(cells: Column, width: Column) -> Column:
    """Digests in one of two sketches only, from their difference: array of (key, count: +1 left, -1 right); null if stuck."""
    def take(state: Column) -> Column:
        pure = F.filter(state["left"], lambda c: (F.abs(c["count"]) == 1) & (_check(c["key"]) == c["check"]))

        def got(cells_: Column) -> Column:
            # a digest alone in several cells comes out once
            return F.concat(*[
                _signed(F.array_distinct(F.transform(F.filter(cells_, lambda c: c["count"] == sign), lambda c: c["key"])), sign) for sign in (1, -1)
            ])

        def out(g: Column) -> Column:
            undo = _entries(F.transform(g, lambda x: F.struct(x["key"].alias("key"), (-x["count"]).alias("count"))), width)
            return F.struct(
                F.when(F.size(g) > 0, _merge(F.concat(state["left"], undo))).otherwise(state["left"]).alias("left"),
                F.concat(state["found"], g).alias("found"), (F.size(g) == 0).alias("over"),
            )

        return F.when(state["over"], state).otherwise(let(let(pure, got), out))

    start = F.struct(cells.alias("left"), F.array().cast("array<struct<key:bigint,count:int>>").alias("found"), F.lit(False).alias("over"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: take(s), lambda s: F.when(F.size(s["left"]) == 0, s["found"])
    )


def difference(left: Column, right: Column, first: int = WIDTH) -> Column:
    """Digests in one of two paragraph sets only, by sketches; a sketch that does not peel is made again, larger.

    First the width of the stored fingerprint; then one fit for all paragraphs of both texts, then 4 and 16 times that. The
    sets themselves are compared only if all four are stuck.
    """
    def at(width: Column) -> Column:
        return let(width, lambda w: let(subtract(sketch(left, w), sketch(right, w)), lambda d: peel(d, w)))

    enough = F.greatest(F.lit(2 * first), F.size(left) + F.size(right))
    plain = F.concat(
        _signed(F.array_except(left, right), 1), _signed(F.array_except(right, left), -1),
    )
    # no sketch gives up more digests than it has cells
    small = F.when(F.abs(F.size(left) - F.size(right)) <= PARTS * first, at(F.lit(first)))
    return F.coalesce(small, at(enough), at(4 * enough), at(16 * enough), plain)


def likeness(left: Column, right: Column) -> Column:
    """1 less the share of paragraphs that only one of the texts has; two texts without any are alike."""
    both = F.size(left) + F.size(right)
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - F.size(difference(left, right)) / both)


def fingerprint(keys: Column) -> Column:
    """The sketch of the stored width as text: cell, count, key and check in hex, cells joined by dots."""
    cells = sketch(keys, F.lit(WIDTH))
    return F.array_join(F.transform(cells, lambda c: F.concat_ws("-", F.hex(c["cell"].cast("long")), F.hex(c["count"].cast("long")), F.hex(c["key"]), F.hex(c["check"]))), ".")


def with_next(docs: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by (doc_id, text), after the last that of the first.

    doc_ids are cut into ranges of about ``per_bucket`` rows; each range also gets a copy of the row that starts the next
    one, so that one shuffle and a window in each range are enough. Null doc_ids come first. Null texts are empty. Repeated
    rows follow one another. A single row is its own successor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    step = max(1, -(-(high - low + 1) // max(1, -(-count // per_bucket))))
    rows = rows.withColumn("bucket", F.coalesce(F.floor((F.col("doc_id") - low) / step), F.lit(-1)).cast("long"))
    # the least row of each range; one row per range meets in the window below
    least = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    before = Window.orderBy("bucket")
    goes = least.select("bucket", "first_id", F.lag("bucket").over(before).alias("before"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    starts = rows.join(goes.withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    copies = starts.select(
        "doc_id", "text", F.coalesce("before", "last").alias("bucket"), F.lit(True).alias("copy"),
    )
    everything = rows.withColumn("copy", F.lit(False)).unionByName(copies)
    own = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return everything.withColumn("next_text", F.lead("text").over(own)).where(~F.col("copy")).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row; edited: the text whose
    last half is replaced by the start of the next document."""
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "text", "next_text")
    keyed = rows.select("doc_id", "n_chars", "edited", *[paragraphs(F.col(c)).alias(k) for c, k in (("text", "own"), ("edited", "new"), ("next_text", "next"))])
    return keyed.select(
        "doc_id", "n_chars", "edited", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
