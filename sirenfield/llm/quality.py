"""Quality rules: counts of a text and a hashed n-gram likelihood ratio, by DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_where, let, stage, text_of, words_of

#: buckets at least; their number follows the distinct n-grams, see ``_buckets_for``
BUCKETS = 512
#: buckets for each unit of the square root of the number of distinct n-grams
PER_ROOT = 4
#: words in the longest n-grams; the shorter ones count as well
ORDER = 2
#: weights that are put in order together, before these runs are
RUN = 4_096
#: trusted documents with fewer words say nothing about the threshold
LEAST_WORDS = 50
#: share of the trusted documents that may fall under the threshold
TRUSTED_LOST = 0.002
#: cells that a range of scores is cut into to find one of them by its place
CELLS = 4_096
#: numbers of 64 marks that are broadcast at most, 42 MB; beyond, Spark chooses the join
MOST_MARKS = 1 << 20
_SYMBOLS = "#*$%&|<>"


def _windows(hashes: Column) -> Column:
    """64-bit names of the 3-word windows, from the hashes of the words."""
    return F.transform(
        F.sequence(F.lit(2), F.size(hashes) - 1), lambda i: F.xxhash64(F.get(hashes, i - 2), F.get(hashes, i - 1), F.get(hashes, i))
    )


_PLACES = 20  # low bits of a packed window that hold its place


def _repeated(names: Column) -> Column:
    """Places of the windows whose name occurs twice or more, ascending."""
    low = F.lit((1 << _PLACES) - 1).cast("long")
    # name and place in one number, so that a sort of plain numbers brings equal windows together
    packed = F.sort_array(F.transform(names, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

    def alike(x: Column, y: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(y), _PLACES) == 0

    close = let(packed, lambda all_: F.filter(all_, lambda x, k: alike(x, F.get(all_, k - 1)) | alike(x, F.get(all_, k + 1))))
    few = F.sort_array(F.transform(close, lambda x: x.bitwiseAND(low).cast("int")))
    pairs = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    many = let(pairs, lambda all_: F.filter(all_, lambda x, k: (F.get(all_, k - 1)["h"] == x["h"]) | (F.get(all_, k + 1)["h"] == x["h"])))
    return F.when(F.size(names) < (1 << _PLACES), few).otherwise(F.sort_array(F.transform(many, lambda x: x["i"])))


def _covered(names: Column) -> Column:
    """Words inside windows whose name occurs twice or more: each adds three, less those the one before it has counted."""
    return F.aggregate(
        _repeated(names), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["p"])).alias("n"), i.alias("p")),
        lambda s: s["n"],
    )


def measured(docs: DataFrame) -> DataFrame:
    """One row per row: ``row`` (all its columns), doc_id, hashes of the words and the counts.

    Null or blank text has no words: every count is zero but n_symbols, which counts characters. Repeated rows count each
    for itself; other columns only pass through inside ``row``, so their names cannot clash.
    """
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), text_of().alias("text"))
    base = base.withColumn("words", words_of(F.col("text")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    count = F.size("words")
    base = base.withColumn("hashes", _hashes(F.col("words")))
    base = base.withColumn("names", F.when(count >= 3, _windows(F.col("hashes"))))
    symbols = sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit(""))) for c in _SYMBOLS)
    single = F.col("names").isNull() | (F.size(F.array_distinct("names")) == F.size("names"))
    return base.select(
        "row", "doc_id", "hashes", count.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(single, 0).otherwise(_covered(F.col("names"))).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _names(hashes: Column) -> Column:
    """Half of each word's hash: what is written of a text, and what its n-grams are made of."""
    return F.transform(hashes, lambda h: F.shiftright(h, 32).cast("int"))


def _n_grams(names: Column, order: int) -> Column:
    """64-bit names of the text's n-grams of one to ``order`` words: n, n - 1, ... of them for n words."""
    parts = [names.cast("array<bigint>")]
    for k in range(1, order):
        left = F.greatest(F.size(names) - k, F.lit(0))
        parts.append(F.zip_with(F.slice(parts[-1], F.lit(1), left), F.slice(names, F.lit(k + 1), left), lambda a, b: F.xxhash64(a, b)))
    return F.concat(*parts)


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets).cast("long"))


def _grams(hashes: Column, buckets: int, order: int = ORDER) -> Column:
    """Buckets of the text's n-grams of one to ``order`` words, from the hashes of its words."""
    return let(_names(hashes), lambda names: F.transform(_n_grams(names, order), lambda g: _bucket(g, buckets).cast("int")))


def _buckets_for(distinct: int) -> int:
    """Number of buckets for so many distinct n-grams: a power of two that grows with their square root.

    In proportion, a bucket would never hold more than a few n-grams: its weight would speak for the very documents that
    were counted, so trusted ones would score above others like them, and the weights of a large corpus would not fit a task.
    """
    return max(BUCKETS, 1 << math.ceil(math.log2(PER_ROOT * math.sqrt(max(distinct, 1)))))


class Ratio:
    """Log-likelihood ratio of each hashed n-gram, in the one row of ``table``, and the least score a document needs (None: no
    trusted rows).
    """

    def __init__(self, table: DataFrame, buckets: int, threshold: float | None, order: int = ORDER):
        self.table, self.buckets, self.threshold, self.order = table, buckets, threshold, order

    @property
    def weights(self) -> list[float]:
        """All weights, brought to the driver."""
        return self.table.first()["weights"]

    def scored(self, rows: DataFrame, names: Column, n: Column, name: str) -> DataFrame:
        """``rows`` with the mean weight of the n-grams of the ``n`` words ``names``, so that length does not count; null without
        words. The table is a subquery that Spark puts where ``_weights`` stands: named once, it is copied into no row.
        """
        weight = lambda g: F.get(F.col("_weights"), _bucket(g, self.buckets))
        total = let(names, lambda w: F.aggregate(_n_grams(w, self.order), F.lit(0.0), lambda s, g: s + weight(g)))
        many = sum(F.greatest(n - k, F.lit(0)) for k in range(self.order))
        return rows.withColumn("_weights", self.table.scalar()).select(*rows.columns, F.when(n > 0, total / many).alias(name))

    def passes(self, score: Column) -> Column:
        if self.threshold is None:
            return F.lit(True)
        return F.coalesce(score >= F.lit(self.threshold), F.lit(False))


def _value_at(values: DataFrame, place: int) -> float:
    """Value of the column ``s`` at ``place`` (from 0) in ascending order. The range it lies in is cut into cells, counted in
    the tasks, until its cell holds one value: a round brings at most ``CELLS`` rows to the driver.
    """
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = values.where(F.col("s").between(low, high))
        cell = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * CELLS), F.lit(CELLS - 1))
        for r in sorted(inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def _percentile(values: DataFrame, share: float) -> float | None:
    """Spark's ``percentile`` of the column ``s`` without its buffer of all values; None where there are none."""
    values = stage(keep_where(values, F.col("s").isNotNull()), "scores")
    n = values.count()
    if not n:
        return None
    at = (n - 1) * share
    low, high = math.floor(at), math.ceil(at)
    first = _value_at(values, low)
    last = first if low == high else _value_at(values, high)
    return first if first == last else (high - at) * first + (at - low) * last


def _marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``rows``, written once, with ``known``: 1 where ``_id`` is among ``trusted``, else 0.

    The ids alone meet in a shuffle, each with the place of its row; the answer comes back as one bit per row, 64 of them
    in a number, and up to ``MOST_MARKS`` numbers are broadcast. So the rows themselves, long as they may be, stay where
    they are, at any setting of Spark's threshold.
    """
    placed = stage(rows.withColumn("at", F.monotonically_increasing_id()), "grams")
    run, bit = F.shiftright("at", 6), F.col("at").bitwiseAND(F.lit(63)).cast("int")
    found = placed.select("_id", "at").join(trusted, "_id", "left_semi")
    marks = stage(found.groupBy(run.alias("run")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "trusted")
    marks = F.broadcast(marks) if marks.count() <= MOST_MARKS else marks
    known = F.coalesce(F.getbit("bits", bit), F.lit(0)).cast("int")
    return placed.withColumn("run", run).join(marks, "run", "left").select(*rows.columns, known.alias("known"))


def _weights(counts: DataFrame, buckets: int, smooth: float, n: int, t: int) -> DataFrame:
    """One row: the weights of all buckets in order, from the counts ``n`` and ``t`` of those that occur."""
    every = counts.sparkSession.range(buckets).toDF("b").join(counts, "b", "left")
    target, corpus = ((F.coalesce(c, F.lit(0)) + smooth) / F.lit(total + smooth * buckets) for c, total in (("t", t), ("n", n)))
    runs = every.withColumn("w", F.log(target) - F.log(corpus)).groupBy(F.floor(F.col("b") / RUN).alias("run"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("b", "w")))["w"].alias("w"))
    return stage(runs.agg(F.flatten(F.sort_array(F.collect_list(F.struct("run", "w")))["w"]).alias("weights")), "weights")


def fit_ratio(
    docs: DataFrame, labels: DataFrame, buckets: int | None = None, lost: float = TRUSTED_LOST, smooth: float = 1.0, order: int = ORDER,
) -> Ratio:
    """Multinomials of the trusted documents (``labels.quality`` = 1) and of the whole corpus over hashed n-grams of one to
    ``order`` words, in as many ``buckets`` as the distinct ones ask for unless their number is given.

    The counts run over every document and every trusted one; the words of all are written once, as 32 bits each. The
    weights are one row of a table that grows with the buckets. The threshold is the score under which the share ``lost``
    of the trusted documents falls, so it follows from the data and not from a draw.
    """
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    base = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text"))
    marked = _marked(base.select("_id", _names(_hashes(words_of(F.col("text")))).alias("grams")), trusted)
    grams = marked.select(F.explode(_n_grams(F.col("grams"), order)).alias("g"), "known")
    n, distinct = grams.agg(F.count(F.lit(1)), F.approx_count_distinct("g")).first()
    buckets = buckets or _buckets_for(distinct)
    pairs = grams.select(_bucket(F.col("g"), buckets).alias("b"), "known")
    counts = stage(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("known").alias("t")), "counts")
    t = counts.agg(F.sum("t")).first()[0]
    if not t:
        return Ratio(docs.sparkSession.range(1).select(F.array_repeat(F.lit(0.0), buckets).alias("weights")), buckets, None, order)
    ratio = Ratio(_weights(counts, buckets, smooth, n, t), buckets, None, order)
    known = ratio.scored(marked.where("known = 1"), F.col("grams"), F.size("grams"), "s")
    ratio.threshold = _percentile(known.where(F.size("grams") >= LEAST_WORDS).select("s"), lost)
    return ratio


def judge(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """:func:`measured` plus score and kept: the base rules, then the ratio."""
    rows = measured(docs)
    rows = ratio.scored(rows, _names(F.col("hashes")), F.size("hashes"), "score")
    return rows.withColumn("kept", ~F.col("base_failed") & ratio.passes(F.col("score")))


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    return keep_where(judge(docs, fit_ratio(docs, labels, **options)), F.col("kept")).select("row.*")
