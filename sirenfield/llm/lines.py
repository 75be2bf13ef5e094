"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, keep_where, n_words, stage, text_of

MIN_LINES = 3
#: a shorter run goes as well if it has so many words
MIN_WORDS = 50


def _name(*parts: Column) -> tuple[Column, Column]:
    """128-bit name of a sequence: two hashes with different seeds."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _ahead(column: str, n: int) -> Column:
    """The column's value ``n`` lines further in the same document, null where that line is not there any more."""
    w = Window.partitionBy("doc_id", "h").orderBy("line").rangeBetween(n, n)
    return F.max(column).over(w)


def _repeated(names: DataFrame) -> DataFrame:
    """The positions whose name occurs twice or more, with the ``first`` place that has it; a unique suffix cannot be part of
    a repeat and leaves the sort.

    Counts and first places are combined before the shuffle, and a name that a third of all lines bear is dealt over all tasks.
    """
    place = F.struct("doc_id", "h", "line")
    often = names.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    return join_counted(names, stage(often, "names"), ["r1", "r2"]).drop("n")


def positions(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(doc_id, h, line, r1, r2): one row per line that has a word; ``line`` counts those from 0.

    ``counted`` adds the words of the line as ``own`` and, for a window of one line, ``w``.

    ``h`` names the text, so that rows with one doc_id and different texts stay apart; equal rows are one document.
    """
    text = text_of()
    kept = F.filter(
        F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))
    )
    r1, r2 = _name(F.col("l"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(kept).alias("line", "l"))
    words = [n_words(F.col("l")).alias(c) for c in ("own", "w")] if counted else []
    return rows.select("doc_id", "h", "line", r1.alias("r1"), r2.alias("r2"), *words).distinct()


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Lines where a window of ``min_lines`` lines starts that occurs more than once, and where it does so first: (doc_id, h,
    line, size, first).

    The windows are the intervals of the suffix array whose longest common prefix reaches ``min_lines``. Each round doubles
    the depth: the name of a suffix at depth 2d is made of its name at d and that of the suffix d lines on. Suffixes with
    a name of their own drop out before the next round. The last round joins two overlapping names for the exact depth;
    nothing deeper changes which lines are repeated.

    With ``min_words`` shorter windows of so many words count too; then each round adds one line, so that none is passed over.
    """
    counted = min_words is not None
    now, depth = stage(_repeated(positions(docs, counted)), "suffixes"), 1
    shorter = []
    while depth < min_lines:
        if counted:
            shorter.append(now.where(F.col("w") >= min_words).select("doc_id", "h", "line", F.lit(depth).alias("size"), "first"))
        step = 1 if counted else min(depth, min_lines - depth)
        words = [_ahead("w", step).alias("nw"), "own"] if counted else []
        both = now.select("doc_id", "h", "line", "r1", "r2", _ahead("r1", step).alias("n1"), _ahead("r2", step).alias("n2"), *words)
        r1, r2 = _name("r1", "r2", "n1", "n2")
        words = ["own", (F.col("own") + F.col("nw")).alias("w")] if counted else []
        joined = both.where("n1 is not null").select("doc_id", "h", "line", r1.alias("r1"), r2.alias("r2"), *words)
        now, depth = stage(_repeated(joined), "suffixes"), depth + step
    found = now.select("doc_id", "h", "line", F.lit(min_lines).alias("size"), "first")
    for more in shorter:
        found = found.union(more)
    return found


def later_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Per document with any: (doc_id, h, gone: its lines covered by a window that starts earlier, n_runs).

    Earlier: a smaller doc_id (null first, then by text hash), or an earlier line of the same document.
    """
    windows = repeated_windows(docs, min_lines, min_words)
    later = windows.where(F.struct("doc_id", "h", "line") > F.col("first")).select("doc_id", "h", "line", "size")
    covered = later.select("doc_id", "h", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line")).distinct()
    gone = covered.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    begins = F.filter("gone", lambda x, k: ~F.coalesce(F.get("gone", k - 1) == x - 1, F.lit(False)))
    return gone.withColumn("n_runs", F.size(begins))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """One row per row: ``row`` (all its columns), kept_text, n_lines, n_removed, n_runs.

    Lines without a word stay and do not count. Null text counts as empty. A doc_id of another type is read as an integer.
    Repeated rows give repeated results; columns beside doc_id and text only pass through inside ``row``.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_h"))
    gone = later_lines(docs, min_lines, min_words).select(F.col("doc_id").alias("_gid"), F.col("h").alias("_gh"), "gone", "n_runs")
    both = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    split = both.withColumn("lines", F.split(text, "\n"))
    worded = F.filter(
        F.transform("lines", lambda x, i: F.when(F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), i)), lambda i: i.isNotNull()
    )
    split = split.withColumn("worded", worded)
    dropped = F.transform("gone", lambda n: F.get("worded", n))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped)
    cut = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return split.select(
        "row", F.when(F.col("gone").isNull(), text).otherwise(cut).alias("kept_text"), F.size("worded").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
    )


def without_later_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of runs of ``min_lines`` lines or ``min_words`` words, with the shorter texts and n_chars, where that column is there; rows that lose every word go."""
    cut = keep_where(dedup_lines(docs, min_lines, min_words), (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
