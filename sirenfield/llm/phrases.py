"""Phrase collocations: suffix pointers sorted by multikey three-way quicksort, one depth after another.

A suffix is the run of words that starts at a word and ends with its piece. For every depth the tasks sort the suffix
pointers of what they hold by their first words; the sizes of the equal partitions are their counts. The sizes then go by
the hash of lang and leading words to the task that owns them, at most one row per chunk and partition, and partitions
under the least count are abandoned: the next depth starts only from pointers whose words lie in what is left. A Bloom
filter of what is left goes to the tasks. It only saves work: what passes it wrongly is abandoned by its own count, so
a filter at its largest size changes no result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

#: bytes of text that a task sorts at once; sizes of several chunks are added up, so it sets memory and nothing else
CHUNK = 8 << 20
#: bits of a filter per partition, and the largest filter (16 MB)
BITS_EACH, MAX_BITS = 16, 1 << 27
ROWS_OUT = 1 << 17
#: bytes of text that are split into words at a time, and windows that are looked up at a time
SPLIT, LOOKED_UP = 1 << 20, 1 << 18
# lower case for A-Z, one blank, one mark between pieces; a mark is never part of a word
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_MARK = b"."


def quicksort(words: np.ndarray, pointers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions suffix pointers by their first ``depth`` words; returns one pointer of every equal partition and its size.

    Three-way: a partition is split by its pivot's word into less, equal and greater, and equal goes on with the next
    word. All partitions of a round are split together, so a round is a few passes over what is not yet settled. A
    partition is settled when all words are equal or it holds one pointer.
    """
    heads, counts = [pointers[:0]], [np.zeros(0, np.int64)]
    held, sizes = pointers, np.array([len(pointers)] if len(pointers) else [], np.int64)
    at = np.zeros(len(sizes), pointers.dtype)
    while len(held):
        first = np.cumsum(sizes) - sizes
        key = words[held + np.repeat(at, sizes)]
        pivot = np.repeat(key[first + sizes // 2], sizes)
        sides = [key < pivot, key == pivot]
        sides.append(~(sides[0] | sides[1]))
        parts = []
        for side, deeper in zip(sides, (0, 1, 0)):
            n = np.add.reduceat(side, first, dtype=np.int64)
            parts.append((held[side], n[n > 0], at[n > 0] + deeper))
        held, sizes, at = (np.concatenate(x) for x in zip(*parts))
        settled = (sizes == 1) | (at == depth)
        heads.append(held[(np.cumsum(sizes) - sizes)[settled]])
        counts.append(sizes[settled])
        held, sizes, at = held[np.repeat(~settled, sizes)], sizes[~settled], at[~settled]
    return np.concatenate(heads), np.concatenate(counts)


def _turn(h, i: int):
    """Rotates 64-bit numbers by 9 times the word's place, so that the order of words counts."""
    k = np.uint64(9 * i % 64)
    return (h << k) | (h >> (np.uint64(64) - k)) if k else h


def _name(words: list[Column]) -> Column:
    """The same for columns of hashed words."""
    out = words[0]
    for i, h in enumerate(words[1:], 1):
        k = 9 * i % 64
        out = out.bitwiseXOR(F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k)) if k else h)
    return out


class Filter:
    """Bloom filter with two places per name; ``bits`` is a power of two."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, np.uint64(64 * len(slots) - 1)

    def holds(self, names: np.ndarray) -> np.ndarray:
        found = np.ones(len(names), bool)
        for h in (names, names >> np.uint64(32)):
            at = h & self.mask
            found &= (self.slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _filter(counted: DataFrame, depth: int, n: int) -> Filter:
    bits = 1 << 12
    while bits < min(BITS_EACH * n, MAX_BITS):
        bits *= 2
    words = F.split("phrase", " ")
    h = _name([F.xxhash64("lang", F.get(words, F.lit(i))) for i in range(depth)])
    places = counted.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("at"))
    slots = places.groupBy(F.shiftright("at", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
    )
    got = slots.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(out)


def _slices(folded: bytes, depth: int) -> Iterator[tuple[bytes, bytes]]:
    """Parts of about ``CHUNK`` bytes that end between words, each with the next words that its last suffixes reach into."""
    at = 0
    while len(folded) - at > CHUNK:
        cut = folded.find(b" ", at + CHUNK)
        if cut < 0:
            break
        yield folded[at:cut], b" ".join(folded[cut:].split(None, depth - 1)[: depth - 1])
        at = cut
    yield folded[at:], b""


def _split(folded: bytes) -> Iterator[list[bytes]]:
    """The words of every ``SPLIT`` bytes or a little more; a cut lies between words."""
    at = 0
    while at < len(folded):
        cut = folded.find(b" ", at + SPLIT)
        cut = len(folded) if cut < 0 else cut
        yield folded[at:cut].split()
        at = cut


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _partitions(lang: str, own: bytes, ahead: bytes, depth: int, known: Filter | None) -> Iterator[pa.RecordBatch]:
    """Equal partitions of the suffixes that start in ``own``, to ``depth``."""
    ids = _Ids({_MARK: 0})
    words = [np.fromiter(map(ids.__getitem__, listed), np.int32, len(listed)) for listed in _split(own)]
    n_own = sum(map(len, words))
    words.append(np.fromiter(map(ids.__getitem__, listed := ahead.split()), np.int32, len(listed)))
    words = np.concatenate(words)
    vocabulary = list(ids)
    if depth == 1:
        sizes = np.bincount(words[:n_own], minlength=len(vocabulary))
        sizes[0], vocabulary[0] = sizes[1:].sum(), b""  # the empty phrase counts all words
        phrases = pa.array(vocabulary, pa.binary()).cast(pa.string())
    else:
        seed = xxhash.xxh64_intdigest(lang, 42)
        hashed = np.array([xxhash.xxh64_intdigest(w, seed) for w in vocabulary], np.uint64)
        n = len(words) - depth + 1
        if n <= 0:
            return
        alive = np.ones(n, bool)
        inside = words != 0
        for i in range(depth):
            alive &= inside[i : n + i]
        span = depth - 1  # both ends of a window must be in what the last depth left
        if span == 1:
            left = known.holds(hashed)[words]
        else:
            left = np.empty(n + 1, bool)
            for at in range(0, n + 1, LOOKED_UP):
                end = min(at + LOOKED_UP, n + 1)
                names = hashed[words[at:end]]
                for i in range(1, span):
                    names ^= _turn(hashed[words[at + i : end + i]], i)
                left[at:end] = known.holds(names)
        for i in range(2) if span > 1 else range(depth):
            alive &= left[i : n + i]
        heads, sizes = quicksort(words, np.flatnonzero(alive[:n_own]).astype(np.int32), depth)
        named = pa.array(vocabulary, pa.binary()).cast(pa.string())
    for at in range(0, len(sizes), ROWS_OUT):
        if depth == 1:
            part = phrases.slice(at, ROWS_OUT)
        else:
            some = heads[at : at + ROWS_OUT]
            part = pc.binary_join_element_wise(*[named.take(pa.array(words[some + i])) for i in range(depth)], " ")
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(sizes[at : at + ROWS_OUT].astype(np.int64))], ["lang", "phrase", "size"])


def _sizes(depth: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        n_held: dict[str, int] = defaultdict(int)
        filter_ = known.value if known else None

        def sort(lang: str) -> Iterator[pa.RecordBatch]:
            folded = b" . ".join(held.pop(lang))
            n_held.pop(lang)
            for own, ahead in _slices(folded, depth):
                yield from _partitions(lang, own, ahead, depth, filter_)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                folded = text.as_buffer().to_pybytes().translate(_FOLD).replace(b".", b" . ")
                held[lang].append(folded)
                n_held[lang] += len(folded)
                if n_held[lang] >= CHUNK:
                    yield from sort(lang)
                elif sum(n_held.values()) >= 2 * CHUNK:
                    yield from sort(max(n_held, key=n_held.get))
        for lang in list(held):
            yield from sort(lang)

    return run


def count_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> list[DataFrame]:
    """For every depth a written table (lang, phrase, a) of the phrases with ``min_count`` occurrences or more.

    The first one also has, for each lang, the empty phrase: the number of all words.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    found, known = [], None
    for depth in range(1, max_words + 1):
        sizes = rows.mapInArrow(_sizes(depth, known), "lang string, phrase string, size long")
        a = sizes.groupBy("lang", "phrase").agg(F.sum("size").alias("a"))
        found.append(stage(a.where((F.col("a") >= min_count) | (F.col("phrase") == "")), f"phrases{depth}"))
        if depth < max_words:
            kept = found[-1].where(F.col("phrase") != "")
            known = docs.sparkSession.sparkContext.broadcast(_filter(kept, depth, kept.count()))
    return found


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, covered_percent: int = 50, top: int = 2000
) -> DataFrame:
    """The best phrases of 2 to ``max_words`` words of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase is scored by its weakest cut: floor(1,000,000 * a * a / (l * r)) with l and r the counts of both parts, in
    exact 38-digit arithmetic (counts under 10^16); ties go to the shortest first part. Phrases of which a longer candidate
    has ``covered_percent`` of the occurrences or more go. Null text: empty. Null lang: ``und``. Rows of equal content
    count each; empty tables and texts without words give no rows; other columns are ignored.
    """
    found = count_phrases(docs, max_words, min_count)
    words = F.split("phrase", " ")
    counts = found[0].where(F.col("phrase") != "")
    candidates = None
    for depth, table in enumerate(found[1:], 2):
        counts = counts.unionByName(table)
        sized = table.withColumn("words", words).withColumn("depth", F.lit(depth))
        candidates = sized if candidates is None else candidates.unionByName(sized)
    cuts = candidates.select("lang", "phrase", "a", "words", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("depth") - F.col("k")), " ").alias("rest"),
    )
    l = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    r = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    exact = [F.col(c).cast("decimal(16,0)").alias(c) for c in ("a", "l", "r")]
    scored = (
        cuts.join(l, ["lang", "first"]).join(r, ["lang", "rest"])
        .select("lang", "phrase", "k", F.struct("l", "r").alias("parts"), *exact)
        .withColumn("score", F.expr("(a * a * cast(1000000 as decimal(7,0))) div (l * r)"))
        .groupBy("lang", "phrase", F.col("a").cast("long").alias("a"))
        .agg(F.min(F.struct("score", "k", "parts")).alias("cut"))
    )
    within = candidates.where(F.col("depth") > 2).select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("depth") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")
        )))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered_percent) * F.col("a"))
    ).select("lang", "phrase", "a", "cut.parts.l", "cut.parts.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of every share of a lang, of every 256 shares, then of those: a task sees its share or 16 x top rows
    near = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(4096)))
    for shares in (4096, 16):
        first = Window.partitionBy("lang", "share").orderBy(*best)
        near = near.withColumn("share", F.col("share") % shares).withColumn("i", F.row_number().over(first)).where(F.col("i") <= top)
    n = found[0].where(F.col("phrase") == "").select("lang", F.col("a").alias("n"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
