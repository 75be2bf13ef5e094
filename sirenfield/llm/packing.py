"""Best-fit packing into bins of several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, text_of

CAPACITIES = (512, 1024, 2048, 4096)
PER_SHARD = 20_000


def bin_cost(capacity: int) -> float:
    """Cost of one bin: its tokens, a share for attention that grows with the square, and a fixed part."""
    return capacity * (1 + capacity / 65_536) + 32


def pack(lengths: list[int], capacities: tuple[int, ...], cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Best fit of ``lengths``, in their order: (bin of each, offset of each, capacity of each bin).

    A piece goes to the open bin that it leaves the least room in (of equals the first opened). If none has room, a bin is
    opened whose size costs least for each token it can still expect, which is all that is left at most. At the end every
    bin shrinks to the least permitted size of its contents.
    """
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    sizes: list[int] = []
    used: list[int] = []
    where, offsets = [], []
    left = sum(lengths)
    for n in lengths:
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            b = len(sizes)
            sizes.append(room)
            used.append(0)
        where.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if room > n:
            insort(rooms, (room - n, b))
    return where, offsets, [min(c for c in capacities if c >= u) for u in used]


def cheapest(lengths: list[int], capacities: tuple[int, ...], cost=bin_cost):
    """The cheapest packing over every choice of the largest length offered to pieces that fit it."""
    tried = []
    for k in range(len(capacities)):
        few = capacities[: k + 1]
        fits = [i for i, n in enumerate(lengths) if n <= few[-1]]
        rest = [i for i, n in enumerate(lengths) if n > few[-1]]
        where, offsets, sizes = [0] * len(lengths), [0] * len(lengths), []
        # longer pieces come first, so that their bins take short ones as well
        for part, allowed in ((rest, capacities), (fits, few)):
            w, o, s = pack([lengths[i] for i in part], allowed, cost) if part else ([], [], [])
            for i, b, at in zip(part, w, o):
                where[i], offsets[i] = b + len(sizes), at
            sizes = sizes + s
        tried.append((sum(map(cost, sizes)), where, offsets, sizes))
    return min(tried, key=lambda x: x[0])[1:]


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """(doc_id, copy, piece, start, n): documents over ``largest`` words are cut there; none is cut elsewhere."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(text_of()).alias("size"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / largest) - 1, F.lit(0)).cast("long"))
    return sized.select("doc_id", "size", F.explode(cuts).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("size") - F.col("piece") * largest).cast("long").alias("n")
    )


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_words, bin_id, bin_size, bin_offset.

    Pieces are dealt by a hash over shards of about ``per_shard`` pieces, as many as the data need; each shard packs its
    own in order of falling length. A source or a document with a third of all words spreads over all shards. A document
    without words is one piece of no length, and its bin columns are null. Repeated rows are packed as often as they occur.
    """
    capacities = tuple(sorted(capacities))
    cut = pieces(docs, capacities[-1])
    shards = max(1, -(-cut.count() // per_shard))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "doc_id", "piece"], ascending=[False, True, True], na_position="first")
        where, offsets, sizes = cheapest(rows["n"].tolist(), capacities)
        first = int(rows["shard"].iloc[0]) << 32
        return rows.assign(
            n_words=rows["n"], bin_id=[first + b for b in where], bin_size=[sizes[b] for b in where], bin_offset=offsets
        )[["doc_id", "piece", "start", "n_words", "bin_id", "bin_size", "bin_offset"]]

    schema = "doc_id long, piece long, start long, n_words long, bin_id long, bin_size long, bin_offset long"
    dealt = cut.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(pack_shard, schema)
    null = F.lit(None).cast("long")
    empty = cut.where("n <= 0").select("doc_id", "piece", "start", F.col("n").alias("n_words"), null.alias("bin_id"), null.alias("bin_size"), null.alias("bin_offset"))
    return packed.unionByName(empty)
