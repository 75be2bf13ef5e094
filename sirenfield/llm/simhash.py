"""SimHash near-dedup: fingerprints, pivot distance tables, components.

Documents with equal fingerprints are one node. Nodes that can link share a bucket, and within a bucket a table of Hamming
distances to reference fingerprints (pivots) discards pairs: two fingerprints within t bits differ by at most t in their
distance to any pivot. What is left is verified bit by bit.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of
from .components import components

SEED = 42
PIVOTS = 16
#: a bucket over this size is not compared as it is: its members are dealt out again by finer buckets
HOT = 20_000
_ALL_PAIRS = 16
_CHUNK = 1 << 16


def shingles(text: str, k: int) -> list[bytes]:
    """k-word shingles of the lower-cased (A-Z) text, repeats included; fewer words: the whole sequence; none: none."""
    words = text.encode().lower().split()  # bytes.split() parts at \x20 and \x09-\x0D, bytes.lower() maps A-Z alone
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    return [whole[a:b] for a, b in zip(starts, ends[k - 1 :].tolist())]


def majority(hashes: np.ndarray) -> int:
    """64 bits: those set in over half of ``hashes``; zero of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _prints(k: int, seeds: tuple[int, ...], as_set: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[list[int]] = [[] for _ in seeds]
            sets = []
            for text in batch.column("text"):
                parts = shingles(text.as_py(), k)
                if as_set:
                    parts = list(dict.fromkeys(parts))
                for own, seed in zip(prints, seeds):
                    hashes = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], np.uint64)
                    own.append(majority(hashes))
                sets.append(xxhash.xxh3_64_intdigest(np.sort(hashes).tobytes()) if as_set else 0)
            columns = [pa.array(np.array(p, np.uint64).view(np.int64)) for p in prints]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(np.array(sets, np.uint64).view(np.int64))],
                names=["doc_id", *[f"w{i}" for i in range(len(seeds))], "same"],
            )

    return run


def fingerprints(docs: DataFrame, k: int, seeds: tuple[int, ...] = (SEED,), as_set: bool = False) -> DataFrame:
    """(doc_id, w0.., same): 64 bits per seed; ``as_set`` counts each shingle once and names the set in ``same``.

    Null text is an empty one; repeated rows count each for themselves; other columns are not read.
    """
    words = ", ".join(f"w{i} long" for i in range(len(seeds)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_prints(k, seeds, as_set), f"doc_id long, {words}, same long")


def block_masks(blocks: int, equal: int) -> list[tuple[int, ...]]:
    """Masks over 64 bits for every choice of ``equal`` out of ``blocks`` parts.

    Fingerprints that differ in at most blocks - equal bits agree on at least one of them: no pair is lost.
    """
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [(sum(part[i] for i in c),) for c in combinations(range(blocks), equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, n_words: int, masks: list[tuple[int, ...]]) -> DataFrame:
    keys = [F.xxhash64(F.lit(i), *[F.col(f"w{j}").bitwiseAND(F.lit(_signed(m))) for j, m in enumerate(mask) if m]) for i, mask in enumerate(masks)]
    return nodes.select("node", *[f"w{j}" for j in range(n_words)], F.explode(F.array(*keys)).alias("key"))


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (rows of words) to every pivot."""
    return np.bitwise_count(prints[:, None, :] ^ pivots[None, :, :]).sum(axis=2, dtype=np.int16)


def _pairs_within(prints, table, left, right, t):
    """Pairs of rows within t bits, with their distance: by the pivot table first, then bit by bit."""
    near = np.abs(table[left, 0] - table[right, 0]) <= t
    left, right = left[near], right[near]
    near = np.abs(table[left] - table[right]).max(axis=1, initial=0) <= t
    left, right = left[near], right[near]
    d = np.bitwise_count(prints[left] ^ prints[right]).sum(axis=1, dtype=np.int64)
    return left[d <= t], right[d <= t]


def forest(prints: np.ndarray, table: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Least spanning forest of the graph of pairs within t bits: m - 1 links at most, the same components."""
    left = np.arange(1, len(prints))
    best, parent, at, out = np.full(len(prints), 1 << 14), np.zeros(len(prints), np.int64), 0, []
    while len(left):
        near = left[np.abs(table[left] - table[at]).max(axis=1) <= t]
        d = np.bitwise_count(prints[near] ^ prints[at]).sum(axis=1, dtype=np.int64)
        less = d < best[near]
        best[near[less]], parent[near[less]] = d[less], at
        k = int(np.argmin(best[left]))
        at = int(left[k])
        if best[at] <= t:
            out.append((int(parent[at]), at))
        left = np.delete(left, k)
    return out


def _compare(n_words: int, t: int, pivots: np.ndarray, hot: int | None):
    """Rows sorted by key -> links (a, b), and of a bucket over ``hot`` each member as (a, null)."""
    names = [f"w{j}" for j in range(n_words)]

    def links(keys, nodes, prints):
        """Links of whole buckets."""
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        rows = np.repeat(sizes >= 2, sizes)
        if not rows.any():
            return
        nodes, prints, sizes = nodes[rows], prints[rows], sizes[sizes >= 2]
        starts, table = np.cumsum(sizes) - sizes, pivot_table(prints, pivots)
        for m in range(2, _ALL_PAIRS + 1):
            own = starts[sizes == m]
            if len(own):
                i, j = np.triu_indices(m, 1)
                a, b = _pairs_within(prints, table, (own[:, None] + i).ravel(), (own[:, None] + j).ravel(), t)
                yield nodes[a], nodes[b]
        for s, m in zip(starts[sizes > _ALL_PAIRS].tolist(), sizes[sizes > _ALL_PAIRS].tolist()):
            found = np.array(forest(prints[s : s + m], table[s : s + m], t), np.int64).reshape(-1, 2) + s
            yield nodes[found[:, 0]], nodes[found[:, 1]]

    def batch_of(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the last, still open bucket
        over = None  # key of a bucket found too large, whose rows pass through
        for batch in batches:
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            prints = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in names], axis=1)
            if over is not None:
                n = int(np.searchsorted(keys, over, side="right"))
                if n:
                    yield batch_of(nodes[:n], None)
                    keys, nodes, prints = keys[n:], nodes[n:], prints[n:]
                if not len(keys):
                    continue
                over = None
            if held:
                keys, nodes, prints = (np.concatenate(x) for x in zip(*held, (keys, nodes, prints)))
                held = []
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            done = keys[:last], nodes[:last], prints[:last]
            rest = keys[last:], nodes[last:], prints[last:]
            if hot is not None and len(done[0]):
                _, inverse, count = np.unique(done[0], return_inverse=True, return_counts=True)
                large = count[inverse] > hot
                if large.any():
                    yield batch_of(done[1][large], None)
                    done = tuple(x[~large] for x in done)
            if len(done[0]):
                for a, b in links(*done):
                    yield batch_of(a, b)
            if hot is not None and len(rest[0]) > hot:
                over = rest[0][0]
                yield batch_of(rest[1], None)
            else:
                held = [rest]
        if held:
            for a, b in links(*held[0]):
                yield batch_of(a, b)

    return run


def near_links(
    nodes: DataFrame, n_words: int, t: int, masks: list[tuple[int, ...]], finer: list[tuple[int, ...]], n_pivots: int = PIVOTS,
    hot: int = HOT,
) -> DataFrame:
    """Links (a, b) between ``nodes`` (node long, w0..) whose fingerprints differ in at most ``t`` bits.

    A bucket of up to 16 gives all its links, a larger one a least spanning forest of them, so components are those of all
    links while no group emits all its pairs. Members of a bucket over ``hot`` go to the buckets of ``finer`` instead,
    which hold more bits and spread them over more tasks.
    """
    draw = np.random.default_rng(SEED)
    pivots = draw.integers(0, 1 << 64, (n_pivots, n_words), np.uint64)

    def compare(rows, by, limit):
        dealt = _keyed(rows, n_words, by).repartition("key").sortWithinPartitions("key", "node")
        return stage(dealt.mapInArrow(_compare(n_words, t, pivots, limit), "a long, b long"), "pairs")

    found = compare(nodes, masks, hot)
    links, crowded = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("node")).distinct()
    if crowded.isEmpty():
        return links
    return links.union(compare(nodes.join(crowded, "node"), finer, None))


def simhash_groups(docs: DataFrame, k: int = 4, t: int = 4) -> DataFrame:
    """(doc_id, w0, component_id) of every row: least doc_id reachable over fingerprints within ``t`` (at most 4) bits.

    A null doc_id links nothing by itself; its row takes the component of its fingerprint, or null.
    """
    prints = stage(fingerprints(docs, k).drop("same"), "prints")
    nodes = prints.where("doc_id is not null").groupBy("w0").agg(F.min("doc_id").alias("node"))
    links = near_links(nodes, 1, t, block_masks(t + 3, 3), block_masks(t + 4, 4))
    labels = components(links)
    named = nodes.join(labels, "node", "left").select("w0", F.coalesce("label", "node").alias("component_id"))
    return prints.join(named, "w0", "left").select("doc_id", "w0", "component_id")


def drop_near(docs: DataFrame, k: int = 4, t: int = 4) -> DataFrame:
    """``docs`` without near duplicates: of every group of linked fingerprints one row stays, the one of least doc_id.

    Rows are judged each by its own text: of several texts under the least doc_id the one of least hash stays, repeated
    rows count once, rows without a doc_id stay only where a group has no other. Texts without words are one group.
    """
    own = F.xxhash64(text_of()).alias("_h")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), own)
    kind = "row struct<_h: bigint, doc_id: bigint>, w0 long"
    prints = stage(rows.select(F.struct("_h", "doc_id").alias("row"), text_of().alias("text")).mapInArrow(_row_prints(k), kind), "prints")
    # a fingerprint is a node by itself: rows of one doc_id may have several
    nodes = prints.select("w0").distinct().withColumn("node", F.col("w0"))
    labels = components(near_links(nodes, 1, t, block_masks(t + 3, 3), block_masks(t + 4, 4))).select(F.col("node").alias("w0"), "label")
    grouped = prints.join(labels, "w0", "left").withColumn("label", F.coalesce("label", "w0"))
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.col("row._h").alias("h"))
    kept = stage(grouped.groupBy("label").agg(F.min(order).alias("least")).select("least.doc_id", "least.h"), "kept")
    named = docs.withColumn("_h", F.xxhash64(text_of()))
    same = named["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (named["_h"] == kept["h"])
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_h"]).drop("_h")


def _row_prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [majority(np.array([xxhash.xxh64_intdigest(p, SEED) for p in shingles(text.as_py(), k)], np.uint64)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.array(own, np.uint64).view(np.int64))], names=["row", "w0"])

    return run
