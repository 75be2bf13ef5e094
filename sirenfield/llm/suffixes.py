"""Suffix dedup: repeated 100-byte strings by a depth-limited radix sort, most significant digit first.

Sorting a suffix at every byte would move a hundred times the corpus. So suffixes are first sorted by a digit that few of
them need to send: of the 24-byte strings in a window the one with the least hash is its anchor, and equal windows have equal
anchors at the same place. Pass 1 groups the windows by anchor, one row for the run of windows that share it, and drops what
is alone. Pass 2 sends the bytes of the surviving runs and sorts their windows, digit by digit, to a depth of 100 bytes; a
group of equal windows at that depth is a repeated string, and all but its first member are marked. Each pass drops groups
of one before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

DEPTH = 100
CORE = 24
DIGIT = 25
#: windows that one piece of a text holds, and bytes that are hashed at a time
PIECE = 1 << 22
#: an anchor this often in one batch is dealt to many tasks
HOT = 256
SALTS = 64
#: runs sorted at a time in one task
RUNS = 40_000
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hash of every k bytes, by doubling."""
    made, size, power = None, 0, 1
    block = data.astype(np.uint64) + np.uint64(0x51ED27)
    length, step = 1, _BASE
    while True:
        if k & length:
            # what is made so far, then a block of `length` behind it
            made = block if made is None else made[: len(block) - size] * np.uint64(step) + block[size:][: len(made)]
            size += length
        if length * 2 > k:
            return made
        block = block[:-length] * np.uint64(step) + block[length:]
        step = step * step % (1 << 64)
        length *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def _runs(data: np.ndarray, depth: int = DEPTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (hash of the anchor, its place, first window, number of windows)."""
    names = _mixed(_hashes(data, core))
    places = np.arange(len(names), dtype=np.uint64)
    # of equal hashes the leftmost counts; a piece is short enough for its places
    low = np.uint64((1 << 24) - 1)
    anchor = (_least((names & ~low) | places, depth - core + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return names[anchor[first]].view(np.int64), anchor[first], first, np.diff(np.concatenate([first, [len(anchor)]]))


def _documents(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, int, tuple]]:
    """Per document with a window, in pieces: row, number of the piece's first window, bytes, runs."""
    for row, text in enumerate(batch.column("text")):
        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
        for at in range(0, len(data) - depth + 1, PIECE):
            part = data[at : at + PIECE + depth - 1]
            yield row, at, part, _runs(part, depth)


def _record(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def _anchors(depth: int):
    """(doc_id, t, text) -> (h, salt, known, doc_id, t, run): one row per run.

    Rows of an anchor that is frequent in the batch are dealt by a salt and known to survive; one mark goes to salt 0 to
    tell the rest that the anchor is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rows, number, seen = [], [], [], {}
            for row, _, _, (names, *_) in _documents(batch, depth):
                first = seen.get(row, 0)
                seen[row] = first + len(names)
                h.append(names)
                rows.append(np.full(len(names), row))
                number.append(np.arange(first, first + len(names)))
            if not h:
                continue
            h, rows, number = np.concatenate(h), np.concatenate(rows), np.concatenate(number).astype(np.int32)
            values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = count[inverse] > HOT
            salt = np.where(hot, 1 + rows % (SALTS - 1), 0).astype(np.int32)
            marks = values[count > HOT]
            ids, t = batch.column("doc_id").to_numpy()[rows], batch.column("t").to_numpy()[rows]
            none = np.zeros(len(marks), np.int64)
            yield _record({
                "h": np.concatenate([marks, h]), "salt": np.concatenate([none, salt]).astype(np.int32),
                "known": np.concatenate([none - 1, hot]).astype(np.int32), "doc_id": np.concatenate([none, ids]),
                "t": np.concatenate([none, t]), "run": np.concatenate([none, number]).astype(np.int32),
            })

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, salt, known) -> (doc_id, t, run, hot) of the anchors that are not alone.

    Only the last row of a batch is held, whatever the size of a group.
    """
    held, last, hot_key = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("h").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)], axis=1)
        known = batch.column("known").to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        goes_on = last is not None and bool((key[0] == last).all())
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        marked = np.bincount(group, known == -1) > 0
        if goes_on:
            size[0] += 2 if held is None else 1
            marked[0] |= hot_key is not None
        hot = marked[group] | (known == 1)
        keep = ((size[group] > 1) | hot) & (known >= 0)
        out = {c: batch.column(c).to_numpy() for c in ("doc_id", "t", "run")}
        if held is not None and goes_on:
            yield _record({**{c: np.array([v], out[c].dtype) for c, v in held.items()}, "hot": np.array([bool(hot[0])])})
            held = None
        elif not goes_on:
            held = None
        # the last group may go on in the next batch: a single row of it waits
        if size[-1] == 1 and not hot[-1] and known[-1] >= 0:
            held = {c: out[c][-1] for c in out}
        last, hot_key = key[-1], True if marked[-1] else None
        if keep.any():
            yield _record({**{c: v[keep] for c, v in out.items()}, "hot": hot[keep]})


_CONTEXT = "h long, salt int, doc_id long, t long, lo long, n int, rel int, hot boolean, bytes binary"


def _contexts(depth: int):
    """(doc_id, t, text, runs, hots) -> bytes of the surviving runs; of equal ones in a batch the first, the others as marks.

    A mark is a row without bytes: all its ``n`` windows from ``lo`` on start earlier elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _CONTEXT.split(", ")}
            first: dict[tuple, int] = {}
            before: dict[int, int] = {}
            marks: list[tuple] = []
            ids, ts = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy()
            wanted: dict[int, tuple] = {}
            for row, at, data, (names, anchor, start, count) in _documents(batch, depth):
                if row not in wanted:
                    numbers = batch.column("runs")[row].values.to_numpy()
                    wanted[row] = numbers, batch.column("hots")[row].values.to_numpy(zero_copy_only=False)
                done = before.get(row, 0)
                before[row] = done + len(names)
                numbers, hots = wanted[row]
                own = (numbers >= done) & (numbers < done + len(names))
                whole = data.tobytes()
                for k, hot in zip((numbers[own] - done).tolist(), hots[own].tolist()):
                    s, n, h = int(start[k]), int(count[k]), int(names[k])
                    body = whole[s : s + n + depth - 1]
                    rel = int(anchor[k]) - s
                    place = (int(ids[row]), int(ts[row]), at + s)
                    same = first.get((rel, body))
                    if same is not None:
                        held = (out["doc_id"][same], out["t"][same], out["lo"][same])
                        if place < held:  # the earlier one stays
                            out["doc_id"][same], out["t"][same], out["lo"][same] = place
                        if place != held:  # equal places: a repeated row, which is the same document
                            marks.append((*max(place, held), n))
                        continue
                    first[rel, body] = len(out["h"])
                    salt = 1 + place[0] % (SALTS - 1) if hot else 0
                    for c, v in zip(out, (h, salt, *place, n, rel, hot, body)):
                        out[c].append(v)
            if out["h"]:
                yield pa.RecordBatch.from_pydict(out, schema=_schema(_CONTEXT))
            if marks:
                doc, t, lo, n = (np.array(x, np.int64) for x in zip(*sorted(set(marks))))
                # neighbours in one document are one mark
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (lo[1:] != lo[:-1] + n[:-1])])
                at = np.flatnonzero(new)
                count = np.add.reduceat(n, at).astype(np.int32)
                zero, m = np.zeros(len(at), np.int32), len(at)
                yield _record({
                    "h": doc[at] ^ lo[at], "salt": zero, "doc_id": doc[at], "t": t[at], "lo": lo[at], "n": count, "rel": zero,
                    "hot": np.zeros(m, bool), "bytes": pa.nulls(m, pa.binary()),
                })

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


def _radix(data: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows at ``place`` of ``data`` -> (their indices, group of equal ones), only those in groups of two or more.

    One pass per digit of the windows; groups of one leave after each. A name gives its low bits to the window's number, so
    that plain numbers are sorted; windows that share a name by chance are told apart by their bytes afterwards.
    """
    left, names = np.arange(len(place)), _hashes(data, digit)
    group = group.astype(np.int64)
    for at in range(0, depth, digit):
        key = _mixed(_mixed(group.astype(np.uint64) * np.uint64(_BASE)) + names[place[left] + at])
        if not len(key):
            break
        bits = len(key).bit_length()
        low = np.uint64((1 << bits) - 1)
        key = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
        left = left[(key & low).astype(np.int64)]
        key >>= np.uint64(bits)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        more = np.bincount(number, minlength=1)[number] > 1
        left, group = left[more], number[more]
        if not len(left):
            break
    return left, group


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether ``depth`` bytes, eight or more, are the same at both places; eight at a time, the last ones may overlap."""
    eight = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), 0, (1,))
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 17):
        part = slice(i, i + (1 << 17))
        for at in (*range(0, depth - 8, 8), depth - 8):
            out[part] &= eight[a[part] + at] == eight[b[part] + at]
    return out


_MARK = "doc_id long, t long, start long, n int, k1 long, k2 long"


def _sorted_runs(depth: int, digit: int):
    """Runs sorted by (h, salt) -> marks (doc_id, t, start, n, null, null), and of hot anchors the first of each window as
    (doc_id, t, start, 1, k1, k2) with its 128-bit name."""

    def resolve(rows: dict[str, np.ndarray], bodies: pa.Array, split: bool) -> Iterator[pa.RecordBatch]:
        """One set of whole groups; ``split``: part of a group that other tasks or rounds hold as well."""
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        data = np.frombuffer(bodies.buffers()[2], np.uint8)
        n = rows["n"].astype(np.int64)
        run = np.repeat(np.arange(len(n)), n)
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = offsets[run] + index
        rank = np.empty(len(n), np.int64)
        by_place = np.lexsort((rows["lo"], rows["t"], rows["doc_id"]))
        moved = [rows[c][by_place][1:] != rows[c][by_place][:-1] for c in ("lo", "t", "doc_id")]
        # rows of one place, from repeated rows of the table, rank alike
        rank[by_place] = np.concatenate([[0], np.cumsum(np.any(moved, axis=0))])
        _, group = np.unique(rows["h"], return_inverse=True)
        left, equal = _radix(data, place, group[run] * 1024 + rows["rel"][run] - index, depth, digit)
        later = np.zeros(len(place), bool)
        if len(left):
            order = np.argsort(equal * (1 + rank.max()) + rank[run[left]])
            left, equal = left[order], equal[order]
            head = np.concatenate([[True], equal[1:] != equal[:-1]])
            lead = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            same = _same_bytes(data, place[left], place[lead], depth)
            later[left[same & (rank[run[left]] > rank[run[lead]])]] = True
            for i in np.flatnonzero(~same):  # two strings of one name: compared as they are
                a = data[place[left[i]] : place[left[i]] + depth].tobytes()
                own = left[(equal == equal[i])]
                later[left[i]] = any(rank[run[j]] < rank[run[left[i]]] and data[place[j] : place[j] + depth].tobytes() == a for j in own)
        where = np.flatnonzero(later)
        if len(where):
            new = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (run[where[1:]] != run[where[:-1]])])
            begin = where[new]
            count = np.diff(np.concatenate([np.flatnonzero(new), [len(where)]]))
            null = pa.nulls(len(begin), pa.int64())
            yield _record({"doc_id": rows["doc_id"][run[begin]], "t": rows["t"][run[begin]], "start": rows["lo"][run[begin]] + index[begin], "n": count.astype(np.int32), "k1": null, "k2": null})
        if split:
            own = np.flatnonzero(~later)
            k1 = _mixed(_hashes(data, depth))[place[own]].view(np.int64)
            k2 = _mixed(_hashes(data[::-1], depth)[::-1])[place[own]].view(np.int64)
            yield _record({"doc_id": rows["doc_id"][run[own]], "t": rows["t"][run[own]], "start": rows["lo"][run[own]] + index[own], "n": np.ones(len(own), np.int32), "k1": k1, "k2": k2})

    columns = ("h", "doc_id", "t", "lo", "n", "rel")

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        for split in (False, True):
            own = table.filter(pa.compute.equal(table.column("hot"), split)).combine_chunks()
            # a hot group may be cut anywhere, as each part sends on the first of its windows
            for at in range(0, own.num_rows, RUNS) if split else [0] * bool(own.num_rows):
                some = own.slice(at, RUNS) if split else own
                yield from resolve({c: some.column(c).to_numpy() for c in columns}, some.column("bytes").combine_chunks() if not isinstance(some.column("bytes"), pa.Array) else some.column("bytes"), split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            marks = batch.filter(pa.compute.is_null(batch.column("bytes")))
            if marks.num_rows:
                null = pa.nulls(marks.num_rows, pa.int64())
                yield _record({"doc_id": marks.column("doc_id"), "t": marks.column("t"), "start": marks.column("lo"), "n": marks.column("n"), "k1": null, "k2": null})
            table = pa.Table.from_batches([batch.filter(pa.compute.is_valid(batch.column("bytes")))])
            if not table.num_rows:
                continue
            held.append(table)
            rows += table.num_rows
            if rows >= RUNS:
                every = pa.concat_tables(held)
                h = every.column("h").to_numpy()
                # the last group may go on, unless it is hot
                cut = int(np.searchsorted(h, h[-1])) if not every.column("hot")[-1].as_py() else every.num_rows
                if cut:
                    yield from parts(every.slice(0, cut))
                held = [every.slice(cut)] if cut < every.num_rows else []
                rows = every.num_rows - cut
        if rows:
            yield from parts(pa.concat_tables(held))

    return run


def _cut(depth: int):
    """(row values, text, starts, counts) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "starts": [], "ends": []}
            for doc_id, text, starts, counts in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("starts"), batch.column("counts")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                begin = end = np.empty(0, np.int64)
                if starts.is_valid and len(starts):
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s := starts.values.to_numpy(), 1)
                    np.add.at(edge, s + counts.values.to_numpy() + depth - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    data = data[~gone]
                values = (None if doc_id == NO_ID else doc_id, len(text.as_buffer()), int((end - begin).sum()), len(begin), hashlib.sha256(data.tobytes()).hexdigest(), begin.tolist(), end.tolist())
                for c, v in zip(out, values):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                *[(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()),
                ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
            ]))

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of every row: bytes covered by a string of ``depth``
    bytes that starts earlier (smaller doc_id, or earlier in the same document).

    ``depth`` is a multiple of ``digit`` and over 32. Null text is empty; a null doc_id comes before all others. Rows with
    one doc_id are ordered by a hash of the text, and equal rows are one document with equal results. Texts under ``depth``
    bytes keep all. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    name = F.xxhash64("text")
    # where every doc_id has one text, as it should, nothing more is carried to tell rows apart
    apart = rows.groupBy("doc_id").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b")
    rows = rows.select("doc_id", (F.lit(0).cast("long") if apart.isEmpty() else name).alias("t"), "text")
    anchors = rows.mapInArrow(_anchors(depth), "h long, salt int, known int, doc_id long, t long, run int")
    alone = anchors.repartition("h", "salt").sortWithinPartitions("h", "salt", "known")
    shared = alone.mapInArrow(_shared, "doc_id long, t long, run int, hot boolean")
    # a document's own runs: as many as its text is long
    listed = shared.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("run", "hot"))).alias("r"))
    listed = listed.select("doc_id", "t", F.col("r.run").alias("runs"), F.col("r.hot").alias("hots"))
    once = rows.join(listed, ["doc_id", "t"]).select("doc_id", "t", "text", "runs", "hots")
    contexts = once.mapInArrow(_contexts(depth), _CONTEXT)
    dealt = contexts.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id")
    found = dealt.mapInArrow(_sorted_runs(depth, digit), _MARK)
    # windows of hot anchors: the first of all tasks stays; a mark is a group of its own
    spread = [F.coalesce("k1", F.xxhash64("doc_id", "start")), F.coalesce("k2", "t")]
    order = Window.partitionBy(*spread, F.col("k1").isNull()).orderBy("doc_id", "t", "start")
    marks = found.withColumn("i", F.rank().over(order)).where("k1 is null or i > 1")
    places = marks.groupBy("doc_id", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    both = rows.join(places, ["doc_id", "t"], "left").select("doc_id", "text", "starts", "counts")
    return both.mapInArrow(_cut(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
