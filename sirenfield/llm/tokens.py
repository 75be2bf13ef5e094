"""Token-id files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file is a row of frames, then a skippable frame that holds the seek table, then nothing. Layout, little-endian:

* data frame: one zstandard frame of up to ``FRAME_DOCS`` documents or about ``FRAME_IDS`` ids, each id four bytes;
* seek table: skippable magic 0x184D2A5E, size of what follows; for every frame: compressed bytes, ids (both 4), crc32 of
  the ids' bytes (4), documents (4); for every document: doc_id (8), ids (4); last: number of frames (4), number of
  documents (8), magic 0x544F4B53 (4).

A reader takes the table from the end of the file and decompresses only frames that hold what it wants; any zstandard
reader can decompress the whole file, since skippable frames are passed over.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import kept_by_worker, stage, text_of, width

FRAME_DOCS, FRAME_IDS = 1_024, 1 << 17
SKIPPABLE, MAGIC = 0x184D2A5E, 0x544F4B53
END_ID = 2
_TAIL, _TAIL_BYTES = "<IQI", 16
NO_ID = -(1 << 63)  # stands for a null doc_id in the seek table
_FRAME = np.dtype([("bytes", "<u4"), ("ids", "<u4"), ("crc32", "<u4"), ("docs", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("ids", "<u4")])


class Writer:
    """Writes documents one after another to an open binary stream; at most one frame is held."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if len(self.held) >= FRAME_DOCS or self.n_held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), self.n_held, zlib.crc32(raw), len(self.held)))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        table = np.array(self.frames, _FRAME).tobytes() + np.array(self.docs, _DOC).tobytes()
        table += struct.pack(_TAIL, len(self.frames), len(self.docs), MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads a token file of ``size`` bytes through ``read(start, length)``, a frame at a time."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        n_frames, n_docs, magic = struct.unpack(_TAIL, read(size - _TAIL_BYTES, _TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError("not a token file")
        length = n_frames * _FRAME.itemsize + n_docs * _DOC.itemsize
        table = read(size - _TAIL_BYTES - length, length)
        self.frames = np.frombuffer(table, _FRAME, n_frames)
        self.docs = np.frombuffer(table, _DOC, n_docs, n_frames * _FRAME.itemsize)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["bytes"], dtype=np.int64)])
        self.first_doc = np.concatenate([[0], np.cumsum(self.frames["docs"], dtype=np.int64)])

    def frame(self, k: int) -> np.ndarray:
        head = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.starts[k]), int(head["bytes"])), max_output_size=4 * int(head["ids"]) or 1)
        if zlib.crc32(raw) != head["crc32"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def in_frame(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        docs = self.docs[self.first_doc[k] : self.first_doc[k + 1]]
        yield from zip(docs["doc_id"].tolist(), np.split(self.frame(k), np.cumsum(docs["ids"], dtype=np.int64)[:-1]))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.frames)):
            yield from self.in_frame(k)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that name; only the frames that hold one are decompressed."""
        found = []
        for i in np.flatnonzero(self.docs["doc_id"] == doc_id):
            k = int(np.searchsorted(self.first_doc, i, side="right")) - 1
            found.append(list(self.in_frame(k))[int(i - self.first_doc[k])][1])
        return found


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path: a local folder, or whatever pyarrow opens by its address."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# characters whose classes are the same in every Unicode version; fixed value: the split that GPT-2's published encoder makes, over them
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r\xa0"
_KNOWN = "[\t\n\r -~\xa0-ɏ]*"
_PIECE = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: pieces that a task remembers, and those encoded in one text (longer texts take longer a piece)
MAX_PIECES, LINES = 1_000_000, 1_000
#: documents whose pieces are held together
AT_ONCE = 128


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library.

    Byte-level BPE encodes each piece of a text by itself, so every piece is encoded once and remembered. Texts with other
    characters or with an added token in them, and tokenizers of another kind, go through the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tok, self.pieces = Tokenizer.from_file(path), {}
        kind = json.loads(self.tok.to_str())
        split = {k: (kind["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        self.by_piece = split == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not kind["normalizer"]
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.known, self.piece = re.compile(_KNOWN), re.compile(_PIECE)
        line_end = self.tok.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else -1
        self.by_piece &= len(line_end) == 1

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces in texts of ``LINES`` lines, a piece each: line ends are pieces of their own and part the ids."""
        texts = [new[i : i + LINES] for i in range(0, len(new), LINES)]
        for lines, coded in zip(texts, self.tok.encode_batch_fast(["\n".join(x) for x in texts], add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            raw, ends = ids.tobytes(), np.flatnonzero(ids == self.line_end).tolist()
            if len(ends) != len(lines) - 1:  # not one piece a line after all
                self.pieces.update(zip(lines, self._whole(lines)))
                continue
            starts = [0, *[4 * i + 4 for i in ends]]
            self.pieces.update(zip(lines, map(raw.__getitem__, map(slice, starts, [*[4 * i for i in ends], len(raw)]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        fast = [self.by_piece and self.known.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        parts = [self.piece.findall(t) if f else [] for t, f in zip(texts, fast)]
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        held = self.pieces
        new = set().union(*parts).difference(held)
        blank = [w for w in new if w.isspace()]
        if blank:
            held.update(zip(blank, self._whole(blank)))
            new.difference_update(blank)
        if new:
            self._learn(list(new))
        slow = iter(self._whole([t for t, f in zip(texts, fast) if not f]))
        return [_joined(held, p) if f else next(slow) for p, f in zip(parts, fast)]


def _joined(held: dict[str, bytes], parts: list[str]) -> bytes:
    # one lookup of all parts is quicker than one for each, but takes two at least
    return b"".join(itemgetter(*parts)(held)) if len(parts) > 1 else b"".join(map(held.__getitem__, parts))


def _encode(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        end = np.array([end_id], "<u4").tobytes()
        writer = out = None
        first = last = None
        task = TaskContext.get()
        # a retried or doubled attempt writes a file of its own; only the one that Spark commits is in the manifest
        name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                if not part.num_rows:
                    continue
                if encoder is None:
                    encoder = kept_by_worker(("Encoder", tokenizer), lambda: Encoder(tokenizer))
                    store, path = _store(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    writer = Writer(out)
                texts = part.column("text").to_pylist()
                for doc_id, coded in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    writer.add(NO_ID if doc_id is None else doc_id, np.frombuffer(coded + end, "<u4"))
                    first, last = doc_id if first is None else first, doc_id
        if writer is not None:
            writer.close()
            out.close()
            n_ids = sum(n for _, n in writer.docs)
            yield pa.RecordBatch.from_pylist([{"file": name, "first_id": first, "last_id": last, "n_docs": len(writer.docs), "n_ids": n_ids}])

    return run


_MANIFEST = "file string, first_id long, last_id long, n_docs long, n_ids long"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encodes every text, appends ``end_id``, writes files in ascending doc_id order; returns their manifest.

    The manifest (file, first_id, last_id, n_docs, n_ids, start: ids in the files before) is itself written to the shared
    folder. Each task owns a range of doc_ids, so the files follow one another without a global sort in one place, and a
    task holds one frame and the lengths of its documents. Null text: only the end id. Rows with a null doc_id come
    first. Repeated rows are written as often as they occur, ordered by text.
    ``tokenizer`` is a path that every executor can read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = rows.repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(dealt.mapInArrow(_encode(folder, tokenizer, end_id), _MANIFEST), "manifest")
    # one row per file; equal first ids cannot be, as a range partition holds all rows of an id
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                store, path = _store(file)
                with store.open_input_file(path) as stream:
                    reader = Reader(lambda at, n, s=stream: s.read_at(n, at), stream.size())
                    for k in range(len(reader.frames)):
                        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for doc_id, ids in reader.in_frame(k):
                            for key, value in zip(out, (None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.tobytes()))):
                                out[key].append(value)
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(key, pa.int64()) for key in out]))

    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
