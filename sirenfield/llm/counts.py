"""Token counts by prefix dynamic programming: the exact count at every prefix of every text, stored beside it.

Byte-level BPE has one possible last token for every prefix: of the tokens that the prefix ends with, the longest one that
may follow the last token of what is before it. Two tokens may follow one another if encoding their joined bytes gives
these two again, which their merges decide. So

    last(i) = that token,    count(i) = count(i - its length) + 1

runs once over a piece of text, and an automaton of all tokens lists the candidates. Texts fall apart into units after
which the split into pieces never changes; a unit's counts are found once and remembered, and a text's are theirs joined.
What is stored is the change of the count at each character (16 bits), so questions about truncation and budgets are
running sums and need no tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, text_of

#: units and pairs of tokens that a task remembers, and the longest unit among them
MAX_UNITS, MAX_PAIRS, MAX_UNIT = 1_000_000, 1_000_000, 256
# characters whose classes are the same in every Unicode version
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r\xa0"
_OTHER = f"[^{_BLANK}{_LETTER}{_DIGIT}]"
_KNOWN = re.compile("[\t\n\r -~\xa0-ɏ]*")
# fixed values: endings that the split of byte-level BPE keeps apart
_ENDING = "'s|'t|'re|'ve|'m|'ll|'d"
# blanks go with what follows them: only then is a unit's split the same whatever comes next
_UNIT = re.compile(f"(?:[{_BLANK}]*[{_BLANK[1:]}])?(?:{_ENDING})|[{_BLANK}]*(?:[{_LETTER}]+|[{_DIGIT}]+|{_OTHER}+)|[{_BLANK}]+")
_HEAD = re.compile(f"[{_BLANK}]*")
# fixed values: Unicode's white space
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level BPE: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in shown))
    return letters


class PrefixCounter:
    """Counts of a byte-level BPE tokenizer file at every prefix; ``by_prefix`` tells whether the file is of that kind."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.by_prefix, self.added = False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count_whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.count_whole = lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        kind = json.loads(tok.to_str())
        split = {k: (kind["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        plain = split == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not kind["normalizer"]
        model, options = kind["model"], ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in options) or any(t[f] for t in kind["added_tokens"] for f in flags):
            return
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.by_prefix = self._read(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def _read(self, vocabulary: dict[str, int], merges: list) -> bool:
        """Tokens numbered by age: bytes first, then merges as they come. False if a token is made in several ways."""
        letters = byte_letters()
        names = [b for b in letters if b in vocabulary] + [a + b for a, b in merges]
        number = {name: i for i, name in enumerate(names)}
        if len(number) != len(names) or len(names) - len(merges) != 256 or not set(vocabulary) <= set(number) | set(self.added):
            return False
        self.halves = [(i, i) for i in range(256)] + [(number[a], number[b]) for a, b in merges]
        self.merged = {pair: i for i, pair in enumerate(self.halves[256:], 256)}
        self.automaton = ahocorasick.Automaton()
        for name, i in number.items():
            raw = bytes(letters[c] for c in name).decode("latin-1")
            self.automaton.add_word(raw, (len(raw), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        return True

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` gives ``a, b``: no merge across the border comes up in time.

        Undoes the merges of both, the later one first. What then touches at the border stood there until the merge undone
        last; had the two a merge of their own before that, the encoder would have taken it.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, until, out = a, b, len(self.halves), True
        while True:
            if self.merged.get((x, y), until) < until:
                out = False
                break
            if x < 256 and y < 256:
                break
            # of two equal merges the left one happens first, so it is the right one that is undone first
            if x > y:
                until, x = x, self.halves[x][1]
            else:
                until, y = y + 1, self.halves[y][0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = out
        return out

    def piece(self, raw: bytes) -> list[int]:
        """Counts at every byte of one piece, 0 first."""
        last, count, settled = [-1], [0], 0
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if settled == end:
                continue
            before = end - size
            if not before or self.may_follow(last[before], token):
                last.append(token)
                count.append(count[before] + 1)
                settled = end
        return count

    def _chars(self, text: str) -> list[int]:
        """Counts at every character of one piece, 0 first."""
        raw = text.encode()
        count = self.piece(raw)
        return count if len(raw) == len(text) else [0, *[count[i + 1] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]]

    def unit(self, text: str) -> list[int]:
        """Counts at every character of a unit: blanks, then a run of one class or an ending."""
        n = _HEAD.match(text).end()
        blanks = self._chars(text[:n])
        if n == len(text):
            return blanks
        # a blank before the run goes to the run, any other stays alone; blanks before that are a piece
        joined = n > 0 and text[n - 1] == " "
        before = blanks[n - 1] + (not joined) if n else 0
        body = self._chars(text[n - joined :])
        if text[n] == "'" and len(text) == n + 3 and text[n + 1] != "'" and text[n + 2].isalpha():
            body = [*body[:2], 2, body[3]]  # 're, 've, 'll: without their end a quote and a letter
        return blanks + [before + c for c in body[1 + joined :]]

    def _changes(self, unit: str) -> bytes:
        out = np.diff(self.unit(unit)).astype("<i2").tobytes()
        if len(unit) <= MAX_UNIT:
            if len(self.units) >= MAX_UNITS:
                self.units.clear()
            self.units[unit] = out
        return out

    def _plain(self, text: str) -> bytes:
        """Changes at every character of a text whose added tokens, if any, count as ordinary text."""
        if not _KNOWN.fullmatch(text):
            return self._by_library(text)
        units = _UNIT.findall(text)
        for u in set(units).difference(self.units):
            if len(u) <= MAX_UNIT:
                self._changes(u)
        if len(units) > 1 and max(map(len, units)) <= MAX_UNIT:
            try:
                return b"".join(itemgetter(*units)(self.units))
            except KeyError:  # the memory was cleared on the way
                pass
        return b"".join([self.units.get(u) or self._changes(u) for u in units])

    def _by_library(self, text: str) -> bytes:
        """The same for characters whose class the unit pattern does not know: stretches between blanks, prefix by prefix.

        A piece never goes on from a stretch into the blanks behind it, so stretches stand by themselves.
        """
        out = []
        for part in _STRETCH.findall(text):
            known = self.units.get(part)
            if known is None and _KNOWN.fullmatch(part):
                known = b"".join([self.units.get(u) or self._changes(u) for u in _UNIT.findall(part)])
            elif known is None:
                known = self._stretch(part)
                if len(part) <= MAX_UNIT and len(self.units) < MAX_UNITS:
                    self.units[part] = known
            out.append(known)
        return b"".join(out)

    def _stretch(self, part: str) -> bytes:
        """Counts of every prefix of blanks and a stretch, in the pieces that the library makes of it."""
        from tokenizers import pre_tokenizers

        pieces = [part[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(part)]
        out, base, behind = [0], 0, ""
        for piece in pieces:
            own = self._chars(piece)
            if len(piece) == 3 and re.fullmatch(_ENDING, piece):
                own[2] = 2  # without its end a quote and a letter
            out += [base + c for c in own[1:]]
            blanks = len(piece) - len(piece.lstrip(_WHITE))
            if behind and not behind.strip(_WHITE):  # prefixes that end in blanks have one piece for all of them
                run = self._chars(behind + piece[:blanks])
                first = len(out) - len(piece)
                out[first : first + blanks] = [base - run[len(behind)] + c for c in run[len(behind) + 1 :]]
            base += own[-1]
            behind = piece
        return np.diff(out).astype("<i2").tobytes()

    def changes(self, text: str) -> bytes:
        """The change of the count at every character of ``text``, 16 bits each; an added token counts when it is complete."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            body = np.frombuffer(self._plain(text[at : found.end()]), "<i2").copy()
            own = int(np.frombuffer(self._plain(text[at : found.start()]), "<i2").sum()) if found.start() > at else 0
            body[-1] += own + 1 - int(body.sum())
            out.append(body.tobytes())
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])


def count_tokens(docs: DataFrame, tokenizer: str, budget: int | None = None) -> DataFrame:
    """(row, n_bytes, n_tokens, changes, fits): ``row`` the input row, ``changes`` the stored counts, see ``at_prefix``.

    ``fits`` is the number of characters of the longest prefix of at most ``budget`` tokens (null without a budget).
    ``tokenizer`` is a path that every executor can read: a ``.json`` of tokenizers or a ``.model`` of sentencepiece. Files
    that are not plain byte-level BPE count whole texts by their library; ``changes`` and ``fits`` are null for them. No
    begin, end or other special tokens are added; added tokens inside texts count as the library takes them. Null text:
    empty, 0 tokens. Repeated rows each get a row, whatever the doc_id; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counter = counter or kept_by_worker(("PrefixCounter", tokenizer), lambda: PrefixCounter(tokenizer))
                texts = part.column("text").to_pylist()
                if counter.by_prefix:
                    changes = [counter.changes(t) for t in texts]
                    tables = [np.frombuffer(c, "<i2") for c in changes]
                    n_tokens = [int(t.sum(dtype=np.int64)) for t in tables]
                    fits = [None if budget is None else longest(t, budget, n) for t, n in zip(tables, n_tokens)]
                else:
                    n_tokens, changes, fits = counter.count_whole(texts), [None] * len(texts), [None] * len(texts)
                n_bytes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(changes, pa.binary()), pa.array(fits, pa.int64())],
                    ["row", "n_bytes", "n_tokens", "changes", "fits"],
                )

    # the text goes over once, beside the other columns
    others = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("no_other")]
    rows = docs.select(F.struct(*others).alias("row"), text_of().alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_bytes long, n_tokens long, changes binary, fits long")


def longest(changes: np.ndarray, budget: int, n_tokens: int | None = None) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; a longer prefix can have fewer tokens than a shorter."""
    if n_tokens is not None and n_tokens <= budget:
        return len(changes)
    within = np.flatnonzero(np.cumsum(changes, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def at_prefix(changes: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return int(np.frombuffer(changes, "<i2")[:n_chars].sum(dtype=np.int64))


def within_budgets(counted: DataFrame, budgets: list[int]) -> DataFrame:
    """Answers from stored counts: for each row the longest prefix for each budget, as ``fits`` array of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [None if c is None else np.frombuffer(c, "<i2") for c in batch.column("changes").to_pylist()]
            fits = [None if t is None else [longest(t, b) for b in budgets] for t in tables]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fits, pa.list_(pa.int64()))], ["row", "fits"])

    rows = counted.select("row", "changes")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fits array<long>")
