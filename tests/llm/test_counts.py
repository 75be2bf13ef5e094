"""Token counts against the libraries, at every prefix."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sirenfield.llm import counts, queries

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return counts.PrefixCounter(PATH)


def prefixes(counter, text):
    return np.cumsum(np.frombuffer(counter.changes(text), "<i2")).tolist()


def expected(tok, text):
    return [len(tok.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


ODD = [
    "hello world", "don't 'll we're  'tis  x", "a  \n\n b\t\tc", "\n\n'll 're", "!<|endoftext|>x!<|endoftext|><|endoftext|>y  <|endoftext|>",
    "<|endo", "'l", "x'l 've'r", " 's    x's  ", "日本語 text 中文  字　x", "é日'll 'lé", "\x1c ab\x1c\x1c \x85 z", "😀😀 's", "  'll", "日\n\n'll",
]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(counter, tok, text):
    assert prefixes(counter, text) == expected(tok, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "'s", "'ll", "re", "the", " quick", "tion", "=====", "12", "é", "日", "\x1d", "\xa0", "　", "<|", "<|endoftext|>", ".", "A"]), max_size=14))
def test_every_prefix_of_mixtures(counter, tok, parts):
    text = "".join(parts)
    assert prefixes(counter, text) == expected(tok, text)


def test_pairs_that_may_follow(counter):
    """Against merging the joined bytes by rank."""

    def merged(raw):
        parts = list(raw)
        while True:
            ranks = [(counter.merged.get(pair, 1 << 40), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranks, default=(1 << 40, 0))
            if rank == 1 << 40:
                return parts
            parts[i : i + 2] = [rank]

    def raw(t):
        return bytes([t]) if t < 256 else raw(counter.halves[t][0]) + raw(counter.halves[t][1])

    draw = random.Random(1)
    common = draw.sample(range(256, 3000), 90) + draw.sample(range(256), 20)
    seen = set()
    for a in common:
        for b in common:
            may = counter.may_follow(a, b)
            assert may == (merged(raw(a) + raw(b)) == [a, b]), (raw(a), raw(b))
            seen.add(may)
    assert seen == {True, False}


def test_query_columns_and_rows(spark, docs, by_id, tok):
    counted = counts.count_tokens(docs, PATH, budget=40).collect()
    assert len(counted) == docs.count()
    for r in counted:
        text = by_id[r.row.doc_id] or ""
        want = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, len(r.changes)) == (len(text.encode()), want, 2 * len(text))
        assert counts.at_prefix(r.changes, len(text) // 2) == len(tok.encode(text[: len(text) // 2], add_special_tokens=False).ids)
        if len(text) < 2500:
            assert r.fits == max([i + 1 for i, n in enumerate(expected(tok, text)) if n <= 40], default=0)
    many = {r.row.doc_id: r.fits for r in counts.within_budgets(counts.count_tokens(docs, PATH), [0, 40, 10**6]).collect()}
    assert all(many[r.row.doc_id] == [0, r.fits, len(by_id[r.row.doc_id] or "")] for r in counted)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_count_whole_texts(spark, docs, by_id, name):
    got = counts.count_tokens(docs.select("doc_id", "text"), P.path(name), budget=3).collect()
    texts = [by_id[r.row.doc_id] or "" for r in got]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(e.ids) for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in got] == want and all(r.changes is None and r.fits is None for r in got)


def test_long_texts(counter, tok):
    """One run of a letter, of blanks, of letters without blanks, and many lines; remembered units stay bounded."""
    draw = random.Random(2)
    for text in ("a" * 200_000, " " * 100_000 + "x", "日本" * 20_000, "".join(draw.choices("abcdefgh", k=200_000)), "word \n" * 100_000):
        assert int(np.frombuffer(counter.changes(text), "<i2").sum()) == len(tok.encode(text, add_special_tokens=False).ids)
    assert len(counter.units) <= counts.MAX_UNITS and max(map(len, counter.units)) <= counts.MAX_UNIT


def test_edges(spark, empty, odd):
    assert counts.count_tokens(empty, PATH).count() == 0
    got = counts.count_tokens(odd, PATH, budget=512).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.fits) for r in got) == [(0, 0, 0)] * 4 + [(4, 1, 4)]
    assert counts.count_tokens(odd.select("text"), PATH).count() == 5


def test_query(spark, tok):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_token_counts"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n = len(tok.encode(want[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(want[r.doc_id].encode()), n, n > 512)
