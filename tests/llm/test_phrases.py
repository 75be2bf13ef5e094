"""Phrase mining against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sirenfield.llm import phrases


def plain(rows, max_words, least, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for d in range(1, max_words + 1):
                for i in range(len(w) - d + 1):
                    f[lang][tuple(w[i : i + d])] += 1
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    longer[p[i : i + d]] = max(longer[p[i : i + d]], a)
        kept = []
        for p, a in cands.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], n[lang], score))
        for i, (_, _, p, *rest) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), *rest))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Über", "É", "NEW", "york", "\x1c", "\xa0x"]
    weight = [1 / (i + 1) for i in range(len(words))]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ?!"]
    make = lambda k: "".join(w + draw.choice(glue) for w in draw.choices(words, weight, k=k))
    out = [(draw.choice(["en", "de", None, "und", ""]), make(draw.randint(0, 60))) for _ in range(200)]
    out += [("en", "new york city hall. " * 30), ("en", None), ("en", ""), ("de", make(3000)), ("en", "a a a a a a a a a a a a")]
    return out + [out[0], out[0]]


@pytest.mark.parametrize("max_words,least,top,chunk", [(3, 10, 2000, 1 << 24), (2, 3, 15, 500), (4, 3, 50, 200), (3, 2, 7, 64)])
def test_collocations(spark, rows, monkeypatch, max_words, least, top, chunk):
    """Also with chunks so small that windows reach over their ends."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = rows_of(phrases.collocations(df, max_words, least, top=top))
    want = plain(rows, max_words, least, top=top)
    assert got == want and len(want) > 20


def test_quicksort():
    draw = np.random.default_rng(4)
    for n, kinds, depth in ((0, 1, 2), (1, 1, 1), (500, 1, 3), (500, 3, 3), (2000, 40, 2), (2000, 1500, 2), (300, 2, 5)):
        words = draw.integers(0, kinds, n + depth)
        heads, sizes = phrases.quicksort(words, np.arange(n), depth)
        got = {tuple(words[p : p + depth]): k for p, k in zip(heads, sizes)}
        assert len(got) == len(heads) and got == Counter(tuple(words[p : p + depth]) for p in range(n))


def test_filter_holds_all_it_was_given(spark):
    """Names made by columns and by arrays are the same ones."""
    import xxhash

    rows = [("en", f"w{i} x{i % 7} w{i + 1}", 10) for i in range(500)]
    made = phrases._filter(spark.createDataFrame(rows, "lang string, phrase string, a long"), 3, 500)
    seed = xxhash.xxh64_intdigest("en", 42)

    def name(p):
        hs = [np.uint64(xxhash.xxh64_intdigest(w, seed)) for w in p.split(" ")]
        return hs[0] ^ phrases._turn(hs[1], 1) ^ phrases._turn(hs[2], 2)

    assert made.holds(np.array([name(p) for _, p, _ in rows], np.uint64)).all()
    assert made.holds(np.array([name(f"y{i} x z") for i in range(1000)], np.uint64)).mean() < 0.1


def test_one_phrase_in_every_text(spark):
    """A very frequent phrase leaves each task as one row."""
    rows = [("en", f"alpha beta n{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    assert rows_of(phrases.collocations(df)) == [("en", 1, "alpha beta", 5000, 5000, 5000, 15000, 1_000_000)]
    sizes = df.select("lang", "text").mapInArrow(phrases._sizes(1, None), "lang string, phrase string, size long")
    assert sizes.where("phrase = 'alpha'").count() <= 8


def test_large_counts_are_exact(spark):
    """Products over 64 bits."""
    a, l, r = 3_000_000_007, 3_000_000_011, 4_000_000_007
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(*[F.col(c).cast("decimal(16,0)").alias(c) for c in "alr"])
    assert df.selectExpr("(a * a * cast(1000000 as decimal(7,0))) div (l * r) s").first().s == 10**6 * a * a // (l * r)


def test_edges(empty, odd):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(odd).count() == 0
    assert phrases.collocations(odd, min_count=1).count() == 0


def test_a_chunk_takes_a_few_times_its_bytes():
    """Most of a task's memory is what a chunk needs at once: words are split, looked up and joined part by part."""
    import tracemalloc

    rng = np.random.default_rng(7)
    own = b" ".join(np.char.add("w", rng.integers(0, 20_000, 600_000).astype(str)).astype("S").tolist())
    known = phrases.Filter(np.full(1 << 10, ~np.uint64(0)))
    tracemalloc.start()
    rows = sum(b.num_rows for b in phrases._partitions("en", own, b"", 3, known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000
    assert peak < 7.5 * len(own), peak / len(own)
