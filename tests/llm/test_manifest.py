"""Merkle manifest against a plain tree."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sirenfield.llm import manifest


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves: list[str], fanout: int):
    """Root, and for each leaf its steps of (before, after)."""
    steps = [[] for _ in leaves]
    nodes = [(h, [i]) for i, h in enumerate(leaves)]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k, (_, below) in enumerate(run):
                for i in below:
                    steps[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            up.append((sha(*[h for h, _ in run]), [i for _, b in run for i in b]))
        nodes = up
    return nodes[0][0], steps


def plain(rows, fanout):
    """(g, key, h) rows -> Counter-like list of (key, h, subroot, root, steps)."""
    groups = defaultdict(list)
    for g, key, h in rows:
        groups[g].append((key is not None, key, h))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: (sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2])),) for g in order}
    made = {g: (r, *tree([h for *_, h in r], fanout)) for g, (r,) in made.items()}
    root, above = tree([made[g][1] for g in order], fanout)
    return [(key, h, made[g][1], root, s + above[j]) for j, g in enumerate(order) for (_, key, h), s in zip(made[g][0], made[g][2])]


@pytest.mark.parametrize("fanout,block", [(2, 1024), (2, 4), (3, 9), (4, 4)])
def test_tree(spark, fanout, block):
    sizes = {"en": 70, None: 17, "": 1, "de": 16, "ß": 9, "zz": 2, "z": 3}
    rows = [(g, (i * 7) % (n + 3), sha(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    rows += [rows[0], rows[0], ("en", None, sha("x"))]
    df = spark.createDataFrame(rows, "lang string, key long, h string").repartition(5)
    got = manifest.manifest(df.withColumn("g", manifest.group_key(F.col("lang"))), "key", fanout, block)
    proof = got.select("key", "h", "subroot", "root", "steps", manifest.siblings(F.col("steps")).alias("s"), manifest.fold(F.col("h"), F.col("steps")).alias("f"),
                       manifest.fold(F.lit("0"), F.col("steps")).alias("wrong")).collect()
    as_row = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(as_row((r.key, r.h, r.subroot, r.root, [tuple(s) for s in r.steps])) for r in proof) == sorted(map(as_row, plain(rows, fanout)))
    assert all(r.f == r.root != r.wrong and r.s == "".join(b + a for b, a in r.steps) for r in proof)


def test_leaf(spark):
    df = spark.createDataFrame([(1, "ß\n", None), (None, "", 3)], "a long, b string, c long")
    got = [r[0] for r in df.select(manifest.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [sha("1:1", "3:ß\n", "-"), sha("-", "0:", "1:3")]


def test_edges(spark, empty, odd):
    for df, n in ((empty, 0), (odd, 5), (odd.limit(1), 1)):
        leaves = df.select("doc_id", "row", manifest.group_key(F.col("lang")).alias("g"), manifest.leaf(F.col("doc_id"), F.col("text")).alias("h"))
        got = manifest.manifest(leaves, "doc_id").collect()
        assert len(got) == n and len({r.root for r in got}) == min(n, 1)
        if n == 1:
            assert got[0].root == got[0].subroot == got[0].h and got[0].steps == []


def test_one_large_group_is_dealt_over_tasks(spark):
    """Places come from ranges and their counts: no window over a group's rows."""
    df = spark.range(40_000).select(F.lit("=en").alias("g"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = manifest.numbered(df, "key", "h")
    assert got.where("idx != key or n != 40000").count() == 0 and got.count() == 40_000
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in text.splitlines() if "Window" in line)


def test_query_finds_what_was_changed(spark):
    import zlib

    from sirenfield.llm import queries

    got = queries.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        d = docs[r.doc_id]
        field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        assert r.leaf == sha(*[field(v) for v in (d.doc_id, d.source, d.lang, d.n_chars, d.text)])
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or d.n_chars is None) == (r.folded_root == r.root)
    assert 0 < sum(not r.verified for r in got) < len(got)
