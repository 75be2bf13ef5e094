"""The pipeline, stage by stage, on the smallest tables, against plain re-statements."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from sirenfield.llm import quality
from sirenfield.llm.common import stage, table
from tests.llm.test_operators import plain_groups, plain_print, plain_targets, words

SF = "/root/testdata/sf0.001"


def fails_base(text: str) -> bool:
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def without_lines(rows: list[tuple], min_lines: int = 3, min_words: int = 50) -> dict:
    """(doc_id, text) in order -> texts without lines that a run of 3 lines or 50 words covers which starts earlier."""
    seen, out = set(), {}
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        at = [n for n, x in enumerate(parts) if words(x)]
        gone = set()
        for p in range(len(at)):
            for k in range(1, min(min_lines, len(at) - p) + 1):
                run = tuple(parts[n] for n in at[p : p + k])
                if k == min_lines or sum(len(words(x)) for x in run) >= min_words:
                    if run in seen:
                        gone |= {at[p + i] for i in range(k)}
                    seen.add(run)
        if not gone:
            out[doc_id] = text
        elif len(gone) < len(at):
            out[doc_id] = "\n".join(x for n, x in enumerate(parts) if n not in gone)
    return out


def copies(rows: list[tuple], seed: int = 17) -> Counter:
    """(doc_id, source, text) -> how often the mix takes each: whole epochs, then the start of the order by md5."""
    sizes, order = Counter(), defaultdict(list)
    for doc_id, source, text in rows:
        n = len(words(text))
        sizes[source] += n
        order[source].append((hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest(), doc_id, n))
    target, out = plain_targets(sizes), Counter()
    for source, docs in order.items():
        rate = target[source] / sizes[source]
        part, before = target[source] - int(rate) * sizes[source], 0
        for _, doc_id, n in sorted(docs):
            out[doc_id] = int(rate) + (part > 0 and before + n / 2 <= part)
            before += n
    return +out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    # copies with other line ends: no line is repeated, but the words are
    again = docs.where("doc_id % 9 = 4").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.replace("text", F.lit("\n"), F.lit("  ")))
    docs = docs.unionByName(again)
    columns, before = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before[name] = docs
        docs = stage(step(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
    rows = {name: [(r.doc_id, r.source, r.text) for r in df.orderBy("doc_id").collect()] for name, df in before.items()}
    ids = lambda name: Counter(r[0] for r in rows[name])

    # rules: what fails the base rules goes, and the ratio's verdict stands
    judged = quality.judge(before["quality_rules"], quality.fit_ratio(before["quality_rules"], table(spark, SF, "labels")))
    verdict = {r.doc_id: r.kept for r in judged.collect()}
    assert ids("line_dedup") == Counter(i for i, *_ in rows["quality_rules"] if verdict[i])
    assert all(not verdict[i] for i, _, t in rows["quality_rules"] if fails_base(t))
    # lines
    want = without_lines([(i, t) for i, _, t in rows["line_dedup"]])
    assert {i: t for i, _, t in rows["simhash_near_dedup"]} == want and len(want) == len(rows["simhash_near_dedup"])
    # near duplicates: one of each group of linked fingerprints
    prints = {i: plain_print(t) for i, _, t in rows["simhash_near_dedup"]}
    groups = plain_groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert ids("mix_sources") == Counter(set(groups.values())) and len(rows["mix_sources"]) < len(prints)
    # the mix
    assert ids("best_fit_packing") == copies(rows["mix_sources"])
    # packing: every word once
    packed = Counter()
    for r in docs.collect():
        packed[r.doc_id] += r.n_words
    sizes = Counter()
    for i, _, t in rows["best_fit_packing"]:
        sizes[i] += len(words(t))
    assert packed == sizes


def test_run_is_the_stages(spark):
    docs = table(spark, SF, "documents")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
