"""Registered queries of the numbered operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, lines, mixing, packing, phrases, quality, secrets, simhash, sketches, suffixes, tokens
from . import manifest as merkle
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source
), turns AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY s / w, source NULLS LAST) AS i FROM turns
), levels AS (
  SELECT a.i, (SELECT sum(s) FROM ranked) AS total,
         ((SELECT sum(s) FROM ranked) - 3 * coalesce((SELECT sum(b.s) FROM ranked b WHERE b.i < a.i), 0))
           / (SELECT sum(b.w) FROM ranked b WHERE b.i >= a.i) AS level
  FROM ranked a
), water AS (
  SELECT level FROM levels JOIN ranked USING (i) WHERE 3 * s > level * w ORDER BY i LIMIT 1
), targets AS (
  SELECT source, s, coalesce(least(3.0::DOUBLE * s, CAST((SELECT level FROM water) AS DOUBLE) * w), 3.0::DOUBLE * s) AS target FROM ranked
), placed AS (
  SELECT d.doc_id, d.size, t.s, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taking AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 1 END AS whole FROM placed
), copied AS (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN s > 0 AND target - whole * s > 0 AND cum + size / 2.0 <= target - whole * s THEN 1 ELSE 0 END AS copies FROM taking
)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM copied
"""
ORACLE["op4_mix_sources"] = _OP4

_ODD_TEXT = "</s>[INST] ok [/INST]"


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD_TEXT).alias("text"),
    )
    formatted = chat.format_chats(rows.unionByName(odd).withColumn("parts", chat.text_part(F.col("text"))))
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens",
    )


ORACLE["op5_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|/?$)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), 'x^', '') AS e
  FROM said
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(e) + 24) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM escaped GROUP BY conv_id
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratio = quality.fit_ratio(docs, labels)
    return quality.judge(docs, ratio).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), lines.MIN_LINES, lines.MIN_WORDS)
    return cut.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op3_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), worded AS (
  SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM split WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, line, size, array_to_string([x, y, z][1 : size], chr(10)) AS run
  FROM (SELECT doc_id, line, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z, n, lead(n, 1) OVER w AS m FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY line)), (VALUES (1), (2), (3)) s(size)
  WHERE (size = 1 AND n >= 50) OR (size = 2 AND n + m >= 50) OR (size = 3 AND z IS NOT NULL)
), placed AS (
  SELECT doc_id, line, size, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, line) AS i FROM windows
), gone AS (
  SELECT DISTINCT doc_id, line + d AS line FROM placed, (VALUES (0), (1), (2)) v(d) WHERE i > 1 AND d < size
), marked AS (
  SELECT s.doc_id, s.pos, s.x, w.line IS NOT NULL AS has_word, g.line IS NOT NULL AS dropped,
         g.line IS NOT NULL AND h.line IS NULL AS begins
  FROM split s LEFT JOIN worded w ON s.doc_id = w.doc_id AND s.pos = w.pos
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.line = w.line LEFT JOIN gone h ON h.doc_id = w.doc_id AND h.line = w.line - 1
)
SELECT doc_id, count(*) FILTER (WHERE has_word) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
       count(*) FILTER (WHERE begins) AS n_runs, sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokens.read_ids(spark, tokens.write_ids(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs.select("doc_id", "text"), secrets.train(secrets.labelled_strings(docs)))
    base = ["assign", "access", "hex"]
    return found.select(
        "row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(*map(F.col, base)), 256).alias("base_sha256"),
        secrets.listed(*map(F.col, secrets.KINDS)).alias("spans"), F.size("markov").cast("long").alias("n_markov"),
    )


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketches.fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = counts.count_tokens(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fits")


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        "doc_id", merkle.group_key(F.col("lang")).alias("g"), merkle.leaf(*map(F.col, _FIELDS)).alias("h"),
        F.when(hit, merkle.leaf(*[changed.get(c, F.col(c)) for c in _FIELDS])).alias("tampered"),
    )
    found = merkle.manifest(leaves, "doc_id").withColumn("folded_root", merkle.fold(F.coalesce("tampered", "h"), F.col("steps")))
    return found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _op12_sql(levels: int = 40, root_levels: int = 16) -> str:
    """One pair of steps per level: nodes above, and each row's path through them; groups with one node stay as they are."""

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    def leaf(**other: str) -> str:
        return "sha256(" + " || ".join(field(other.get(c, c)) for c in _FIELDS) + ")"

    # crc32 bit by bit over the digits
    crc = (
        "list_reduce([4294967295] || list_transform(range(8 * length(CAST(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN"
        " ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END),"
        " lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"
    )
    steps = [
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf()} AS h,
         CASE WHEN xor({crc}, 4294967295) % 7 = 0 THEN {leaf(n_chars="(n_chars + 1)")} ELSE {leaf()} END AS t
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves
), a0 AS MATERIALIZED (SELECT g, idx, n, h FROM placed),
p0 AS MATERIALIZED (SELECT doc_id, g, h AS leaf, t, '' AS proof, idx, n FROM placed)"""
    ]

    def level(a: str, b: str, p: str, q: str) -> str:
        return f"""{b} AS MATERIALIZED (
  SELECT g, idx // 2 AS idx, (any_value(n) + 1) // 2 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h
  FROM {a} GROUP BY g, {a}.idx // 2
), {q} AS MATERIALIZED (
  SELECT p.* REPLACE (
    CASE WHEN p.n = 1 THEN t WHEN p.idx % 2 = 1 THEN sha256(s.h || t) ELSE sha256(t || coalesce(s.h, '')) END AS t,
    proof || coalesce(s.h, '') AS proof, p.idx // 2 AS idx, (p.n + 1) // 2 AS n)
  FROM {p} p LEFT JOIN {a} s ON s.g = p.g AND s.idx = xor(p.idx, 1)
)"""

    steps += [level(f"a{i}", f"a{i + 1}", f"p{i}", f"p{i + 1}") for i in range(levels)]
    steps.append(
        f"""subroots AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM a{levels}),
b0 AS MATERIALIZED (SELECT '' AS g, idx, n, h FROM subroots),
q0 AS MATERIALIZED (SELECT p.doc_id, '' AS g, p.leaf, p.t, p.proof, s.idx, s.n, s.h AS subroot FROM p{levels} p JOIN subroots s USING (g))"""
    )
    steps += [level(f"b{i}", f"b{i + 1}", f"q{i}", f"q{i + 1}") for i in range(root_levels)]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = r.h AS verified FROM q{root_levels}, b{root_levels} r
"""


ORACLE["op12_merkle_manifest"] = _op12_sql(24, 4)


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), windows AS (
  SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase
  FROM (SELECT lang, d, w, unnest(range(1, len(w) - d + 2)) AS i FROM worded, (VALUES (1), (2), (3)) v(d))
), f AS MATERIALIZED (
  SELECT lang, d, phrase, count(*) AS a FROM windows GROUP BY lang, d, phrase
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE d = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, d, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE d > 1 AND a >= 10
), cuts AS (
  SELECT c.*, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 :], ' ') AS q FROM candidates c, (VALUES (1), (2)) v(k) WHERE k < d
), scored AS (
  SELECT c.lang, c.phrase, c.d, c.a, k, x.a AS l, y.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM candidates WHERE d = 3
  ) GROUP BY lang, part
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase WHERE g.most IS NULL OR 100 * g.most < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
