"""Secret scans: fixed patterns plus character Markov models, by DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a maximal run of the class is a match of its own, so the least length can stand in the pattern
_ACCESS = "AKIA[A-Z0-9]{14,}"
_HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_TOKEN = 20
_TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
#: documents of least hashed id whose words, and digests of whose ids, train the models
MAX_SAMPLE = 2_000
#: matches of a text placed in one go
_RUN = 128
#: nats a character by which the random model must beat the ordinary one
MARGIN = 2.0
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _walk(steps: Column, kind: str, advance: Callable, give: Callable) -> Column:
    """What ``give(state, step)`` gives along the steps, in one array of type ``kind``; the state is a number from 0.

    An array that grows is copied at every step: runs of a few steps keep those short, however many steps there are.
    """
    def run(part: Column, state: Column) -> Column:
        return F.aggregate(
            part, F.struct(state.alias("at"), F.array().cast(kind).alias("out")),
            lambda s, x: F.struct(advance(s["at"], x).cast("int").alias("at"), F.concat(s["out"], give(s["at"], x)).alias("out")),
        )

    return let(steps, lambda all_: F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _RUN).cast("int")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda s, k: let(run(F.slice(all_, k * _RUN + 1, F.lit(_RUN)), s["at"]), lambda r: F.struct(
            r["at"].alias("at"), F.array_append(s["out"], r["out"]).alias("out")
        )),
        lambda s: F.flatten(s["out"]),
    ))


def _untouched(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps, in one sweep over both by start. Tokens do not overlap one another, so one that
    ends after a base span has begun has that span right behind it."""
    def sweep(both: Column) -> Column:
        steps = F.arrays_zip(both.alias("x"), F.slice(both, F.lit(2), F.size(both)).alias("next"))
        # the state is how far the base spans seen reach
        return _walk(
            steps, _SPAN, lambda reach, s: F.when(s["x"]["rank"] < 3, F.greatest(reach, s["x"]["end"])).otherwise(reach),
            lambda reach, s: F.when(
                (s["x"]["rank"] == 3) & (reach <= s["x"]["start"]) & ~F.coalesce((s["next"]["rank"] < 3) & (s["next"]["start"] < s["x"]["end"]), F.lit(False)),
                F.array(s["x"]),
            ).otherwise(F.array().cast(_SPAN)),
        )

    # equal starts: base spans first
    return F.when(F.size(tokens) > 0, let(F.sort_array(F.concat(base, tokens)), sweep)).otherwise(tokens)


def _spans(text: Column, pattern: str, rank: int, gate: Column | None = None, value_group: int = 0) -> Column:
    """Code point spans of the leftmost non-overlapping matches: matches and what lies between them have running lengths."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))

    def place(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), F.size(matches)).alias("b"), values.alias("v"))
        walked = _walk(
            steps, _SPAN, lambda at, x: at + F.length(x["b"]) + F.length(x["m"]),
            lambda at, x: F.array(F.struct(
                (at + F.length(x["b"])).alias("start"), F.lit(rank).alias("rank"), (at + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["v"].alias("value"),
            )),
        )
        return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast(_SPAN))

    return let(found if gate is None else F.when(gate, found).otherwise(none), place)


def base_spans(text: Column) -> list[Column]:
    """Spans of each fixed kind, with their values."""
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    assign = F.filter(_spans(text, _ASSIGN, 0, named, 2), lambda s: F.length(s["value"]) >= 12)
    return [assign, _spans(text, _ACCESS, 1, F.contains(text, F.lit("AKIA"))), _spans(text, _HEX, 2)]


def _states(token: Column) -> Column:
    """Place of every character in the alphabet, from 1; 0 for any other."""
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))))


_WIDTH = len(ALPHABET) + 1


def _steps(states: Column) -> Column:
    """Numbers of the transitions between neighbouring characters."""
    return F.transform(F.slice(states, F.lit(2), F.size(states)), lambda b, i: F.get(states, i) * _WIDTH + b)


def _identifiers(words: Column) -> Column:
    """The words as programs write them, one style after another: plain, camel case, snake case, paths, capitals, with digits."""
    low = lambda i: F.lower(F.get(words, i))
    head = lambda i: F.initcap(F.get(words, i))

    def style(i: Column) -> Column:
        return (
            F.when(i % 7 == 0, low(i))
            .when(i % 7 == 1, F.concat(low(i), head(i + 1), head(i + 2)))
            .when(i % 7 == 2, F.concat(head(i), head(i + 1)))
            .when(i % 7 == 3, F.concat_ws("_", low(i), low(i + 1), low(i + 2)))
            .when(i % 7 == 4, F.concat_ws("/", low(i), low(i + 1), F.concat(head(i + 2), head(i))))
            .when(i % 7 == 5, F.concat_ws("_", F.upper(F.get(words, i)), F.upper(F.get(words, i + 1)), (i % 100).cast("string")))
            .otherwise(F.concat_ws("-", low(i), F.concat(low(i + 1), (i % 1000).cast("string"))))
        )

    return F.when(F.size(words) > 2, F.transform(F.sequence(F.lit(0), F.size(words) - 3), style)).otherwise(words)


def labelled_strings(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(string, random): identifiers made of the words of a bounded sample of documents, and digests in base64, letters and digits, and hex.

    The sample is the ``max_sample`` documents of least hashed doc_id: the same for any order of the rows, from all over
    the corpus. Words are two letters or more.
    """
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_sample)
    own = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text")).join(F.broadcast(ids), "_id")
    words = own.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words"))
    named = words.select(F.explode(_identifiers(F.col("words"))).alias("string"))
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("_id").cast("string")), 256)
    made = ids.select(F.explode(F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 32), F.translate(F.base64(F.unhex(digest)), "+/=", ""))).alias("string"))
    return named.withColumn("random", F.lit(False)).union(made.withColumn("random", F.lit(True)))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every transition under the model of random strings and that of ordinary identifiers.

    What comes to the driver is at most one row per transition of the alphabet. Without samples every ratio is 0.
    """
    counts = (
        samples.select("random", _states(F.col("string")).alias("s")).select("random", F.explode(_steps(F.col("s"))).alias("step"))
        .groupBy("step").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect()
    )
    random, plain = [smooth] * _WIDTH**2, [smooth] * _WIDTH**2
    for c in counts:
        random[c.step] += c.r
        plain[c.step] += c.o
    out = []
    for a in range(_WIDTH):
        row = slice(a * _WIDTH, (a + 1) * _WIDTH)
        total_r, total_p = sum(random[row]), sum(plain[row])
        out += [round(math.log(r / total_r) - math.log(p / total_p), 6) for r, p in zip(random[row], plain[row])]
    return out


def ratio(token: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions; null under two characters."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")

    def mean(states: Column) -> Column:
        total = F.aggregate(_steps(states), F.lit(0.0), lambda s, k: s + F.get(table, k))
        return F.when(F.size(states) > 1, total / (F.size(states) - 1))

    return let(_states(token), mean)


def scan(docs: DataFrame, weights: list[float], margin: float = MARGIN) -> DataFrame:
    """One row per row: ``row`` (all columns), assign, access, hex, markov: spans (start, rank, end, value) by start.

    Positions are code points, ends exclusive. Null text is empty. A markov span is a token of at least 20 characters of
    the alphabet that no fixed span touches and that the model of random strings explains better by ``margin``. Repeated
    rows give repeated results; names of other columns cannot clash, as they stay inside ``row``.
    """
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    assign, access, hexes = base_spans(F.col("text"))
    rows = rows.select("row", "text", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), _spans(F.col("text"), _TOKEN, 3).alias("tokens"))
    base = F.concat("assign", "access", "hex")
    free = _untouched(F.col("tokens"), base)
    rows = rows.select("row", "assign", "access", "hex", free.alias("free"))
    return rows.select("row", "assign", "access", "hex", F.filter("free", lambda t: ratio(t["value"], weights) > margin).alias("markov"))


def listed(*spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.sort_array(F.concat(*spans))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
