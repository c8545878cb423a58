"""Secret scans (operator 10), in DataFrame functions only.

Three base rules find secrets by their form. Beyond them, a token is a secret if two character
Markov models, one of random strings and one of ordinary identifiers, say so: the log-likelihood
ratio of its character pairs is high. The models are counted from labelled samples by a grouped
count, so at most one row a class and pair (``SIDE`` squared) reaches the driver; the ratios return
to the plan as one literal array.

Positions come from the texts between matches: a split by the same pattern gives them in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

# The base rules. The hexadecimal and access rules have their least length in the
# pattern, which finds the same spans, as their matches are whole runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 6

#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Characters are numbered by code point from '+' to 'z'.
FIRST, SIDE = 43, 80
SPAN = "struct<start:int,end:int,kind:int>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, found: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans (array of SPAN) of ``found``, the matches of ``pattern``; those that ``keep`` marks, if given."""
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(
        F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), (keep if keep is not None else F.transform(found, lambda x: F.lit(True))).alias("keep")
    )
    each = F.transform(each, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), x["keep"].alias("keep")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(a, x):
        begin = a["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["keep"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(each, start, add, lambda a: a["spans"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__base``: the spans of the base rules, by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({"__assign": matches(t, ASSIGN), "__access": matches(t, ACCESS), "__hex": matches(t, HEX)})
    long = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_ASSIGNED)
    spans = F.concat(
        placed(t, F.col("__assign"), ASSIGN, 0, long),
        placed(t, F.col("__access"), ACCESS, 1),
        placed(t, F.col("__hex"), HEX, 2),
    )
    any_found = F.size("__assign") + F.size("__access") + F.size("__hex") > 0
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return found.withColumn("__base", F.when(any_found, ordered).otherwise(F.array().cast(f"array<{SPAN}>"))).drop("__assign", "__access", "__hex")


def samples(docs: DataFrame, train_rows: int = 2000, made: int = 1000) -> DataFrame:
    """Labelled samples (token, random): by the base rules and by construction.

    From at most ``train_rows`` documents (those first by a hash of doc_id), read once: what the
    base rules match is random; the distinct words of letters outside of it are ordinary, alone and
    joined as identifiers (snake, camel and kebab case, paths, with numbers). ``made`` strings of
    each of three random alphabets are added, and as many ordinary ones of each of these kinds:
    numbers, dates, times, versions and UUIDs.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).distinct()
    some = base_spans(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi"))
    matched = F.transform("__base", lambda s: F.expr("text").substr(s["start"] + 1, s["end"] - s["start"]))
    plain = F.regexp_extract_all(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit(r"[A-Za-z]{4,}"), F.lit(0))
    some = written(some.select(matched.alias("matched"), plain.alias("words")), "secrets-sample")
    secrets = some.select(F.explode("matched").alias("m"))
    secrets = secrets.select(F.regexp_extract("m", r"([A-Za-z0-9+/_-]+=*)[^A-Za-z0-9]*$", 1).alias("token"))
    number = lambda a, b: (F.length(a) * 37 + F.length(b) * 11).cast("string")
    forms = (
        lambda a, b: F.concat_ws("_", a, b),
        lambda a, b: F.concat(a, F.initcap(b)),
        lambda a, b: F.concat_ws("-", F.lower(a), F.lower(b)),
        lambda a, b: F.concat_ws("/", F.lower(a), F.lower(b)),
        lambda a, b: F.concat(F.upper(a), F.lit("_"), F.upper(b)),
        lambda a, b: F.concat(a, F.lit("_"), number(a, b)),
        lambda a, b: F.concat(b, number(a, b)),
    )

    def form(a, b):
        kind = F.pmod(F.length(a) * 5 + F.length(b), F.lit(len(forms)))
        out = F.when(kind == 0, forms[0](a, b))
        for k, f in enumerate(forms[1:], 1):
            out = out.when(kind == k, f(a, b))
        return F.coalesce(out, a)

    joined = F.zip_with("words", F.slice("words", 2, F.size("words")), form)
    words = some.where(F.size("words") > 1).select(F.explode(F.concat("words", joined)).alias("token")).distinct()
    seeds = docs.sparkSession.range(made).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    digits = F.regexp_replace("h", "[a-f]", "")
    moment = F.timestamp_seconds(F.lit(946684800) + F.col("id") * 7654321 % 1000000000)
    usual = F.array(
        F.substring(digits, 1, 24),
        F.date_format(moment, "yyyy-MM-dd"),
        F.date_format(moment, "yyyyMMddHHmmss"),
        F.concat_ws("-", F.lit("v"), F.col("id") % 17, F.col("id") % 23, F.col("id") % 7),
        F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
    )
    strings = F.array(
        F.substring(F.reverse("h"), 1, 40),
        F.regexp_replace(F.base64(F.unhex("h")), "=", ""),
        F.translate(F.base64(F.unhex(F.reverse("h"))), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    )
    ordinary = words.unionByName(seeds.select(F.explode(usual).alias("token")))
    return secrets.unionByName(seeds.select(F.explode(strings).alias("token"))).select("token", F.lit(1).alias("random")).unionByName(ordinary.select("token", F.lit(0).alias("random")))


def code(c: Column) -> Column:
    return F.ascii(c) - FIRST


def pairs(token: Column) -> Column:
    """Numbers of a token's character pairs."""
    return F.transform(
        F.when(F.length(token) > 1, F.sequence(F.lit(1), F.length(token) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: code(token.substr(i, F.lit(1))) * SIDE + code(token.substr(i + 1, F.lit(1))),
    )


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each character pair: random against ordinary.

    Each class is a first-order Markov model with additive smoothing. Without samples all ratios
    are 0, and no token is a secret by them.
    """
    token = F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "")
    counts = labelled.select("random", F.explode(pairs(token)).alias("pair")).where(f"pair between 0 and {SIDE * SIDE - 1}").groupBy("random", "pair").count().collect()
    seen = ([0.0] * (SIDE * SIDE), [0.0] * (SIDE * SIDE))
    for r in counts:
        seen[r.random][r.pair] += r["count"]
    ratios = []
    for a in range(SIDE):
        rows = [seen[y][a * SIDE : (a + 1) * SIDE] for y in (0, 1)]
        sums = [sum(r) + smoothing * SIDE for r in rows]
        ratios += [math.log((rows[1][b] + smoothing) / sums[1]) - math.log((rows[0][b] + smoothing) / sums[0]) for b in range(SIDE)]
    return ratios


def ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token."""
    known = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")
    return F.aggregate(pairs(token), F.lit(0.0), lambda a, p: a + F.coalesce(F.get(known, p), F.lit(0.0)))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", least: float = 24.0) -> DataFrame:
    """Add ``spans``: array of (start, end, kind) of all secrets, by start and kind.

    Positions are code points, ends exclusive; ``kind`` counts in ``KINDS``. A token that the models
    call random (ratio of at least ``least``) is added unless it overlaps a base span. Null and
    empty texts have no spans. Columns named ``spans`` or with the prefix ``__`` of this module are
    replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = base_spans(docs.drop("spans", "__base", "__tokens", "__random"), text).withColumn("__tokens", matches(t, TOKEN))
    judged = found.withColumn("__random", F.transform("__tokens", lambda x: ratio(x, ratios) >= least))
    extra = placed(t, F.col("__tokens"), TOKEN, 3, F.col("__random"))
    alone = F.filter(extra, lambda e: ~F.exists("__base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    both = F.array_sort(F.concat("__base", alone), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    spans = F.when(F.exists("__random", lambda r: r), both).otherwise(F.col("__base"))
    return judged.withColumn("spans", spans).drop("__tokens", "__random", "__base")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redacted(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace what the spans cover (overlapping ones together) by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(a, s):
        gap = F.col(text).substr(a["at"] + 1, s["start"] - a["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(gap, F.lit(mark))).alias("parts"))
        inside = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))
        return F.when((s["start"] >= a["at"]), fresh).otherwise(inside)

    rest = F.aggregate("spans", start, add, lambda a: F.concat(F.array_join(a["parts"], ""), F.col(text).substr(a["at"] + 1, F.length(text))))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, rest).otherwise(F.col(text)))
