"""Personal data by weak supervision (DataFrame only).

Base patterns give the sure spans. Further candidates (obfuscated addresses, numbers
without a country code, IPv6, digit runs that fail a check) and the base matches get the
votes of labelers: pattern, check, gazetteer, context and surroundings. Expectation
maximisation over the counted vote patterns of the whole corpus estimates how reliable
each labeler is; its posteriors train a logistic span classifier whose weights are then
part of a column expression. The patterns are counted by Spark, at most
4 kinds x 3^5 votes x 4 lengths rows reach the driver whatever the input.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import table

KINDS = ["email", "ip", "card", "phone"]
# The base patterns of the contract. The possessive forms match the same texts: no part
# can give back a character that a later part would need.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the base pattern.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot |\.)[A-Za-z0-9-]++){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
MORE_NEEDS = {"email": r"(?:[\[({] ?(?:at|AT|@) ?[\])}] ?| at )[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}]| dot |\.)", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|us|ca|ch|at|be|mx|br|jp|cn|in|au|ru|pl|se|no|dk|fi|pt"
CUES = {
    "email": r"e-?mail|mail|contact|write|correo|courriel|adresse|kontakt",
    "ip": r"\bip\b|host|server|address|addr|login|serveur|servidor",
    "card": r"card|visa|master|credit|payment|karte|carte|tarjeta|amex",
    "phone": r"phone|call|tel|mobile|cell|fax|dial|telefon|appel|llam",
}
AGAINST = r"version|release|isbn|order|invoice|serial|ref\b|section|chapter|token|sha|build"
LABELERS = ["pattern", "check", "gazetteer", "context", "edges"]
#: Chance that a vote is right before anything is counted, as pseudo-counts.
TRUST, WEIGHT, STEPS = {"pattern": 0.95, "check": 0.95, "gazetteer": 0.75, "context": 0.85, "edges": 0.65}, 50.0, 60
ACCEPT = 0.9
SPAN = "array<struct<start:int,k:int,end:int,m:string>>"


def luhn(digits: Column) -> Column:
    chars = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))

    def add(s, x):
        d = x.cast("int") * F.when(s["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((s["i"] + 1).alias("i"), (s["t"] + d - F.when(d > 9, 9).otherwise(0)).alias("t"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")), add)["t"] % 10 == 0


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?){3}$")
    n = F.length(digits(m))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def find(t: Column, kind: str, pattern: str, needs: str) -> Column:
    """All matches of pattern as (start, k, end, m) in code points."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(s, x):
        start = s["at"] + x["p"]
        return F.struct((start + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (start + x["n"]).alias("end"), x["m"].alias("m")))).alias("out"))

    return F.when(t.rlike(needs), F.aggregate(parts, zero, add)["out"]).otherwise(F.array().cast(SPAN))


def _found(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, t, base and other (candidates that overlap no base span), as arrays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    raw = rows.select("doc_id", "t", *(find(F.col("t"), k, BASE[k], NEEDS[k]).alias(k) for k in KINDS), *(find(F.col("t"), k, MORE[k], MORE_NEEDS[k]).alias(f"more_{k}") for k in MORE))
    good = lambda k: F.filter(k, lambda s: valid(k, s["m"]))
    bad = lambda k: F.filter(k, lambda s: ~valid(k, s["m"]) & (F.length(digits(s["m"])) >= 10))
    base = F.array_sort(F.concat(*map(good, KINDS)))
    failed = F.concat(*map(bad, ("ip", "card", "phone")))
    split = raw.select("doc_id", "t", base.alias("base"), F.concat(failed, *(f"more_{k}" for k in MORE)).alias("other"))
    apart = F.filter("other", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return split.withColumn("other", F.array_sort(F.array_distinct(apart)))


def _per_kind(k: Column, of) -> Column:
    out = F.lit(None)
    for i in reversed(range(len(KINDS))):
        out = F.when(k == i, of(KINDS[i])).otherwise(out)
    return out


def votes(t: Column, s: Column, strict: bool) -> Column:
    """0 abstains, 1 is for and 2 against the span, for each labeler; then its length class."""
    vote = lambda yes, no: F.when(yes, 1).when(no, 2).otherwise(0)
    m, k, n = s["m"], s["k"], F.length(digits(s["m"]))
    check = _per_kind(k, lambda kind: {"email": m.rlike(r"(?i)[a-z].*[a-z]{2}$"), "ip": valid("ip", m) | m.contains(":"), "card": valid("card", m), "phone": n.between(10, 15)}[kind])
    known = _per_kind(k, lambda kind: {"email": m.rlike(rf"(?i)[^a-z](?:{ENDINGS})$"), "ip": ~m.rlike(r"^(?:0|255)\."), "card": digits(m).rlike("^(?:4|5[1-5]|3[47]|6011|65)"), "phone": m.rlike(r"^(?:\+|\()")}[kind])
    before = F.lower(F.substring(t, F.greatest(s["start"] - 24 + 1, F.lit(1)), F.least(s["start"], F.lit(24))))
    context = vote(_per_kind(k, lambda kind: before.rlike(CUES[kind])), before.rlike(AGAINST))
    edge = F.concat(F.when(s["start"] > 0, F.substring(t, s["start"], F.lit(1))).otherwise(""), F.substring(t, s["end"] + 1, F.lit(1)))
    size = F.when(n >= 16, 3).when(n >= 13, 2).when(n >= 10, 1).otherwise(0)
    return F.array(F.lit(1 if strict else 0), vote(check, ~check), vote(known, ~known), context, vote(~edge.rlike(r"[\p{L}\p{N}_]"), F.lit(True)), size)


def estimate(counts: list[tuple[int, tuple[int, ...], int]]) -> dict[int, dict]:
    """EM over (kind, votes, count) rows, then a logistic classifier per kind.

    Returns per kind: bias and a weight for each (place, value) of the votes. Plain
    arithmetic over a table whose size does not depend on the input.
    """
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        post = {}
        for v, _ in rows:
            odds = sum((math.log(TRUST[name] / (1 - TRUST[name])) * {0: 0, 1: 1, 2: -1}[v[i]]) for i, name in enumerate(LABELERS))
            post[v] = 1 / (1 + math.exp(-odds))
        total = sum(n for _, n in rows)
        for _ in range(STEPS):
            prior = (sum(n * post[v] for v, n in rows) + 1) / (total + 2)
            table_: dict = {}
            for i, name in enumerate(LABELERS):
                for y in (0, 1):
                    seen = defaultdict(float)
                    for v, n in rows:
                        seen[v[i]] += n * (post[v] if y else 1 - post[v])
                    speaks = seen[1] + seen[2]
                    right = TRUST[name]
                    p1 = (seen[1] + WEIGHT * (right if y else 1 - right)) / (speaks + WEIGHT)
                    table_[i, y] = {0: 1.0, 1: p1, 2: 1 - p1}  # abstaining tells nothing
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(table_[i, 1][v[i]] / table_[i, 0][v[i]]) for i in range(len(LABELERS)))
                post[v] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        names = sorted({(i, x) for v, _ in rows for i, x in enumerate(v)})
        w, bias = dict.fromkeys(names, 0.0), 0.0
        for _ in range(400):  # gradient steps on the mean log loss, lightly held to zero
            slope, slope_bias = defaultdict(float), 0.0
            for v, n in rows:
                z = bias + sum(w[i, x] for i, x in enumerate(v))
                miss = (post[v] - 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))) * n / total
                slope_bias += miss
                for i, x in enumerate(v):
                    slope[i, x] += miss
            bias += 2 * slope_bias
            for key in names:
                w[key] += 2 * (slope[key] - 1e-4 * w[key])
        out[kind] = {"bias": bias, "weights": w, "posterior": post}
    return out


def train(found: DataFrame) -> dict[int, dict]:
    """Count the vote patterns of all candidates of the corpus and fit the classifier."""
    marked = F.concat(F.transform("base", lambda s: F.struct(s["k"].alias("k"), votes(F.col("t"), s, True).alias("v"))), F.transform("other", lambda s: F.struct(s["k"].alias("k"), votes(F.col("t"), s, False).alias("v"))))
    # explode_outer: with explode, a filter on the array would search every text twice.
    counts = found.select(F.explode_outer(marked).alias("c")).where("c is not null").groupBy("c.k", "c.v").count().collect()
    return estimate(sorted((r["k"], tuple(r["v"]), r["count"]) for r in counts))


def accepted(model: dict[int, dict], t: Column, s: Column) -> Column:
    """Whether the classifier takes the span."""
    v = votes(t, s, False)
    score = F.lit(-99.0)
    for kind, fit in model.items():
        z = F.lit(fit["bias"])
        for i in range(len(LABELERS) + 1):
            part = F.lit(0.0)
            for (place, value), weight in sorted(fit["weights"].items()):
                if place == i:
                    part = F.when(v[i] == value, float(weight)).otherwise(part)
            z = z + part
        score = F.when(s["k"] == kind, z).otherwise(score)
    return score >= math.log(ACCEPT / (1 - ACCEPT))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, t (the text, null as empty), base and spans, arrays
    of (start, k, end, m) by start and kind; positions are code points, end exclusive.

    spans are the base spans and those candidates that the classifier accepts; these
    overlap no base span. Repeated rows stay repeated, other columns are ignored, and
    without any candidate nothing is added. Two scans, and one shuffle of pattern counts.
    """
    found = _found(docs, id_col, text)
    model = train(found)
    if not model:
        return found.select("doc_id", "t", "base", F.col("base").alias("spans"))
    more = F.filter("other", lambda s: accepted(model, F.col("t"), s))
    return found.select("doc_id", "t", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, counts of base spans for each kind, base_sha256, spans. Null and
    empty texts have none; see find_spans()."""
    spans = find_spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(n, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(t: Column, spans: str) -> Column:
    """The text with [KIND] for each span; an overlapping later span ends the same mark."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(s, x):
        mark = F.when(x["start"] >= s["at"], F.concat(F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["k"]))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], mark).alias("out"))

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.concat(end["out"], F.substring(t, end["at"] + 1, F.lit(2147483647)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts is replaced by marks.

    Null and empty texts stay as they are. Each row is judged by its own text, so repeated
    rows, ties and null ids need no rule and no row goes. All columns of docs are kept.
    """
    other = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select(F.struct("text", *other).alias("row"), "text")
    spans = find_spans(packed, "row", "text")
    text = F.when(F.size("spans") > 0, redacted(F.col("t"), "spans")).otherwise(F.col("doc_id.text"))
    out = spans.select(*(F.col(f"doc_id.{c}").alias(c) for c in other), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
