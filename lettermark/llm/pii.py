"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Everything is DataFrame and SQL functions; only the aggregates of a round (one row a kind) and the classifier's moment
sums reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermark.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, written so that a search takes linear time: a run is entered at its start, or where the last match
# ended, and never given back. Digit runs outside 13 to 19 digits cannot pass and are left out at once.
#: pattern name: (kind, regular expression, what a text must hold at least)
PATTERNS = {
    "email": ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "text LIKE '%@%'"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text RLIKE r'[0-9]\.[0-9]'"),
    "card": ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", r"text RLIKE r'[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'"),
    "phone": ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "text LIKE '%+%'"),
    "phone_local": ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"text RLIKE r'[0-9]{3}[ .-][0-9]{4}'"),
    "email_spelled": ("email", r"[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+", r"text RLIKE r'[(\[]at[)\]]'"),
}

# Fixed values of the gazetteer labeler.
TOP_DOMAINS = "com org net edu gov mil int info io co uk de fr es it nl be ch at pl se no dk fi pt ie us ca au nz jp cn in br mx ru eu".split()
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|35|36|6011|64|65)"
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[01]|8[58][0-9]|9[679][0-9])"
#: Words before a span that speak for its kind, and such as speak against any.
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(ip|address|host|server|client|addr)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|cell|fax|contact)\b",
}
AGAINST = r"(?i)\b(version|ver|v|build|release|isbn|issn|doi|token|sha|hash|serial|section|page|commit)\b\W{0,6}$"
LABELERS = ["checks", "gazetteer", "context", "border", "shape"]


def _vote(yes: str, no: str) -> Column:
    return F.expr(f"CASE WHEN {yes} THEN 1 WHEN {no} THEN 0 END")


def _per_kind(column: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in column.items()) + " END"


def candidates(docs: DataFrame) -> DataFrame:
    """Candidate spans of `docs` (doc_id, text): row_key, pattern, kind, start, end, value and the text around it.

    Starts and ends count code points. Equal rows of `docs` give their candidates once.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    parts = []
    for name, (_, pattern, least) in PATTERNS.items():
        found, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        parts.append(F.when(F.expr(least), F.struct(F.lit(name).alias("pattern"), found.alias("found"), gaps.alias("gaps"))))
    parts = own.select("row_key", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("row_key", "p.*").where("size(found) > 0")
    rows = parts.select("row_key", "pattern", "gaps", F.posexplode("found").alias("i", "value")).where("value IS NOT NULL")
    rows = rows.select(
        "row_key", "pattern", "i", "value", F.length(F.get("gaps", "i")).alias("gap"),
        F.right(F.get("gaps", "i"), F.lit(40)).alias("before"), F.left(F.get("gaps", F.col("i") + 1), F.lit(20)).alias("after"),
    ).dropDuplicates(["row_key", "pattern", "i"])
    upto = Window.partitionBy("row_key", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    kind = F.create_map(*[F.lit(x) for name, (k, _, _) in PATTERNS.items() for x in (name, k)])
    return rows.select("row_key", "pattern", F.element_at(kind, F.col("pattern")).alias("kind"), (end - F.length("value")).alias("start"), end.alias("end"), "value", "before", "after")


def voted(spans: DataFrame) -> DataFrame:
    """The candidates with `votes`, one of 1, 0 or NULL for each of LABELERS, `base` and `long`."""
    spans = spans.withColumn("digits", F.regexp_replace("value", "[^0-9]", "")).withColumn("parts", F.expr("IF(kind = 'ip', transform(split(value, '[.]'), x -> ltrim('0', x)), array())"))
    luhn = "aggregate(sequence(1, length(digits)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substr(reverse(digits), i, 1)) ELSE int(substr(reverse(digits), i, 1)) * 2 - IF(substr(reverse(digits), i, 1) > '4', 9, 0) END) % 10 = 0"
    valid = _per_kind({
        "email": "pattern = 'email'",
        "ip": "forall(parts, x -> length(x) < 3 OR (length(x) = 3 AND x <= '255'))",
        "card": f"length(digits) BETWEEN 13 AND 19 AND {luhn}",
        "phone": "pattern = 'phone' AND length(digits) BETWEEN 9 AND 15",
    })
    spans = spans.withColumn("base", F.expr(f"coalesce({valid}, false)"))
    known = "lower(regexp_extract(value, '([A-Za-z]+)[^A-Za-z]*$', 1)) IN (" + ", ".join(f"'{t}'" for t in TOP_DOMAINS) + ")"
    listed = _per_kind({"email": known, "ip": "value RLIKE r'^([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])[.]' AND value NOT LIKE '127.%'", "card": f"digits RLIKE r'{CARD_PREFIX}'", "phone": f"IF(pattern = 'phone', value RLIKE r'{COUNTRY_CODE}', NULL)"})
    cue = _per_kind({k: f"before RLIKE r'{v}'" for k, v in CUES.items()})
    against = f"before RLIKE r'{AGAINST}'"
    glued = "before RLIKE r'[A-Za-z0-9_=/#$-]$' OR after RLIKE r'^[A-Za-z0-9_=/]'"
    free = r"before RLIKE r'(^|[\s(<,:;])$' AND after RLIKE r'^($|[\s).,;:>!?])'"
    shaped = _per_kind({
        "email": "length(value) <= 254 AND value RLIKE r'^[^@(\\[]*[A-Za-z]'",
        "ip": "value NOT RLIKE r'(^|[.])0[0-9]'",
        "card": "value RLIKE r'^([0-9]+|[0-9]{4}([ -][0-9]{4}){2,3}([ -][0-9]{1,4})?|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})$'",
        "phone": "length(value) - length(replace(value, '(', '')) = length(value) - length(replace(value, ')', '')) AND value NOT RLIKE r'[ .-]{3}'",
    })
    return spans.select(
        "row_key", "pattern", "kind", "start", "end", "base", (F.length("value") > 24).alias("long"),
        F.array(_vote("base", "NOT base"), _vote(listed, f"NOT ({listed})"), _vote(f"{cue} AND NOT ({against})", against), _vote(free, glued), _vote(shaped, f"NOT ({shaped})")).alias("votes"),
    )


def _array(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def reliabilities(counted: DataFrame, rounds: int = 12) -> dict[str, tuple[float, list[float], list[float]]]:
    """Per kind: share of true spans, and how often each labeler says 1 on a true and on a false span.

    Expectation-maximisation over counted votes (kind, votes, n), begun from the share of ones among the votes. Every
    rate is smoothed, so that no labeler becomes certain.
    """
    truth = F.expr("(1 + size(filter(votes, v -> v = 1))) / (2 + size(filter(votes, v -> v IS NOT NULL)))")
    found: dict[str, tuple[float, list[float], list[float]]] = {}
    for _ in range(rounds):
        each = counted.withColumn("t", F.col("n") * truth).select("kind", "t", (F.col("n") - F.col("t")).alias("f"), F.posexplode("votes").alias("k", "v"))
        sums = [F.sum(F.when(rows, F.col(x)).otherwise(0.0)).alias(x + name) for x in "tf" for name, rows in (("all", F.lit(True)), ("cast", F.col("v").isNotNull()), ("one", F.col("v") == 1))]
        got = {(r["kind"], r["k"]): r for r in each.groupBy("kind", "k").agg(*sums).collect()}  # kinds x labelers
        for kind in {k for k, _ in got}:
            rows = [got[kind, k] for k in range(len(LABELERS))]
            rates = [[(r[x + "one"] + prior) / (r[x + "cast"] + 1) for r in rows] for x, prior in (("t", 0.8), ("f", 0.2))]
            found[kind] = ((rows[0]["tall"] + 1) / (rows[0]["tall"] + rows[0]["fall"] + 2), *rates)
        truth = posterior(found)
    return found


def posterior(found: dict[str, tuple[float, list[float], list[float]]]) -> Column:
    """The probability that a span of `kind` is true given its `votes`, as an expression."""
    cases = ""
    for kind, (share, true, false) in found.items():
        one = _array(math.log(t / f) for t, f in zip(true, false, strict=True))
        zero = _array(math.log((1 - t) / (1 - f)) for t, f in zip(true, false, strict=True))
        odds = f"aggregate(zip_with(votes, arrays_zip({one}, {zero}), (v, w) -> CASE v WHEN 1 THEN w.`0` WHEN 0 THEN w.`1` ELSE 0D END), {math.log(share / (1 - share))!r}D, (s, x) -> s + x)"
        cases += f" WHEN '{kind}' THEN 1 / (1 + exp(-({odds})))"
    return F.expr(f"CASE kind{cases} END") if cases else F.lit(None).cast("double")


def features() -> Column:
    """Inputs of the classifier as an array: length, pattern, and the votes for and against."""
    votes = [F.coalesce((F.get("votes", F.lit(k)) == x).cast("double"), F.lit(0.0)) for k in range(len(LABELERS)) for x in (0, 1)]
    return F.array(F.lit(1.0), F.col("long").cast("double"), *[(F.col("pattern") == p).cast("double") for p in PATTERNS], *votes)


def predicted(weights: list[float]) -> Column:
    """The classifier's probability from `x`."""
    return F.expr(f"1 / (1 + exp(-aggregate(zip_with(x, {_array(weights)}, (a, b) -> a * b), 0D, (s, v) -> s + v)))")


def classifier(counted: DataFrame, truth: Column, rounds: int = 6, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic model of the features on the estimated truth, by Newton steps over counted spans."""
    seen = cut_lineage(counted.select("n", truth.alias("p"), features().alias("x")))
    size = 2 + len(PATTERNS) + 2 * len(LABELERS)
    weights = np.zeros(size)
    for _ in range(rounds):
        fit = seen.withColumn("fit", predicted(weights.tolist()))
        left = fit.select("x", "fit", "n", "p", F.posexplode("x").alias("i", "a")).where("a != 0")
        both = left.select("i", (F.col("n") * (F.col("p") - F.col("fit")) * F.col("a")).alias("g"), F.expr("n * fit * (1 - fit) * a").alias("h"), F.posexplode("x").alias("j", "b"))
        moments = both.where("b != 0").groupBy("i", "j").agg(F.sum(F.col("h") * F.col("b")).alias("h"), F.sum("g").alias("g"))
        slope, bend = -ridge * weights, ridge * np.eye(size)
        for r in moments.collect():  # features x features
            bend[r["i"], r["j"]] += r["h"]
            slope[r["i"]] += r["g"] if r["i"] == r["j"] else 0.0
        weights = weights + np.linalg.solve(bend, slope)
    return weights.tolist()


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, counts and hash of the base spans, and all spans.

    Base spans always stay. A candidate that is none is added where the classifier gives it `least` or more and no base
    span overlaps it. NULL and empty texts have no spans, NULL ids and repeated rows are rows like others, other columns
    are ignored, and an empty table gives no rows. Positions are code points, the end is exclusive.
    """
    votes = cut_lineage(voted(candidates(docs)))
    # At most kinds x patterns x 2 * 3 ** labelers rows, whatever the corpus.
    counted = cut_lineage(votes.groupBy("kind", "pattern", "long", "votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    weights = classifier(counted, posterior(reliabilities(counted)))
    order = F.expr("array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), kind)")
    kept = votes.withColumn("x", features()).withColumn("p", predicted(weights)).where(F.col("base") | (F.col("p") >= least))
    span = F.struct(order.alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("base").alias("b"), F.col("kind"))
    spans = kept.groupBy("row_key").agg(F.array_sort(F.collect_set(span)).alias("all"))
    spans = spans.withColumn("own", F.expr("filter(all, x -> x.b)"))
    spans = spans.withColumn("all", F.expr("filter(all, x -> x.b OR NOT exists(own, y -> y.s < x.e AND x.s < y.e))"))
    text = "array_join(transform({}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    counts = [F.expr(f"size(filter(own, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    spans = spans.select("row_key", *counts, F.expr(text.format("own")).alias("own"), F.expr(text.format("all")).alias("spans"))
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).join(spans, "row_key", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
