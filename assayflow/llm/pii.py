"""Personal data by weak supervision (operator 9), DataFrame functions only.

Candidate spans come from a strict pattern per kind (the base) and looser
ones (spelled-out addresses, numbers without a country code, short or
unchecked card numbers, long-form network addresses). Five labelers vote on
every candidate: the strict pattern, a validity check, a gazetteer (domain
endings, issuer prefixes, country codes, reserved networks), the words before
it, and the characters around it. Expectation-maximisation over the counts of
(kind, votes) estimates how reliable each labeler is; its posteriors train a
logistic span classifier on the votes, which decides about the spans that are
not in the base. Base spans always stay.

The counts are one row per kind and vote pattern - at most 4 x 3^5 - whatever
the corpus, so estimation takes no data off the executors.

Matching is leftmost and non-overlapping per kind. Quantifiers are possessive
and attempts start at the edge of a run, so long runs cost linear time and no
stack. Positions are code points: the lengths of what lies between matches.

Defined results: NULL text counts as empty; each input row gives one row,
repeated rows and NULL ids included; extra columns are ignored; an empty
table gives no rows (and a classifier that adds nothing).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm.common import materialize, sql_strings, table

# Kinds in the order of reports.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Pattern:
    """One candidate pattern: ``guard`` is a cheap necessary condition."""
    kind: str
    base: bool
    regex: str
    guard: str


PATTERNS = (
    Pattern("email", True, rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    Pattern("email", False, rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?(?:\[at\]|\(at\)) ?{_LABEL}++"
                            rf"(?: ?(?:\[dot\]|\(dot\)|\.) ?{_LABEL}++)++", r"[\[(]at[\])]"),
    Pattern("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Pattern("ip", False, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
            r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    Pattern("card", True, r"[0-9](?:[ -]?[0-9]){15,}+", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    Pattern("card", False, r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9]){12,}+", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    Pattern("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    Pattern("phone", False, r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
            r"[0-9]{3}[ .-][0-9]{4}"),
)
#: The part of an address that must hold 0 to 255, and the full strict forms.
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Gazetteers and context words.
DOMAIN_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at")
ISSUER_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48",
                 "49", "52", "54", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91")
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "client", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "contact"),
}
#: Code points before a span in which context words count.
CONTEXT = 40
LABELERS = ("pattern", "valid", "gazetteer", "context", "edges")
EM_ROUNDS, FIT_ROUNDS = 50, 400
#: A span outside the base needs this probability.
ACCEPT = 0.9


def _spans(matches: Column, between: Column) -> Column:
    """Array of (start, end, value): ``between`` has one piece more."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.get(matches, i).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1),
                         F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.size(matches) > 0, walked).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_base(kind: str, value: Column) -> Column:
    """Whether a match of the kind's strict pattern passes its check."""
    if kind == "ip":
        return value.rlike(_IP_VALID)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _starts_with(value: Column, prefixes: Sequence[str]) -> Column:
    return value.rlike("^(?:" + "|".join(prefixes) + ")")


def _votes(kind: str, strict: bool, span: Column, text: Column) -> list[Column]:
    """One vote per labeler: 1 for, 0 against, -1 none."""
    value, digits = span["value"], _digits(span["value"])
    vote = lambda c: F.when(c, 1).otherwise(0)
    if kind == "email":
        ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
        valid, listed = F.length(ending) >= 2, ending.isin(*DOMAIN_ENDINGS)
    elif kind == "ip":
        valid, listed = value.rlike(_IP_VALID) if strict else F.lit(True), ~_starts_with(value, ("0", "127[.]", "255[.]", "2[4-5][0-9][.]"))
    elif kind == "card":
        valid, listed = F.call_function("luhn_check", digits), _starts_with(digits, ISSUER_PREFIXES)
    else:
        valid = F.length(digits).between(8, 15)
        listed = _starts_with(digits, COUNTRY_CODES) if strict else ~_starts_with(digits, ("0", "1"))
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1,
                                 F.least(span["start"], F.lit(CONTEXT))))
    near = before.rlike(r"\b(?:" + "|".join(CONTEXT_WORDS[kind]) + r")")
    left, right = F.substring(text, span["start"], F.lit(1)), F.substring(text, span["end"] + 1, F.lit(1))
    free = ~((span["start"] > 0) & left.rlike(r"[A-Za-z0-9=/_]")) & ~right.rlike(r"[A-Za-z0-9=/_]")
    return [F.lit(1 if strict else 0), vote(valid), vote(listed), F.when(near, 1).otherwise(-1), vote(free)]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans: kind (number), start, end, base, votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    none = F.array().cast("array<string>")
    cols = []
    for i, p in enumerate(PATTERNS):
        some = F.col("text").contains(p.guard) if p.guard == "@" else F.col("text").rlike(p.guard)
        cols += [F.when(some, F.regexp_extract_all("text", F.lit(p.regex), F.lit(0))).otherwise(none).alias(f"m{i}"),
                 F.when(some, F.split("text", p.regex, -1)).otherwise(none).alias(f"b{i}")]
    found = found.select("doc_id", "text", *cols)
    found = found.select("doc_id", "text", *[_spans(F.col(f"m{i}"), F.col(f"b{i}")).alias(f"s{i}")
                                             for i in range(len(PATTERNS))])

    def judged(i: int, p: Pattern) -> Column:
        return F.transform(f"s{i}", lambda s: F.struct(
            F.lit(KINDS.index(p.kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (_is_base(p.kind, s["value"]) if p.base else F.lit(False)).alias("base"),
            F.array(*_votes(p.kind, p.base, s, F.col("text"))).alias("votes")))

    every = found.select("doc_id", *[judged(i, p).alias(f"s{i}") for i, p in enumerate(PATTERNS)])
    base = F.concat(*[F.filter(f"s{i}", lambda s: s["base"]) for i, p in enumerate(PATTERNS) if p.base])
    rest = F.concat(*[F.filter(f"s{i}", lambda s: ~s["base"]) for i in range(len(PATTERNS))])
    return every.select("doc_id", base.alias("base"), rest.alias("rest")).select(
        "doc_id", "base", F.filter("rest", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))).alias("rest"))


# ------------------------------------------------------------ estimation
Counts = Mapping[tuple[int, tuple[int, ...]], int]


def vote_counts(spans: DataFrame) -> Counts:
    """Candidates per (kind, votes): a bounded number of rows."""
    each = spans.select(F.explode(F.concat("base", "rest")).alias("s"))
    rows = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes")).count().collect()
    return {(r["kind"], tuple(r["votes"])): r["count"] for r in rows}


def reliabilities(patterns: Sequence[tuple[tuple[int, ...], int]]) -> list[float]:
    """Posterior probability of every vote pattern of one kind, by
    expectation-maximisation over two classes. Rates have one pseudo-count
    and start as: a vote is right eight times of ten."""
    n = len(LABELERS)
    rate = {(j, v, c): (0.8 if v == c else 0.2) for j in range(n) for v in (0, 1) for c in (0, 1)}
    prior, post = 0.5, [0.0] * len(patterns)
    for _ in range(EM_ROUNDS):
        for i, (votes, _n) in enumerate(patterns):
            like = [1 - prior, prior]
            for j, v in enumerate(votes):
                if v >= 0:
                    like = [like[c] * rate[j, v, c] for c in (0, 1)]
            post[i] = like[1] / (like[0] + like[1])
        weight = [sum(k * (p if c else 1 - p) for (_v, k), p in zip(patterns, post)) for c in (0, 1)]
        prior = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        for j in range(n):
            for c in (0, 1):
                got = {v: 1 + sum(k * (p if c else 1 - p) for (votes, k), p in zip(patterns, post) if votes[j] == v)
                       for v in (0, 1)}
                for v in (0, 1):
                    rate[j, v, c] = got[v] / (got[0] + got[1])
    return post


def fit(counts: Counts) -> dict[int, list[float]]:
    """Per kind the weights of the span classifier: a bias, then one weight
    per labeler for its vote (+1 for, -1 against, 0 none), fitted to the
    posteriors with the counts as case weights."""
    weights = {}
    for kind in range(len(KINDS)):
        patterns = sorted((votes, k) for (of, votes), k in counts.items() if of == kind)
        if not patterns:
            continue
        post = reliabilities(patterns)
        rows = [([1.0] + [0.0 if v < 0 else (1.0 if v else -1.0) for v in votes], p, k)
                for (votes, k), p in zip(patterns, post)]
        total, w = sum(k for *_, k in rows), [0.0] * (len(LABELERS) + 1)
        for _ in range(FIT_ROUNDS):
            grad = [0.001 * x for x in w]
            for x, p, k in rows:
                z = sum(a * b for a, b in zip(w, x))
                err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * k / total
                grad = [g + err * b for g, b in zip(grad, x)]
            w = [a - 1.0 * g for a, g in zip(w, grad)]
        weights[kind] = w
    return weights


def probability(span: Column, weights: Mapping[int, Sequence[float]]) -> Column:
    """The classifier's probability of a span (0 for a kind never seen)."""
    p = F.lit(0.0)
    for kind, w in weights.items():
        z = F.lit(w[0])
        for j, wj in enumerate(w[1:]):
            v = F.get(span["votes"], F.lit(j))
            z = z + F.when(v == 1, wj).when(v == 0, -wj).otherwise(0.0)
        p = F.when(span["kind"] == kind, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(p)
    return p


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and added (spans the classifier accepts)."""
    spans = materialize(candidates(docs))
    weights = fit(vote_counts(spans))
    # numbers need a valid form before the classifier is asked (spelled-out
    # addresses are unambiguous); context is a vote like the others
    formed = lambda s: (s["kind"] == KINDS.index("email")) | (F.get(s["votes"], F.lit(1)) == 1)
    accepted = F.filter("rest", lambda s: formed(s) & (F.get(s["votes"], F.lit(0)) == 0)
                        & (probability(s, weights) >= ACCEPT))
    return spans.select("doc_id", "base", accepted.alias("added"))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, by kind, then start, comma-joined."""
    names = F.expr(f"array({sql_strings(KINDS)})")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(F.array_distinct(ordered), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_table(docs: DataFrame) -> DataFrame:
    """The digest columns of every input row."""
    n_of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return find(docs).select(
        "doc_id", *[n_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_table(table(spark, sf_dir, "documents"))
