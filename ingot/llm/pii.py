"""Operator 1: personal data by weak supervision (DataFrame functions only).

Regular expressions propose spans of six kinds. Four labelers vote on each one
(-1 no, 0 abstains, 1 yes): the strict form of its text, a gazetteer, the words around it, and the
characters at its ends. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern
is a true span; a logistic classifier is trained on those likelihoods and
decides on the spans beyond the base ones. Patterns are counted over all documents;
their number is bounded by the kinds and votes (PATTERNS), not by the data, and only their counts come to the driver.

Base spans (email, ip, card, phone as the contract defines them) always stay. A further span stays if the classifier
accepts it and it overlaps no base span and no earlier further span.

Offsets are code points, ends exclusive. Edge cases: a null or empty text has no spans; repeated rows
give equal rows; an empty table gives an empty result (the classifier then accepts nothing); only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import keyed, let, text_of

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")  # in the contract's order, then the further ones
BASE = 4
VOTES = 4
PATTERNS = len(KINDS) * 3**VOTES

# The contract's patterns. Possessive, as none of them can match by giving characters back; a run that has
# failed at its first character isn't tried again from its second, so the time is linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_REGEX = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",  # shorter runs can't hold 14 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Further candidates (fixed values)
EXTRA_REGEX = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?i:password|passwd|api_?key|token|secret)[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9+/_-]{12,}+[\"']?",
}
# Gazetteers (fixed values)
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu"
DIALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|55|61|81|82|86|90|91"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|3[068]"
RESERVED = "0|10|127|255|22[4-9]|23[0-9]|192\\.168|169\\.254"
NEAR = {
    "email": "mail|contact|write|reach",
    "ip": "ip|addr|host|server|client|login",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|tel|call|mobile|cell|fax|contact",
    "ssn": "ssn|social|security|tax",
    "secret": "key|auth|login|cred|pass|token|secret",
}
NOT_NEAR = r"version|section|figure|isbn|issn|page|serial|order|model|\bno\."
AROUND = 40  # code points before a span that the context labeler reads

SMOOTH = 1.0
EM_ROUNDS = 60
FIT_ROUNDS = 300
ACCEPT = 0.5

_SPAN = "struct<s:int,k:int,e:int,t:string>"


def _spans(text: Column, regex: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as (s, k, e, t), from the pieces between them."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"), F.split(text, regex, -1).alias("p")
    )

    def fold(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(F.get(x["p"], i))
            end = start + F.length(F.get(x["m"], i))
            span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), F.get(x["m"], i).alias("t"))
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        zero = zero.cast(f"struct<pos:int,out:array<{_SPAN}>>")
        return F.when(
            F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), zero, step)["out"]
        ).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return let(parts, fold)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _valid(kind: str, t: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        return t.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    n = F.length(_digits(t))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(t))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _marked(kind: str | None):
    """Adds b (a valid base match) and x (a further candidate) to a span; kind: of a base match."""
    return lambda c: c.withField("b", _valid(kind, c["t"]) if kind else F.lit(False)).withField("x", F.lit(kind is None))


def _candidates(text: Column) -> Column:
    """All proposed spans, with b: a base match that is valid."""
    none = F.array().cast(f"array<{_SPAN}>")
    has_digit = text.rlike("[0-9]")
    only_if = {
        "email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit,
        "phone": F.contains(text, F.lit("+")),
    }
    extra_if = {
        "email": text.rlike(r"[\[(] ?at ?[\])]"), "phone": has_digit, "ssn": has_digit,
        "secret": text.rlike("AKIA|(?i:password|passwd|api_?key|token|secret)"),
    }
    lists = []
    for kind, regex in BASE_REGEX.items():
        found = F.when(only_if[kind], _spans(text, regex, KINDS.index(kind))).otherwise(none)
        lists.append(F.transform(found, _marked(kind)))
    for kind, regex in EXTRA_REGEX.items():
        found = F.when(extra_if[kind], _spans(text, regex, KINDS.index(kind))).otherwise(none)
        lists.append(F.transform(found, _marked(None)))
    return F.sort_array(F.concat(*lists))


def _by_kind(k: Column, votes: dict[str, Column], other: Column) -> Column:
    out = None
    for kind, v in votes.items():
        test = k == KINDS.index(kind)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(other)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, -1 where ``no`` (by default: everywhere else), or else 0."""
    return F.when(yes, 1).otherwise(-1) if no is None else F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(text: Column, c: Column) -> list[Column]:
    t, digits = c["t"], _digits(c["t"])
    form = _by_kind(c["k"], {
        "email": _vote(t.rlike(r"^[A-Za-z0-9._%+-]{1,64}@.*\.[A-Za-z]{2,24}$|[\[(] ?at ?[\])]")),
        "ip": _vote(c["b"]),
        "card": _vote(c["b"]),
        "phone": _vote(F.length(digits).between(10, 15)),
        "ssn": _vote(~t.rlike("^(?:000|666|9)|-00-|-0000$")),
        "secret": _vote(t.rlike("[0-9]") & t.rlike("[A-Za-z]")),
    }, F.lit(0))
    listed = _by_kind(c["k"], {
        "email": _vote(t.rlike(rf"(?:\.|dot ?[\])]) ?(?:{DOMAINS})$"), F.lit(False)),
        "ip": _vote(F.lit(False), t.rlike(rf"^(?:{RESERVED})\.")),
        "card": _vote(digits.rlike(f"^(?:{ISSUERS})")),
        "phone": _vote(t.rlike(rf"^\+(?:{DIALLING})[^0-9]"), digits.rlike("^(?:0|1)[0-9]{9}$")),
        "secret": _vote(t.rlike("^(?:AKIA|(?i:password|passwd|api_?key|token|secret))"), F.lit(False)),
    }, F.lit(0))
    first = F.greatest(c["s"] - AROUND, F.lit(0))
    before = F.lower(F.substr(text, first + 1, c["s"] - first))
    context = _by_kind(c["k"], {k: _vote(before.rlike(words), before.rlike(NOT_NEAR)) for k, words in NEAR.items()}, F.lit(0))
    edges = F.concat(
        F.when(c["s"] > 0, F.substr(text, c["s"], F.lit(1))).otherwise(" "), F.lit("\n"),
        F.substr(text, c["e"] + 1, F.lit(2)),
    )
    apart = _vote(~edges.rlike(r"^[\p{L}0-9/_]|\n[\p{L}0-9/_]|\n[-.][0-9]"))
    return [form, listed, context, apart]


def candidates(docs: DataFrame) -> DataFrame:
    """The rows with ``_c``: every candidate as (s, k, e, t, b, x, v: the votes)."""
    text = F.col("_text")
    out = docs.withColumn("_c0", _candidates(text))
    return out.withColumn("_c", F.transform("_c0", lambda c: c.withField("v", F.array(*_votes(text, c))))).drop("_c0")


# --------------------------------------------------------------------------- the model


def label_model(patterns: list[tuple[int, tuple[int, ...], int]]) -> list[float]:
    """EM over (kind, votes, count): for each pattern the likelihood of a true span.

    One prior for each kind; one table P(vote | true or not) for each labeler.
    """
    like = [min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / VOTES)) for _, v, _ in patterns]
    for _ in range(EM_ROUNDS):
        prior = {}
        table = [{(y, v): SMOOTH for y in (0, 1) for v in (-1, 0, 1)} for _ in range(VOTES)]
        for (kind, votes, n), p in zip(patterns, like, strict=True):
            yes, total = prior.get(kind, (SMOOTH, 2 * SMOOTH))
            prior[kind] = (yes + n * p, total + n)
            for j, v in enumerate(votes):
                table[j][1, v] += n * p
                table[j][0, v] += n * (1 - p)
        sums = [{y: sum(t[y, v] for v in (-1, 0, 1)) for y in (0, 1)} for t in table]
        new = []
        for kind, votes, _ in patterns:
            yes, total = prior[kind]
            odds = math.log(yes / (total - yes))
            for j, v in enumerate(votes):
                odds += math.log(table[j][1, v] / sums[j][1]) - math.log(table[j][0, v] / sums[j][0])
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        like = new
    return like


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0] + [float(kind == k) for k in range(len(KINDS))] + [float(v) for v in votes]


def fit(patterns: list[tuple[int, tuple[int, ...], int]]) -> list[float]:
    """Weights of the span classifier: logistic regression on the label model's likelihoods."""
    size = 1 + len(KINDS) + VOTES
    weights = [0.0] * size
    total = sum(n for *_, n in patterns)
    if not total:
        return [-1.0] + weights[1:]
    rows = [(_features(k, v), n / total, p) for (k, v, n), p in zip(patterns, label_model(patterns), strict=True)]
    for _ in range(FIT_ROUNDS):
        slope = [0.001 * w for w in weights]
        for x, share, p in rows:
            z = sum(w * f for w, f in zip(weights, x, strict=True))
            error = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for j, f in enumerate(x):
                slope[j] += error * f
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def train(docs: DataFrame) -> list[float]:
    """Count the patterns of all candidates of all documents and fit the classifier."""
    spans = candidates(docs).select(F.explode("_c").alias("c"))
    counts = spans.groupBy(F.col("c.k").alias("k"), F.col("c.v").alias("v")).count()
    rows = counts.collect()  # at most PATTERNS rows
    assert len(rows) <= PATTERNS
    return fit(sorted((r["k"], tuple(r["v"]), r["count"]) for r in rows))


def _score(c: Column, weights: list[float]) -> Column:
    z = F.lit(weights[0])
    for k in range(len(KINDS)):
        z = z + F.when(c["k"] == k, F.lit(weights[1 + k])).otherwise(0.0)
    for j in range(VOTES):
        z = z + F.get(c["v"], F.lit(j)) * F.lit(weights[1 + len(KINDS) + j])
    return z


# --------------------------------------------------------------------------- results


def spans(docs: DataFrame) -> DataFrame:
    """The rows (``_text`` and any others) with ``_base`` and ``_all``: sorted spans (s, k, e)."""
    weights = train(docs)
    least = math.log(ACCEPT / (1 - ACCEPT))
    short = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    kind = "array<struct<s:int,k:int,e:int>>"

    def widened(base: Column, more: Column) -> Column:
        """base and those of ``more`` that overlap nothing taken before."""
        free = lambda acc, c: ~F.exists(acc, lambda o: (c["s"] < o["e"]) & (o["s"] < c["e"]))
        step = lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(c))).otherwise(acc)
        return F.when(F.size(more) == 0, base).otherwise(F.sort_array(F.aggregate(more, base.cast(kind), step)))

    out = candidates(docs)
    out = out.withColumn("_base", F.transform(F.filter("_c", lambda c: c["b"]), short))
    good = F.filter("_c", lambda c: c["x"] & (_score(c, weights) >= least))
    out = out.withColumn("_more", F.transform(good, short)).drop("_c")
    return out.withColumn("_all", widened(F.col("_base"), F.col("_more"))).drop("_more")


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ","
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans: one row per document."""
    found = spans(docs.select("doc_id", text_of().alias("_text")))
    count = lambda k: F.size(F.filter("_base", lambda c: c["k"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(BASE)],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"),
        F.size("_all").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one.

    The columns of ``docs``; n_chars, where the table has it, follows the text. Texts without spans stay as they are.
    """
    columns = docs.columns
    found = spans(keyed(docs, text_of()).withColumnRenamed("_k1", "_text"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("_text")

    def step(acc: Column, c: Column) -> Column:
        piece = F.concat(F.substr(text, acc["pos"] + 1, c["s"] - acc["pos"]), F.get(marks, c["k"]))
        new = F.struct(c["e"].alias("pos"), F.concat(acc["out"], F.array(piece)).alias("out"))
        wider = F.struct(F.greatest(acc["pos"], c["e"]).alias("pos"), acc["out"].alias("out"))
        return F.when(c["s"] >= acc["pos"], new).otherwise(wider)

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")).cast("struct<pos:int,out:array<string>>")
    done = let(
        F.aggregate("_all", zero, step),
        lambda x: F.concat(F.array_join(x["out"], ""), F.substr(text, x["pos"] + 1, F.length(text))),
    )
    found = found.withColumn("_new", F.when(F.size("_all") > 0, done).otherwise(F.col("_row.text")))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return found.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])
