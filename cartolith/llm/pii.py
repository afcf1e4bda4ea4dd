"""Personal data: fixed patterns, and further spans by weak supervision, in DataFrame functions alone.

Spans of the four base kinds come from fixed patterns and checks, and always stay. Further candidates (long
mixed strings, digit groups that fail the card check, digit groups written as identity numbers) are judged:

1. Labelers vote on every candidate, base spans included: pattern (its strict form), gazetteer (cue words of
   several languages shortly before it), counter-gazetteer (words that announce something else), context
   (assignment and quotes around it, or letters that it is part of) and variety of its characters.
2. Vote patterns are counted over all documents. Expectation-maximisation on those counts estimates how
   reliable each labeler is for either class, without any labels, and from that the posterior of each pattern.
3. A logistic span classifier is trained on features of the spans, weighted by these posteriors, again on
   counts of feature patterns, and decides about every candidate, also where labelers abstain.

Votes and features are categories, so that only a bounded number of patterns reaches the driver. Positions
are code points: splitting by a pattern gives the text between its matches, whose lengths add up to offsets.
The patterns are those documented below with possessive quantifiers and look-behinds, which find the same
matches in linear time.

Defined results: a null or empty text has no spans; repeated rows and null ids are treated alike; an empty
table gives no rows and fits no classifier (base spans only); other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "number", "identity"]

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": "@", "phone": "+"}

CUES = "token|key|secret|password|passwort|passwd|pwd|clave|mot de passe|mail|e-mail|correo|courriel|phone|tel|telefon|téléphone|teléfono|call|mobile|card|karte|carte|tarjeta|account|konto|compte|cuenta|iban|ssn|passport|contact|ip|address|adresse"
COUNTER_CUES = "version|license|licence|isbn|issn|page|figure|table|section|chapter|http|www|doi|rfc|revision|commit|build"

#: Code points that the cue labelers look at: a cue stands right before what it announces, the longest has 12.
BEFORE, AFTER = 32, 4

SPAN = "array<struct<start:int,end:int,kind:int,value:string,before:string,after:string>>"


#: Elements of a running total that are added up one by one; arrays are cut into blocks of so many, so that the work is linear.
STEP = 256


def _let(x: Column, body) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def _cut(a: Column) -> Column:
    """The array in blocks of ``STEP``; one empty block if it is empty."""
    last = F.greatest(F.floor((F.size(a) - 1) / STEP).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(a, j * STEP + 1, F.lit(STEP)))


def running(values: Column, op, start: int = 0) -> Column:
    """For each of the integers, ``op`` (associative) of it and all before it."""

    def one(a: Column) -> Column:
        zero = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

        def add(s: Column, x: Column) -> Column:
            return _let(op(s["at"], x).cast("int"), lambda y: F.struct(y.alias("at"), F.concat(s["out"], F.array(y)).alias("out")))

        return F.aggregate(a, zero, add)

    def joined(blocks: Column) -> Column:
        def add(s: Column, b: Column) -> Column:
            return F.struct(op(s["at"], b["at"]).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

        before = F.aggregate(blocks, F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b["out"], lambda x: op(at, x).cast("int"))))

    return _let(values, lambda v: _let(F.transform(_cut(v), one), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, name: str, kind: int) -> Column:
    """All matches of a pattern, leftmost first, with a little of the text around them."""
    pattern = PATTERNS[name]

    def of(v: Column) -> Column:
        parts, values = v["parts"], v["values"]
        m = F.size(values)
        gaps = F.zip_with(F.slice(parts, F.lit(1), m), values, lambda a, x: F.length(a) + F.length(x))
        around = F.zip_with(F.slice(parts, F.lit(1), m), F.slice(parts, F.lit(2), m), lambda a, b: F.struct(F.right(a, F.lit(BEFORE)).alias("before"), F.left(b, F.lit(AFTER)).alias("after")))
        placed = F.zip_with(running(gaps, _sum), values, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), x.alias("value")))
        return F.zip_with(placed, around, lambda s, w: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), w["before"].alias("before"), w["after"].alias("after")))

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    needed = F.contains(text, F.lit(_NEEDS[name])) if name in _NEEDS else F.rlike(text, F.lit("[0-9]"))
    return F.when(needed, _let(both, of).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    reversed_ = F.reverse(_digits(value))
    places = F.transform(F.split(reversed_, ""), lambda c, i: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _is_card(v: Column) -> Column:
    n = F.length(_digits(v))
    return F.when(n.between(12, 19), luhn(v)).otherwise(False)


def _is_ip(v: Column) -> Column:
    short = F.transform(F.split(v, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, F.when(p == "", 0).otherwise(p.try_cast("int"))) <= 255))


def _joined_to(s: Column) -> Column:
    """Whether a letter or digit stands right before or after a span."""
    return F.rlike(s["before"], F.lit("[\\p{L}\\p{N}]$")) | F.rlike(s["after"], F.lit("^[\\p{L}\\p{N}]"))


def _checks(name: str):
    return {
        "email": lambda s: F.lit(True),
        "ip": lambda s: _is_ip(s["value"]),
        "card": lambda s: _is_card(s["value"]),
        "phone": lambda s: F.length(_digits(s["value"])).between(9, 15),
        "secret": lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]")),
        # not the digits within a longer string, which is a candidate itself
        "number": lambda s: F.length(_digits(s["value"])).between(12, 19) & ~_is_card(s["value"]) & ~_joined_to(s),
        "identity": lambda s: F.lit(True),
    }[name]


def spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``base`` (sorted spans of the base kinds) and ``more`` (candidates that don't overlap them)."""
    matched = docs.select("*", *[_found(text, name, KINDS.index(name)).alias(f"{name}__") for name in PATTERNS])
    kept = {name: F.filter(f"{name}__", _checks(name)) for name in PATTERNS}
    kept["number"] = F.transform(F.filter("card__", _checks("number")), lambda s: s.withField("kind", F.lit(KINDS.index("number"))))
    judged = matched.select("*", F.array_sort(F.concat(*[kept[k] for k in BASE])).alias("base"), F.array_sort(F.concat(*[kept[k] for k in KINDS[len(BASE) :]])).alias("others__"))
    apart = _let(F.array_sort(F.concat("base", "others__")), _apart)
    return judged.select("*", F.when(F.size("others__") > 0, apart).otherwise(F.col("others__")).alias("more")).drop(*[f"{n}__" for n in PATTERNS], "others__")


def _apart(all_: Column) -> Column:
    """The spans of further kinds that overlap none of a base kind, of all spans in order: by the last end before and the first start after each."""
    is_base = lambda s: s["kind"] < len(BASE)
    far = (1 << 31) - 1
    until = running(F.transform(all_, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
    starts = F.reverse(F.transform(all_, lambda s: F.when(is_base(s), s["start"]).otherwise(far)))
    since = F.reverse(running(starts, F.least, far))
    around = F.zip_with(until, since, lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    free = F.zip_with(all_, around, lambda s, w: F.when(~is_base(s) & (w["u"] <= s["start"]) & (w["v"] >= s["end"]), s))
    return F.filter(free, lambda s: s.isNotNull())


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """What the labelers say of span ``s``: 1, -1, or 0 to abstain."""
    kind, value, before = s["kind"], s["value"], F.lower(s["before"])
    variety = F.size(F.array_distinct(F.split(value, "")))
    strict = F.when(kind <= 3, True).when(kind == 4, F.rlike(value, F.lit("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:sk|pk|ghp|AKIA)[_A-Za-z0-9-]+)$"))).when(kind == 6, True).otherwise(False)
    return {
        "pattern": _vote(strict, ~strict),
        "gazetteer": _vote(F.rlike(before, F.lit(rf"(?<!\p{{L}})(?:{CUES})(?!\p{{L}})[^\p{{L}}\p{{N}}]*$")), F.lit(False)),
        "counter": _vote(F.lit(False), F.rlike(before, F.lit(rf"(?<!\p{{L}})(?:{COUNTER_CUES})(?!\p{{L}})[^\p{{L}}\p{{N}}]*$"))),
        "context": _vote(F.rlike(before, F.lit("[=:]\\s*[\"']?$")), _joined_to(s)),
        "variety": _vote(variety >= 8, variety <= 4),
    }


def features(s: Column) -> dict[str, Column]:
    """Small categories of a span for the classifier."""
    value, n = s["value"], F.length(s["value"])
    digits = F.length(_digits(value)) / F.greatest(n, F.lit(1))
    variety = F.size(F.array_distinct(F.split(value, "")))
    return {
        "kind": s["kind"],
        "length": F.when(n < 12, 0).when(n < 20, 1).when(n < 32, 2).when(n < 48, 3).otherwise(4),
        "digits": F.when(digits < 0.2, 0).when(digits < 0.6, 1).when(digits < 0.95, 2).otherwise(3),
        "variety": F.when(variety <= 4, 0).when(variety < 8, 1).when(variety < 12, 2).otherwise(3),
        "hex": F.rlike(value, F.lit("^[0-9a-fA-F]+$")).cast("int"),
        "quoted": F.rlike(s["before"], F.lit("[\"'=:]\\s*[\"']?$")).cast("int"),
        "joined": _joined_to(s).cast("int"),
    }


FEATURES = ["kind", "length", "digits", "variety", "hex", "quoted", "joined"]
VOTES = ["pattern", "gazetteer", "counter", "context", "variety"]


@dataclass
class SpanModel:
    """The classifier: an intercept and a weight for each category; and the labelers' reliabilities."""

    intercept: float = -1.0
    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    reliability: dict[str, list[list[float]]] = field(default_factory=dict)

    def accepts(self, s: Column) -> Column:
        total = F.lit(float(self.intercept))
        own = features(s)
        for name, by in self.weights.items():
            for category, w in by.items():
                total = total + F.when(own[name] == category, float(w)).otherwise(0.0)
        return total > 0


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, kinds: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | class) as (labelers, 2 classes, votes -1, 0, 1)."""
    majority = patterns.sum(axis=1)
    post = 1 / (1 + np.exp(-majority.astype(float)))
    labelers = patterns.shape[1]
    table_ = np.empty((labelers, 2, 3))
    for _ in range(rounds):
        for j in range(labelers):
            for c, p in ((0, 1 - post), (1, post)):
                n = np.array([(counts * p)[patterns[:, j] == v].sum() for v in (-1, 0, 1)]) + 0.5
                table_[j, c] = n / n.sum()
        log = np.zeros((2, len(counts)))
        for k in np.unique(kinds):  # each kind has a rate of its own
            of = kinds == k
            rate = ((counts * post)[of].sum() + 1) / (counts[of].sum() + 2)
            log[0, of], log[1, of] = np.log(1 - rate), np.log(rate)
        for j in range(labelers):
            for c in (0, 1):
                log[c] += np.log(table_[j, c, patterns[:, j] + 1])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, table_


def logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method for weighted logistic regression; the first column of ``x`` is the intercept."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - total * p) - keep * w
        hessian = (x.T * (total * p * (1 - p))) @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: DataFrame) -> SpanModel:
    """Learn from rows with ``base`` and ``more``, over all of them."""
    s = F.col("s")
    rows = found.select(F.explode(F.concat("base", "more")).alias("s"))
    rows = rows.select(*[v.cast("int").alias(f"v_{k}") for k, v in votes(s).items()], *[v.cast("int").alias(f"f_{k}") for k, v in features(s).items()])
    names = [f"v_{k}" for k in VOTES] + [f"f_{k}" for k in FEATURES]
    counts = rows.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # a bounded number of patterns
    model = SpanModel()
    if not counts:
        return model
    data = np.array([[r[c] for c in names] for r in counts], np.int64)
    n = np.array([r.n for r in counts], float)
    patterns, feats = data[:, : len(VOTES)], data[:, len(VOTES) :]
    post, table_ = expectation_maximisation(patterns, n, feats[:, 0])
    model.reliability = {k: table_[j].tolist() for j, k in enumerate(VOTES)}
    columns, keys = [np.ones(len(n))], []
    for j, name in enumerate(FEATURES):
        for category in np.unique(feats[:, j]).tolist():
            columns.append((feats[:, j] == category).astype(float))
            keys.append((name, category))
    w = logistic(np.stack(columns, axis=1), n * post, n)
    model.intercept = float(w[0])
    for (name, category), value in zip(keys, w[1:].tolist()):
        model.weights.setdefault(name, {})[category] = round(value, 9)
    return model


def _joined(a: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, more: spans of every text. Written down, so that texts are read once."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return table(spans(slim, F.col("text")).select("doc_id", "base", "more"), "spans")


def accepted(found: DataFrame, model: SpanModel) -> Column:
    """All spans in order: those of ``base``, and those of ``more`` that the model accepts."""
    return F.array_sort(F.concat("base", F.filter("more", model.accepts)))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = extract(docs)
    model = fit(found)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(accepted(found, model)).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with each of the sorted spans ``found`` replaced by its kind in angle brackets; overlaps are taken together."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def of(spans_: Column) -> Column:
        done = running(F.transform(spans_, lambda s: s["end"]), F.greatest)
        placed = lambda d: F.zip_with(spans_, F.concat(F.array(F.lit(0)), d), lambda s, at: F.when(s.isNotNull(), F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return _let(done, lambda d: _let(F.slice(placed(d), F.lit(1), F.size(spans_)), lambda p: F.concat(F.array_join(F.transform(_cut(p), block), ""), F.substring(text, F.element_at(d, -1) + 1, F.lit(2147483647)))))

    def block(p: Column) -> Column:
        # a block's spans are cut from its own stretch of the text
        begin = F.get(p, F.lit(0))["at"]
        own = F.substring(text, begin + 1, F.array_max(F.transform(p, lambda s: s["end"])) - begin)
        piece = lambda t: lambda s: F.when(s["start"] >= s["at"], F.concat(F.substring(t, s["at"] - begin + 1, s["start"] - s["at"]), F.get(names, s["kind"]))).otherwise("")
        return _let(own, lambda t: F.array_join(F.transform(p, piece(t)), ""))

    return F.when(F.size(found) == 0, text).otherwise(_let(found, of))


def stage(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in its texts, ``n_chars`` brought up to date."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    model = fit(spans(packed, text).select("base", "more"))
    found = spans(packed, text)
    found = found.select("row", accepted(found, model).alias("found"))
    clean = found.select("row", F.when(F.size("found") > 0, redact(text, F.col("found"))).otherwise(F.col("row.text")).alias("clean"))
    columns = [F.col("clean").alias(c) if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return clean.select(*columns)
