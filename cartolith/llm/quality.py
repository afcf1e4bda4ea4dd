"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Every document gets counts of its words, symbols, lines and repetitions. Two fixed rules fail a document
outright (``base_failed``). All further rules have cutoffs that are chosen from labelled documents, separately
for each stratum (language). A third of the labelled documents, by hash, proposes a path: from no cutoff at all, step
by step, the next cutoff of some rule that finds most bad documents for the good ones it loses. The other two thirds
test it: along the path, for all rules together, a step is certified while the exact binomial test rejects, at level
``delta`` / strata, that more than ``alpha`` of the stratum's good documents would be lost. The path doesn't depend on the
documents that test it, and testing in its order up to the first failure needs no correction along it; the
Bonferroni correction covers the strata. So with probability 1 - delta, every stratum loses at most ``alpha`` of its
good documents to the cutoffs.

A stratum with fewer good documents for the test than could certify anything by themselves is pooled with all others
of the kind. Only counts per stratum, rule and cell or step reach the driver, at most one in ``least_good`` labels.

Defined results: a null or empty text has no words and fails; a null language counts as an empty one; without labels
only the fixed rules apply; of several labels of a document the lowest counts; repeated rows are judged
alike; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
ALPHA, DELTA = 0.03, 0.05
#: A good document that a cutoff loses weighs as much as so many bad ones that it finds.
GOOD_WEIGHT = 10

#: Rules: name, sign (+1: high values are bad), grid from lenient to strict.
RULES: list[tuple[str, int, list[float]]] = [
    ("symbols", 1, [round(3 * 0.8**k, 6) for k in range(24)]),
    ("capitals", 1, [round(0.9 - 0.035 * k, 6) for k in range(24)]),
    ("sameness", 1, [round(0.995 - 0.02 * k, 6) for k in range(24)]),
    ("dup_lines", 1, [round(0.95 - 0.035 * k, 6) for k in range(24)]),
    ("repeats", 1, [round(0.95 - 0.035 * k, 6) for k in range(24)]),
    ("long_words", 1, [round(14 - 0.4 * k, 6) for k in range(24)]),
    ("short_words", -1, [round(1 + 0.15 * k, 6) for k in range(24)]),
]


def _pairs(a: Column, n: Column, f) -> Column:
    """``f`` of each two neighbours of the array ``a`` of ``n`` elements."""
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(2), m), f)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum and counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more."""
    stratum = F.coalesce(docs[stratum_col].cast("string"), F.lit("")) if stratum_col and stratum_col in docs.columns else F.lit("")
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        "stratum",
        F.filter(F.split("text", SPACE, -1), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("lines"),
        F.length("text").alias("chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    )
    n = F.size("words")
    d = d.select(
        "doc_id",
        "stratum",
        "chars",
        "n_symbols",
        "n_capitals",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # only texts with equal windows are sorted by window; their places, in order, tell what the windows cover
    sorted_ = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    both = _pairs(sorted_, F.size("windows"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("places", F.when(again, F.sort_array(F.array_distinct(F.flatten(both)))).otherwise(F.array().cast("array<int>"))).drop("windows")
    steps = _pairs(F.col("places"), F.size("places"), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("places") > 0, F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def rule_values() -> dict[str, Column]:
    n, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    length = F.when(F.col("n_words") > 0, F.col("word_chars") / n)
    return {
        "symbols": F.col("n_symbols") / n,
        "capitals": F.col("n_capitals") / chars,
        "sameness": 1 - F.col("n_distinct") / n,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / n,
        "long_words": F.coalesce(length, F.lit(5.0)),
        "short_words": F.coalesce(length, F.lit(5.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with probability p, exactly but for rounding."""
    if k >= n:
        return 1.0
    log_p, log_q, log_n = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(log_n - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of k of n at level 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def least_good(alpha: float, delta: float) -> int:
    """Good documents without a loss that certify a share of ``alpha`` at level ``delta``."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def propose(lost: dict[str, tuple[list[int], list[int]]]) -> list[tuple[str, int]]:
    """A path of (rule, place on its grid): ``lost`` has the good and bad documents beyond each cutoff of a rule.

    Each step is that of the best gain per document found; it ends where no cutoff gains.
    """
    at, path = dict.fromkeys(lost, -1), []
    while True:
        best, gain = None, 0.0
        for rule, (good, bad) in sorted(lost.items()):
            k0 = at[rule]
            for k in range(k0 + 1, len(good)):
                b, g = bad[k] - (bad[k0] if k0 >= 0 else 0), good[k] - (good[k0] if k0 >= 0 else 0)
                if b - GOOD_WEIGHT * g > 0 and (b - GOOD_WEIGHT * g) / (b + g) > gain:
                    best, gain = (rule, k), (b - GOOD_WEIGHT * g) / (b + g)
        if best is None:
            return path
        at[best[0]] = best[1]
        path.append(best)


def certified(lost: list[int], n_good: int, alpha: float, delta: float) -> int:
    """Steps of a path, from the first, that all pass the test; ``lost``: good documents lost up to each."""
    for k, g in enumerate(lost):
        if n_good == 0 or binomial_cdf(g, n_good, alpha) > delta:
            return k
    return len(lost)


_OTHERS = "\0others"


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule; ``_OTHERS`` pools the strata that have none of their own.

    ``measured``: rows of ``measures``; ``labels``: doc_id, quality (1 good).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    values = rule_values()
    # the number of grid cutoffs that a document violates: cutoffs are in order, so it violates the last ones
    met = [sum(((values[name] > c) if sign > 0 else (values[name] < c)).cast("int") for c in grid).alias(name) for name, sign, grid in RULES]
    rows = measured.where(~base_failed()).join(known, "doc_id").select("stratum", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("test"), *met)
    rows = table(rows, "labelled-measures")
    least = least_good(alpha, delta)
    own = [r.stratum for r in rows.where("good and test").groupBy("stratum").count().where(F.col("count") >= least).collect()]
    named = F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(F.lit(_OTHERS)) if own else F.lit(_OTHERS)
    rows = rows.withColumn("stratum", named)
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name, _, _ in RULES])
    counts = rows.where("not test").select("stratum", "good", F.explode(cells).alias("c")).groupBy("stratum", "good", "c.rule", "c.n").count().collect()
    found: dict[str, dict] = {}
    for r in counts:
        found.setdefault(r.stratum, {}).setdefault(r.rule, {}).setdefault(r.good, {})[r.n] = r["count"]
    sizes = {name: len(grid) for name, _, grid in RULES}
    beyond = lambda by, size: [sum(c for n, c in by.items() if n >= size - k) for k in range(size)]
    paths = {s: propose({name: (beyond(by.get(True, {}), sizes[name]), beyond(by.get(False, {}), sizes[name])) for name, by in rules.items()}) for s, rules in found.items()}
    # the first step of its stratum's path that a document fails
    step = F.lit(None).cast("int")
    for s, path in paths.items():
        fails = [F.when(F.col(rule) >= sizes[rule] - k, j) for j, (rule, k) in enumerate(path)]
        if fails:
            step = F.when(F.col("stratum") == s, F.coalesce(*fails)).otherwise(step)
    tested: dict[str, dict] = {}
    for r in rows.where("test and good").groupBy("stratum", step.alias("step")).count().collect():
        tested.setdefault(r.stratum, {})[r.step] = r["count"]
    out: dict[str, dict[str, float]] = {}
    level = delta / max(1, len({*paths, *tested}))
    grids = {name: grid for name, _, grid in RULES}
    for s, path in paths.items():
        by = tested.get(s, {})
        lost = [sum(c for j, c in by.items() if j is not None and j <= k) for k in range(len(path))]
        passed = path[: certified(lost, sum(by.values()), alpha, level)]
        out[s] = {rule: grids[rule][k] for rule, k in passed}  # later steps of a rule are the stricter ones
    return out | {s: {} for s in (*own, _OTHERS) if s not in out}


def verdict(cutoffs: dict[str, dict[str, float]]) -> Column:
    """Whether a measured row keeps all rules of its stratum."""
    values, fine = rule_values(), ~base_failed()
    named = [s for s in cutoffs if s != _OTHERS]
    for name, sign, _ in RULES:
        of = [(s, c[name]) for s, c in cutoffs.items() if name in c and s != _OTHERS]
        cut = F.lit(None).cast("double")
        if of:
            cut = F.element_at(F.create_map(*[F.lit(x) for pair in of for x in pair]), F.col("stratum"))
        if name in cutoffs.get(_OTHERS, {}):
            cut = F.when(F.col("stratum").isin(named), cut).otherwise(cutoffs[_OTHERS][name]) if named else F.lit(cutoffs[_OTHERS][name])
        fine = fine & ~F.coalesce((values[name] > cut) if sign > 0 else (values[name] < cut), F.lit(False))
    return fine


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, all measures, base_failed and kept. The texts are read once; the measures are written down."""
    measured = table(measures(docs), "measures")
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", verdict(calibrate(measured, labels)))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
