"""Quality rules whose cutoffs are certified on labelled holdouts; DataFrame functions only.

Each rule rejects a document whose measure (marks per word, repeated lines, repeated word windows, odd
word length) is above a cutoff.  Cutoffs are chosen per stratum (language) so that wrongly rejecting good
documents is limited: candidate cutoffs come from quantiles of one half of the labelled rows; on the
other half the number of good documents above a cutoff is binomial, and a cutoff is certified when the exact
lower tail at the allowed rate is below the error probability divided by all tests made (Bonferroni),
which is the same as an exact upper confidence bound below that rate.  The allowed rate is shared out among
the rules, so a stratum's rules together keep to it.  Among certified cutoffs the one that gains most
on the first half counts; a stratum or rule without one rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import WORD_BREAK, WORD_CHAR, crc_of_id, if_small
from timeloom.plans.session import stage

MARKS = "#*$%&|<>"
#: Rule -> (numerator, denominator) of its measure.
RULES = {
    "marks": ("n_symbols", "n_words"),
    "same_lines": ("n_dup_lines", "n_lines"),
    "same_words": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
}
QUANTILES = [0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 1.0]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of every document; a missing text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"),
                       text.alias("text"))
    cut = base.select(
        "doc_id", "stratum",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", MARKS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHAR)).alias("lines"),
        F.filter(F.split("text", WORD_BREAK), lambda w: w != "").alias("words"),
    )
    hashed = cut.select(
        "doc_id", "stratum", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ids"),
    )
    # Windows of three words with their places; equal ones stand side by side once sorted.
    windows = F.when(F.size("ids") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("ids") - 3),
        lambda i: F.struct(F.xxhash64(F.get("ids", i), F.get("ids", i + 1), F.get("ids", i + 2)).alias("h"),
                           i.alias("at"))))
    plain = ["doc_id", "stratum", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words"]
    ordered = hashed.select(*plain, F.sort_array(windows).alias("w"))
    same = F.when(F.size("w") > 1, F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda j: (F.get("w", j)["h"] == F.get("w", j - 1)["h"])
        | (F.get("w", j)["h"] == F.get("w", j + 1)["h"])))
    found = ordered.select(*plain, F.sort_array(
        F.transform(same, lambda j: F.get("w", j)["at"])).alias("at"))
    covered = F.when(F.size("at") > 0, F.aggregate(
        F.sequence(F.lit(0), F.size("at") - 1), F.lit(0).cast("long"),
        lambda total, j: total + F.least(
            F.lit(3), F.coalesce(F.get("at", j + 1) - F.get("at", j), F.lit(3)))))
    return found.select(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _ratio(rule: str) -> Column:
    above, below = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def _log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series at n + 10, to about 1e-13."""
    x = n + F.lit(10.0)
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) \
        + 1 / (1260 * x * x * x * x * x)
    steps = F.lit(0.0)
    for i in range(1, 11):
        steps = steps + F.log(n + F.lit(float(i)))
    return series - steps


def lower_tail(n: Column, k: Column, rate: float, terms: int = 4000) -> Column:
    """P(at most k of n) at the given rate, for k below n * rate; 1 elsewhere (an upper bound).

    Summed from the term of k downwards; beyond ``terms`` terms the rest is bounded by a geometric sum.
    """
    odds = (1 - rate) / rate
    n, k = n.cast("double"), k.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(rate)) \
        + (n - k) * F.log1p(F.lit(-rate))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(state: Column, j: Column) -> Column:
        ratio = (k - j) / (n - k + j + 1) * odds
        return F.struct((state["sum"] + state["term"]).alias("sum"), (state["term"] * ratio).alias("term"))

    total = F.aggregate(F.sequence(F.lit(0), F.least(k.cast("int"), F.lit(terms))), start, add)
    ratio = k / (n - k + 1) * odds
    rest = F.when(k > terms, total["term"] / (1 - ratio)).otherwise(0.0)
    return F.when((n > 0) & (k < n * rate), F.least(F.lit(1.0), F.exp(top) * (total["sum"] + rest))).otherwise(1.0)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, rate: float = 0.04, error: float = 0.1,
                      price: float = 10.0) -> DataFrame:
    """stratum, rule, cutoff and the figures it rests on; only certified cutoffs that gain something.

    ``rate``: good documents that a stratum's rules together may reject; ``error``: probability that any
    cutoff breaks its share; ``price``: bad documents that a wrongly rejected good one is worth.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    # Documents the plain rules reject do not get here.
    rows = measured.where(~base_failed()).join(known, "doc_id").withColumn(
        "holdout", F.pmod(crc_of_id(), F.lit(2)) == 1)
    rule = F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), _ratio(r))])).alias("rule", "value")
    rows = stage(rows.select("stratum", "quality", "holdout", rule), "quality_labelled")
    good = F.col("quality") == 1
    grid = rows.where(~F.col("holdout") & good).groupBy("stratum", "rule").agg(
        F.percentile_approx("value", QUANTILES, 10_000).alias("cutoffs"))
    grid = grid.select("stratum", "rule", F.explode(F.array_distinct("cutoffs")).alias("cutoff"))
    grid = stage(grid, "quality_grid")
    tests = max(1, grid.count())
    over = F.col("value") > F.col("cutoff")
    held = F.col("holdout")
    counts = rows.join(if_small(grid), ["stratum", "rule"]).groupBy("stratum", "rule", "cutoff").agg(
        F.count_if(held & good).alias("good"), F.count_if(held & good & over).alias("lost"),
        F.count_if(~held & ~good & over).alias("caught"), F.count_if(~held & good & over).alias("missed"))
    tail = lower_tail(F.col("good"), F.col("lost"), rate / len(RULES))
    gain = F.col("caught") - price * F.col("missed")
    passed = counts.withColumn("tail", tail).withColumn("gain", gain).where(
        (F.col("tail") <= error / tests) & (F.col("gain") > 0))
    return passed.groupBy("stratum", "rule").agg(
        F.max(F.struct("gain", "cutoff", "good", "lost", "tail")).alias("best")).select(
        "stratum", "rule", "best.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """Counts of every document, base_failed and kept.

    ``labels`` has doc_id and quality (0, 1).  A missing text counts as empty, a missing language is a
    stratum of its own; rows are judged one by one, so repeated rows come back each; further columns are
    ignored; without labels only the plain rules reject.
    """
    measured = stage(measure(docs), "quality_counts")
    chosen = certified_cutoffs(measured, labels, **limits)
    wide = stage(chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")), "quality_cutoffs")
    out = measured.join(if_small(wide), "stratum", "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_ratio(rule) > F.col(rule), F.lit(False))
    failed = base_failed()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
