"""Mix documents to target weights of domains they only partly belong to; DataFrame functions only.

A classifier fitted on a labelled table gives every document a posterior over domains: a Gaussian naive
Bayes model of a few rates (function words, letters, marks), so fitting is one aggregation and scoring an
expression.  Every document then gets a nonnegative rate, the number of times it is used, such that the expected
tokens of every domain meet its target: least squares, every domain in units of the share s_k it has unmixed,

    1/2 * sum_k ((sum_i t_i p_ik r_i) / T - b_k)**2 / s_k    over low <= r <= high,

by projected gradient.  A step moves every rate by its posteriors' share of what the domains lack and puts it
back between its bounds; scaled by s_k and by tokens the gradient's Lipschitz constant is one (the scaled
matrix has rows that sum to one), so the step has length one and needs no search.  Momentum speeds the
steps up and is dropped when they turn.  A step is one aggregation to K + 1 numbers over a narrow table; rates are
written every few steps, so plans stay short.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import WORD_BREAK, if_small
from timeloom.plans.session import release, stage

#: Strings whose rates tell domains apart: short words of four languages, letters, marks.
NEEDLES = (" the ", " of ", " and ", " de ", " la ", " le ", " les ", " et ", " que ", " el ", " un ",
           " der ", " die ", " und ", "sch", "é", "ü", "í", " | ", "###", "***", "&&&", "$$$", "%%%")
#: Smallest standard deviation of a feature.
FLOOR = 0.3
OTHER = "other"
#: What a domain may lack of its target, as a share of all tokens.
TOLERANCE = 1e-6
#: What further steps could still gain of the least squares where targets are out of reach.
GAP = 1e-6
#: Steps between two writes of the rates.
STEPS = 8


def _rate(needle: str) -> Column:
    """log of 1 + occurrences per thousand bytes."""
    size = F.octet_length("text")
    hits = (size - F.octet_length(F.replace("text", F.lit(needle), F.lit("")))) / len(needle.encode())
    return F.log1p(F.when(size > 0, 1000.0 * hits / size).otherwise(0.0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), tokens (words), x (an array of rates)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"))
    # The words of a text are its breaks plus one, but for breaks at either end.
    parts = F.size(F.split("text", WORD_BREAK))
    ends = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int") + F.col("text").rlike(r"[\x20\x09-\x0D]\z").cast("int")
    words = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), parts - ends).otherwise(0)
    return base.select("doc_id", F.xxhash64("text").alias("key"), words.cast("long").alias("tokens"),
                       F.array(*map(_rate, NEEDLES)).alias("x"))


def _model(measured: DataFrame, labelled: DataFrame, domains: list[str]) -> list[dict]:
    """Prior, means and variances of every domain: one row each."""
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("domain").alias("domain"))
    sums = [f(F.get("x", i)) for i in range(len(NEEDLES)) for f in (F.avg, F.var_pop)]
    rows = measured.join(known, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), F.array(*sums).alias("s"))
    found = {r["domain"]: r for r in rows.collect()}  # one row per domain
    total = sum(r["n"] for r in found.values())
    out = []
    for domain in domains:
        n, s = (found[domain]["n"], found[domain]["s"]) if domain in found else (0, None)
        out.append({"prior": (n + 0.5) / (total + 0.5 * len(domains)),
                    "mean": s[0::2] if s else None, "var": [max(v, FLOOR ** 2) for v in s[1::2]] if s else None})
    return out


def _posteriors(model: list[dict]) -> Column:
    """An array of posteriors; a domain without labelled rows keeps its prior weight only."""
    import math

    logs = []
    for m in model:
        score = F.lit(math.log(m["prior"]))
        if m["mean"] is not None:
            for i, (mean, var) in enumerate(zip(m["mean"], m["var"], strict=True)):
                d = F.get("x", i) - F.lit(float(mean))
                score = score - d * d / F.lit(2 * var) - F.lit(0.5 * math.log(var))
        else:
            score = score - F.lit(1e6)
        logs.append(score)
    return F.array(*logs)


def solve(step: Callable[[np.ndarray, float], tuple[np.ndarray, float]], share: np.ndarray, start: np.ndarray,
          goal: np.ndarray, rounds: int, tolerance: float, gap: float) -> tuple[np.ndarray, float]:
    """Take steps until targets are met or no better can be had; what each domain has too much, and the gap.

    ``share`` is every domain's share of the tokens at rate 1, ``start`` at the first rates (1 within the bounds).
    ``step(pull, momentum)`` goes from y = r + momentum * (r - previous r) against the gradient ``posteriors . pull``,
    bounds the rates, and returns the new shares with the least value over all bounded rates of the gradient times
    their distance from y, which bounds the optimum from below.
    """
    scale = np.where(share > 0, 1 / np.where(share > 0, share, 1), 0.0)
    over = before = start - goal
    pace, best, left = 1.0, -np.inf, np.inf
    for _ in range(rounds):
        if np.abs(over).max() <= tolerance or left <= gap:
            break
        following = (1 + np.sqrt(1 + 4 * pace ** 2)) / 2
        momentum = (pace - 1) / following
        at = over + momentum * (over - before)  # shares are linear in the rates
        pull = at * scale
        shares, least = step(pull, momentum)
        best = max(best, float(at @ pull) / 2 + least)
        now = shares - goal
        pace = 1.0 if pull @ (now - over) > 0 else following
        before, over = over, now
        left = float(over * scale @ over) / 2 - best
    return over, left


def soft_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rounds: int = 200,
             low: Column | float = 0.0, high: float = 8.0, tolerance: float = TOLERANCE,
             gap: float = GAP) -> DataFrame:
    """doc_id, key, tokens, posteriors (in the order of ``targets``), rate, copies.

    ``labelled`` has doc_id and domain; ``targets`` gives each domain's share of all tokens, scaled to sum 1.
    Targets that the bounds allow are met up to ``tolerance``; for others the least squares come within ``gap`` of
    their optimum.  A domain that no document belongs to is left out of account.  ``rounds`` bounds the steps; a
    warning tells when they end before that.
    ``low`` may be an expression over ``posteriors``.  ``copies`` rounds the rate up or down by a hash of
    the document, so that its expectation is the rate.  A missing text is empty, has no tokens and rate 1;
    rows are taken one by one, so repeated rows get the same rate; further columns are ignored.  Without
    labelled rows posteriors are uniform and all rates come out alike.
    """
    domains = list(targets)
    size, weight = len(domains), sum(targets.values())
    measured = stage(features(docs), "mix_features")
    model = _model(measured, labelled, domains)
    scored = measured.select("doc_id", "key", "tokens", _posteriors(model).alias("logs"))
    scored = scored.select("doc_id", "key", "tokens", F.transform(
        "logs", lambda v: F.exp(v - F.array_max("logs"))).alias("odds"))
    total = F.aggregate("odds", F.lit(0.0), lambda a, v: a + v)
    scored = scored.select("doc_id", "key", "tokens", total.alias("total"), "odds").select(
        "doc_id", "key", "tokens", F.transform("odds", lambda v: v / F.col("total")).alias("posteriors"))
    low_column = low if isinstance(low, Column) else F.lit(float(low))
    bounded = F.least(F.greatest(F.lit(1.0), F.col("low")), F.lit(float(high)))
    rows = stage(scored.withColumn("low", low_column.cast("double")).withColumn("rate", bounded)
                 .withColumn("previous", F.col("rate")), "mix_posteriors")
    release(measured)

    def weighed(of: str) -> list[Column]:
        return [F.expr(f"sum(tokens * ({of}) * get(posteriors, {k}))") for k in range(size)]

    first = rows.agg(F.sum("tokens"), *weighed("1D"), *weighed("rate")).first()
    tokens, done = first[0] or 0, 0

    def step(pull: np.ndarray, momentum: float) -> tuple[np.ndarray, float]:
        nonlocal rows, done
        if done and done % STEPS == 0:
            written = stage(rows, "mix_rates")
            release(kept.pop())
            kept.append(written)
            rows = written
        done += 1
        slope = " + ".join(f"get(posteriors, {k}) * ({float(v)!r}D)" for k, v in enumerate(pull))
        top = f"{float(high)!r}D"
        rows = rows.withColumn("y", F.expr(f"rate + ({float(momentum)!r}D) * (rate - previous)")).withColumn(
            "slope", F.expr(slope)).withColumn("previous", F.col("rate")).withColumn(
            "rate", F.expr(f"least(greatest(y - slope, low), {top})"))
        reach = F.expr(f"sum(tokens * slope * ((CASE WHEN slope > 0 THEN low ELSE {top} END) - y))")
        *sums, least = (float(v) / tokens for v in rows.agg(*weighed("rate"), reach).first())
        rows = rows.drop("y", "slope")
        return np.array(sums), least

    if tokens:
        kept = [rows]
        share, start = np.array(first[1:], dtype=float).reshape(2, size) / tokens
        goal = np.array([targets[d] / weight for d in domains])
        over, left = solve(step, share, start, goal, rounds, tolerance, gap)
        if np.abs(over).max() > tolerance and left > gap:
            logging.getLogger(__name__).warning(
                "mix: %.1e of the tokens amiss, gap %.1e after %d steps", np.abs(over).max(), left, done)
    out = rows.withColumn("rate", F.when(F.col("tokens") > 0, F.col("rate")).otherwise(1.0))
    dice = F.pmod(F.xxhash64("doc_id", "key", F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    return out.select("doc_id", "key", "tokens", "posteriors", "rate",
                      F.floor(F.col("rate") + dice).cast("int").alias("copies"))


def reached_shares(mix: DataFrame, targets: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Domain -> expected tokens of a mix as a share of all tokens before mixing, and its target."""
    sums = [F.expr(f"sum(tokens * rate * get(posteriors, {k})) / sum(tokens)") for k in range(len(targets))]
    weight = sum(targets.values())
    return {d: (s or 0.0, t / weight) for s, (d, t) in zip(mix.agg(*sums).first(), targets.items(), strict=True)}


def labelled_domains(docs: DataFrame, labels: DataFrame, poor: str = "poor") -> DataFrame:
    """doc_id, domain of labelled documents: the language of good ones, ``poor`` for the others."""
    known = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality"))
    langs = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"))
    return langs.join(known, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.coalesce("lang", F.lit(OTHER))).otherwise(poor).alias("domain"))


#: Shares of all tokens that the registered queries aim at.
TARGETS = {"en": 0.50, "de": 0.16, "fr": 0.16, "es": 0.14, "poor": 0.04}


def trim_to_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Documents brought towards the target shares without repeating any and without losing good ones.

    Rates are at most 1, and at least 1 for what the classifier does not hold to be of the poor domain, so only
    documents of that domain are thinned out; those with no copy go.  All columns are kept.
    """
    targets = targets or TARGETS
    poor = list(targets).index("poor")
    low = F.when(F.get("posteriors", poor) > 0.5, 0.0).otherwise(1.0)
    mix = soft_mix(docs, labelled_domains(docs, labels), targets, low=low, high=1.0)
    gone = stage(mix.where("copies = 0").select("doc_id", "key").distinct(), "mix_gone")
    same = F.col("g.doc_id").eqNullSafe(F.col("d.doc_id")) & (
        F.col("g.key") == F.xxhash64(F.coalesce("d.text", F.lit(""))))
    return docs.alias("d").join(if_small(gone).alias("g"), same, "left_anti")
