"""Confidence, probability and entropy expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import literal_map


def clip01(col: Column) -> Column:
    """Clamp to [0, 1]; NULL stays NULL."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col.cast("double"))))


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def probs_entropy(probs: Column) -> Column:
    """Entropy in nats over the non-negative probabilities, renormalised."""
    vals = F.filter(F.map_values(probs), lambda p: p >= 0)
    total = array_sum(vals)
    terms = F.transform(vals, lambda p: -(p / total) * F.log(p / total + F.lit(1e-12)))
    return F.when((F.size(vals) > 0) & (total > 0), array_sum(terms))


def probs_max(probs: Column) -> Column:
    return F.array_max(F.filter(F.map_values(probs), lambda p: p >= 0))


def confidence_from_probs(confidence: Column, probs_json: Column, pred: Column) -> Column:
    """Stored confidence, else the probability of the predicted label."""
    parsed = F.from_json(probs_json, "map<string,double>")
    return F.coalesce(confidence.cast("double"), F.try_element_at(parsed, pred))


def softmax_reliability(scores: Column, labels: list[str]) -> Column:
    """Softmax over clamped label scores and the reliability figures built on it."""
    raw = F.array(
        *[F.coalesce(clip01(F.try_element_at(scores, F.lit(x))), F.lit(0.0)) for x in labels]
    )
    top = F.array_max(raw)
    exps = F.transform(raw, lambda x: F.exp(x - top))
    probs = F.transform(exps, lambda x: x / array_sum(exps))
    return _reliability(probs, len(labels))


def _reliability(probs: Column, k: int) -> Column:
    entropy = array_sum(F.transform(F.filter(probs, lambda p: p > 0), lambda p: -p * F.log2(p)))
    ranked = F.sort_array(probs, asc=False)
    best = ranked[0]
    margin = best - ranked[1] if k > 1 else best
    certainty = clip01(1 - entropy / F.log2(F.lit(float(k)))) if k > 1 else F.lit(0.0)
    return F.struct(
        F.round(entropy, 4).alias("label_entropy_bits"),
        F.round(certainty, 4).alias("label_entropy_normalized"),
        F.round(best, 4).alias("softmax_max_prob"),
        F.round(margin, 4).alias("softmax_margin_top1_top2"),
        F.round(0.5 * best + 0.5 * certainty, 4).alias("reliability_combined"),
    )


def probs_from_confidence(label: Column, confidence: Column, labels: list[str]) -> Column:
    """Confidence on the label, the rest spread evenly; uniform when unusable."""
    k = len(labels)
    c = clip01(F.when(~F.isnan(confidence.cast("double")), confidence))
    usable = label.isin(list(labels)) & c.isNotNull()

    def one(name: str) -> Column:
        if k == 1:
            return F.lit(1.0)
        given = F.when(label == name, c).otherwise((1.0 - c) / float(k - 1))
        return F.when(F.coalesce(usable, F.lit(False)), given).otherwise(F.lit(1.0 / k))

    return F.create_map(*[x for name in labels for x in (F.lit(name), one(name))])


def mask_disallowed(pred: Column, probs: Column, allowed: list[str]) -> Column:
    """Disallowed prediction becomes NULL; confidence is P(pred), else the largest."""
    ok = F.when(pred.isin(list(allowed)), pred)
    return F.struct(
        ok.alias("pred_label"),
        F.coalesce(F.try_element_at(probs, ok), F.array_max(F.map_values(probs))).alias(
            "confidence"
        ),
    )


def confidence_category(confidence: Column, correct: Column) -> Column:
    """Low / medium / high confidence crossed with the outcome."""
    level = (
        F.when((confidence > 0) & (confidence <= 0.5), "low")
        .when((confidence > 0.5) & (confidence <= 0.7), "medium")
        .when((confidence > 0.7) & (confidence <= 1.0), "high")
        .otherwise("nan")
    )
    return F.concat(F.when(correct, "correct_").otherwise("wrong_"), level)


def confident_but_wrong(confidence: Column, correct: Column, threshold: float = 0.67) -> Column:
    """P37."""
    return F.coalesce((confidence >= threshold) & ~correct, F.lit(False))


def call_share(tokens: Column, position: Column, n_rows: Column) -> Column:
    """One row's part of a call's tokens; the first rows take the remainder."""
    return F.floor(tokens / n_rows) + (position < tokens % n_rows).cast("bigint")


def level_distance(
    gold: Column, pred: Column, levels: dict[str, int], penalty: int = 4
) -> Column:
    """Ordinal distance of two labels; unknown labels cost ``penalty``."""
    table = literal_map(levels)
    gap = F.abs(F.try_element_at(table, gold) - F.try_element_at(table, pred))
    return F.coalesce(gap, F.lit(penalty))


def _log_gamma_rest(n: Column) -> Column:
    """log(n!) minus Stirling's main terms, n >= 0: tabled below 16, a series from there on."""
    small = [math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi) if i else 0.0) for i in range(16)]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n
    return F.when(n < 16, F.get(F.array(*map(F.lit, small)), n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x * log(x / mean) - x + mean, without the loss of digits near the mean."""
    return x * F.log1p((x - mean) / mean) - (x - mean)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Two-sided sign-test p-value of the discordant counts ``b`` and ``c``.

    The largest term of the tail comes from its saddle-point form, the others follow by their ratios, which only
    fall: after 9 standard deviations and 60 terms nothing is left that a double could hold.  One method at every size.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    half = n / 2
    log_term = (
        _log_gamma_rest(n) - _log_gamma_rest(k) - _log_gamma_rest(n - k) - _deviance(k, half) - _deviance(n - k, half)
        + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    )
    term = F.when(k == 0, F.pow(F.lit(0.5), n)).otherwise(F.exp(log_term))
    steps = F.greatest(F.lit(1), F.least(k, F.ceil(9 * F.sqrt(n)) + 60)).cast("bigint")
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), steps),
        F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("mass")),
        lambda s, i: F.struct(
            (s["ratio"] * F.greatest(k - i + 1, F.lit(0.0)) / (n - k + i)).alias("ratio"),
            (s["mass"] + s["ratio"] * F.greatest(k - i + 1, F.lit(0.0)) / (n - k + i)).alias("mass"),
        ),
    )["mass"]
    return F.when((n == 0) | (b == c), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * term * tail))
