"""Column expressions over ratings and entailment probabilities. All stay in the JVM; nulls give nulls."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinionframe.functions.text import WHITE_SPACE, strip

EPS = 1e-6
#: The parameters of the formula family.
TEMPERATURES = (0.5, 0.7, 1.0, 1.3, 1.5, 2.0)
GAMMAS = (1.1, 1.2, 1.3, 1.4, 1.5, 1.6)


def clip(x: Column, lo: float = 1.0, hi: float = 5.0) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def half_even(x: Column) -> Column:
    """To the nearest whole rating, halves to the even one, within 1..5."""
    return clip(F.rint(x)).cast("int")


def expected_rating(entail: Column, neutral: Column, contradict: Column) -> Column:
    return clip(5 * entail + 3 * neutral + contradict)


def dual_rating(positive: Column, negative: Column, eps: float = 1e-4) -> Column:
    return clip(1 + 4 * positive / (positive + negative + eps))


def inverted(x: Column) -> Column:
    return clip(6 - x)


def softmax3(a: Column, b: Column, c: Column, temperature: float = 0.7) -> list[Column]:
    """Softmax of three scores with the greatest taken off first, so that nothing overflows."""
    top = F.greatest(a, b, c)
    e = [F.exp((x - top) / temperature) for x in (a, b, c)]
    return [x / (e[0] + e[1] + e[2]) for x in e]


def gold_direction(g: Column) -> Column:
    return F.when(g <= 2, "negative").when(g >= 4, "positive").when(g.isNotNull(), "neutral")


def predicted_direction(p: Column) -> Column:
    return F.when(p < 2.75, "negative").when(p <= 3.25, "neutral").when(p.isNotNull(), "positive")


def wrong_polarity(g: Column, p: Column) -> Column:
    return ((g >= 4) & (p < 2.75)) | ((g <= 2) & (p > 3.25))


def strong_wrong_polarity(g: Column, p: Column) -> Column:
    return ((g >= 4) & (p <= 2)) | ((g <= 2) & (p >= 4))


def sentiment_vector(x: Column) -> list[Column]:
    """Negative, neutral and positive membership of a rating; they add up to 1."""
    r = clip(x)
    low = r <= 3
    return [F.when(low, (3 - r) / 2).otherwise(0 * r), F.when(low, (r - 1) / 2).otherwise((5 - r) / 2), F.when(low, 0 * r).otherwise((r - 3) / 2)]


def vector_distances(g: Column, p: Column) -> dict[str, Column]:
    """L1, L2 and cosine of two ratings' vectors; the cosine is 0 beside a zero vector."""
    a, b = sentiment_vector(g), sentiment_vector(p)
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return {
        "l1": F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2]),
        "l2": F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2),
        "cosine": F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b))),
    }


def error_type(g: Column, p: Column) -> Column:
    """The first that applies, from the worst; ``near_miss`` is what remains."""
    d = p - g
    return (
        F.when(strong_wrong_polarity(g, p), "strong_wrong_polarity").when(wrong_polarity(g, p), "wrong_polarity")
        .when(d <= -2, "large_too_low").when(d >= 2, "large_too_high").when(d <= -1, "too_low").when(d >= 1, "too_high").when(d.isNotNull(), "near_miss")
    )


def formulas(pe: Column, pn: Column, pc: Column, ne: Column, nu: Column, nc: Column, now: Column) -> dict[str, Column]:
    """The 25 calibration formulas from the entailment, neutrality and contradiction of the positive hypothesis (``pe, pn,
    pc``), those of the negative one (``ne, nu, nc``) and the current rating. Null where an input is null."""
    name = lambda x: str(x).replace(".", "_")
    up, down, mid = pe + nc, ne + pc, 0.5 * (pn + nu)

    def balance(power: float) -> Column:
        u, d, m = (F.pow(x, F.lit(power)) for x in (up, down, mid))
        return clip((5 * u + 3 * m + d) / (u + d + m + EPS))

    positive, negative = expected_rating(pe, pn, pc), expected_rating(nc, nu, ne)
    out = {"F0_current": clip(now), "F1_pos_full_distribution": positive, "F2_neg_full_distribution": negative, "F3_avg_full_distribution": clip((positive + negative) / 2)}
    out |= {"F4_dual_diff": clip(3 + 2 * (pe - ne)), "F5_dual_ratio": clip(3 + 2 * (pe - ne) / (pe + ne + EPS)), "F7_dual_full_nli": balance(1.0)}
    out |= {f"F6_dual_logratio_T{name(t)}": clip(1 + 4 / (1 + F.exp(-(F.log(pe + EPS) - F.log(ne + EPS)) / t))) for t in TEMPERATURES}
    out |= {f"F8_dual_full_nli_power_alpha{name(a)}": balance(a) for a in TEMPERATURES}
    return out | {f"F9_center_expansion_gamma{name(g)}": clip(3 + g * (now - 3)) for g in GAMMAS}


def length_trust(text: Column, slope: float = 0.8, middle: float = 4.0) -> Column:
    """A sigmoid of the number of words; blank and null texts count as no words."""
    n = F.when(F.length(strip(text)) > 0, F.size(F.split(strip(text), WHITE_SPACE + "+"))).otherwise(0)
    return 1 / (1 + F.exp(-slope * (n - middle)))


def uniqueness(nearest: Column, copies: Column, floor: float = 0.75, least: float = 0.01) -> Column:
    """A review's weight by its greatest similarity to another and the size of its group of near copies."""
    over = F.greatest(F.lit(0.0), (nearest - floor) / (1 - floor))
    shared = F.when(copies > 1, F.lit(math.log(2)) / F.log(1 + copies)).otherwise(1.0)
    return F.greatest(F.lit(least), F.least(F.lit(1.0), (1 - over * over) * shared))


def bayes(mean: Column, n: Column, strength: Column, prior: float = 3.0) -> Column:
    return clip(n / (n + strength) * mean + strength / (n + strength) * prior)


def time_weight(date: Column, now: Column, days: float = 365.0) -> Column:
    """Exponential decay by whole days; a null date weighs 1, a future one too."""
    return F.coalesce(F.exp(-F.greatest(F.lit(0), F.datediff(now, date)) / days), F.lit(1.0))
