"""Column expressions over numeric arrays: answer scores (logits) and hidden vectors.

All take array<double> columns; cast first (:func:`as_double`), since products of
floats lose digits. NULL in, NULL out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFECT_GATE = 0.05
PROBABILITY_EPSILON = 1e-6
CLIP = 3.0


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(vec, lambda x: x * x)))


def difference(a: Column, b: Column) -> Column:
    """VEC13: a - b, element by element."""
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def finite(vec: Column) -> Column:
    """FLT8: every element is a number."""
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def skip_nan(x: Column) -> Column:
    """NaN as NULL, so that aggregates leave it out."""
    return F.when(~F.isnan(x), x)


# ------------------------------------------------------------ answer scores


def softmax(logits: Column) -> Column:
    """VEC1: shifted by the maximum, so that large scores don't overflow."""
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / total(F.transform(logits, lambda y: F.exp(y - top))))


def gold_probability(logits: Column, gold: Column) -> Column:
    """VEC1: softmax at the gold index (from 0)."""
    top = F.array_max(logits)
    return F.exp(F.get(logits, gold) - top) / total(F.transform(logits, lambda y: F.exp(y - top)))


def prediction(logits: Column) -> Column:
    """VEC2: index (from 0) of the largest score, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def letter(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in "ABCD"]), index)


def margin(logits: Column, gold: Column) -> Column:
    """VEC3: gold score minus the best other one."""
    return F.get(logits, gold) - F.array_max(F.filter(logits, lambda x, i: i != gold))


def safe_ratio(num: Column, den: Column, least: float = EFFECT_GATE) -> Column:
    """VEC20 / FLT7: NULL unless the denominator's size reaches ``least``."""
    return F.when(F.abs(den) >= least, num / den)


def clip(x: Column, bound: float = CLIP) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def recovery(delta: Column, remaining: Column, least: float = EFFECT_GATE) -> Column:
    """VEC16: 1 - remaining / (delta + 1e-8), clipped to +-3; NULL for a small delta."""
    return F.when(F.abs(delta) >= least, clip(1.0 - remaining / (delta + 1e-8)))


def causal_fraction(size: Column, remaining: Column, least: float = EFFECT_GATE) -> Column:
    """VEC17: part of an absolute effect that is gone; may be negative."""
    return F.when(size >= least, (size - remaining) / (size + 1e-8))


def injection(moved: Column, delta: Column, least: float = EFFECT_GATE) -> Column:
    """VEC18: moved / (delta + 1e-8), clipped to +-3; NULL for a small delta."""
    return F.when(F.abs(delta) >= least, clip(moved / (delta + 1e-8)))


def sign_of(delta: Column, dead: float = 1e-6) -> Column:
    """VEC19: positive, negative, or zero inside the dead zone."""
    return F.when(delta > dead, "positive").when(delta < -dead, "negative").otherwise("zero")


def movement_flags(delta: Column, after: Column, least: float = EFFECT_GATE) -> dict[str, Column]:
    """VEC19: what an intervention did to an effect."""
    before_sign, after_sign = sign_of(delta), sign_of(after)
    changed = (before_sign != after_sign) & (before_sign != "zero")
    rec = recovery(delta, after, least)
    return {
        "overshoot": F.coalesce(rec > 1.0, F.lit(False)),
        "no_effect": F.coalesce(F.abs(rec) < 0.05, F.lit(False)),
        "same_direction": before_sign == after_sign,
        "reversal": changed & (after_sign != "zero"),
        "attenuation": ~changed & (F.abs(after) < F.abs(delta)),
        "amplification": ~changed & (F.abs(after) > F.abs(delta)),
    }


def normalized_gain(accuracy: Column, classes: Column) -> Column:
    """VEC22: accuracy above uniform chance, as part of what is possible."""
    chance = 1.0 / F.greatest(classes, F.lit(1))
    return F.when(1.0 - chance > 1e-9, (accuracy - chance) / (1.0 - chance)).otherwise(0.0)


def layer_score(addition: Column, ablation: Column, control: Column) -> Column:
    """VEC21: 1 * addition + 1 * ablation - 0.5 * control."""
    return addition + ablation - 0.5 * control


# ------------------------------------------------------------ geometry


def euclidean(a: Column, b: Column) -> Column:
    return norm(difference(a, b))


def cosine(a: Column, b: Column, floor: float = 1e-10) -> Column:
    """VEC6, strict: 0 where either vector is shorter than ``floor``."""
    return F.when((norm(a) < floor) | (norm(b) < floor), 0.0).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_padded(a: Column, b: Column, pad: float = 1e-8) -> Column:
    """VEC6, smoothed: ``pad`` is added to the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + pad)


def pair_distances(orig: Column, edited: Column) -> dict[str, Column]:
    """VEC5: Euclidean, the same over the mean norm, cosine distance, norm of the original."""
    far, na, nb = euclidean(orig, edited), norm(orig), norm(edited)
    cos = dot(orig, edited) / (F.greatest(na, F.lit(1e-8)) * F.greatest(nb, F.lit(1e-8)))
    return {
        "euclidean": far,
        "norm_euclidean": far / F.greatest((na + nb) / 2, F.lit(1e-8)),
        "cosine_dist": 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)),
        "orig_norm": na,
    }


def unit(vec: Column) -> Column:
    """VEC8: a zero vector where the norm is below 1e-10."""
    size = norm(vec)
    return F.transform(vec, lambda x: F.when(size < 1e-10, 0.0).otherwise(F.try_divide(x, size)))


def add_direction(vec: Column, direction: Column, alpha: float) -> Column:
    """VEC29: vec + alpha * direction."""
    return F.zip_with(vec, direction, lambda x, d: x + alpha * d)


def remove_direction(vec: Column, direction: Column) -> Column:
    """VEC29: vec without its part along a unit direction."""
    along = dot(vec, direction)
    return F.zip_with(vec, direction, lambda x, d: x - along * d)


def decompose(vec: Column, d1: Column, d2: Column) -> dict[str, Column]:
    """VEC10: least squares on two directions; on the first alone where they are parallel. The
    coefficients, the norm of what is left, and the part of the squared norm explained."""
    a, b, c = dot(d1, d1), dot(d1, d2), dot(d2, d2)
    p, q = dot(vec, d1), dot(vec, d2)
    det = a * c - b * b
    b1 = F.when(F.abs(det) < 1e-12, F.try_divide(p, a + c)).otherwise(F.try_divide(p * c - q * b, det))
    b2 = F.when(F.abs(det) < 1e-12, F.try_divide(q, a + c)).otherwise(F.try_divide(q * a - p * b, det))
    whole = dot(vec, vec)
    left = F.greatest(whole - b1 * p - b2 * q, F.lit(0.0))
    return {"beta1": b1, "beta2": b2, "residual_norm": F.sqrt(left), "explained": F.when(whole > 0, 1.0 - left / whole)}


def additivity(both: Column, first: Column, second: Column) -> Column:
    """VEC23: distance of the double edit over the sum of the single ones; NULL below 1e-6."""
    return F.when(first + second > 1e-6, both / (first + second))


# ------------------------------------------------------------ attention


def entropy(weights: Column) -> Column:
    """VEC11: -sum w ln(w + 1e-12)."""
    return -total(F.transform(weights, lambda w: w * F.log(w + 1e-12)))


def mass_at(weights: Column, positions: Column) -> Column:
    """VEC11: sum of the weights at positions (from 0), those outside ignored."""
    inside = F.filter(positions, lambda p: (p >= 0) & (p < F.size(weights)))
    return total(F.transform(inside, lambda p: F.get(weights, p)))


def jaccard(a: Column, b: Column) -> Column:
    """SET5 / SET8: of two arrays as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def valid_positions(positions: Column) -> Column:
    """Top-k positions without the padding of -1."""
    return F.filter(positions, lambda p: p >= 0)


def row_normalised(profile: Column) -> Column:
    """WIN12: a profile over its maximum."""
    top = F.array_max(profile)
    return F.transform(profile, lambda x: F.when(top > 0, x / top).otherwise(0.0))
