"""Bins, robust losses and tone maps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def centres_and_edges(low: float, high: float, n: int) -> tuple[list[float], list[float]]:
    """n evenly spaced centres, and n+1 edges half a step below each, and above the last."""
    step = (high - low) / (n - 1)
    centres = [low + i * step for i in range(n)]
    return centres, [c - step / 2 for c in centres] + [centres[-1] + step / 2]


def bucketize(x: Column, edges: list[float]) -> Column:
    """Right-closed bin number; -1 below the first edge."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)) - 1


def soft_argmax(scores: Column, centres: list[float]) -> Column:
    """Centres weighted by the softmax of their scores."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    dot = F.aggregate(F.zip_with(weights, F.array(*[F.lit(c) for c in centres]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return dot / total


def encode_up(x: Column, y: Column, bins: int) -> Column:
    """Direction to one of `bins - 1` sectors, counted from the negative x axis; the zero vector gets the last number."""
    turn = F.pmod(rad_to_deg(F.atan2(y, x)) + 180, F.lit(360.0))
    sector = F.bround(turn / (360 / (bins - 1))).cast("int")
    return F.when((x == 0) & (y == 0), F.lit(bins - 1)).when(sector == bins - 1, F.lit(0)).otherwise(sector)


def decode_up(sector: Column, bins: int) -> tuple[Column, Column]:
    """The direction in the middle of a sector; the last number is the zero vector."""
    angle = (sector * (360 / (bins - 1)) - 180) / 180 * math.pi
    none = sector == bins - 1
    return F.when(none, F.lit(0.0)).otherwise(F.cos(angle)), F.when(none, F.lit(0.0)).otherwise(F.sin(angle))


def rad_to_deg(x: Column) -> Column:
    return x / math.pi * 180


def encode_latitude(lat_deg: Column, bins: int) -> Column:
    """Right-closed bins of 180 / `bins` degrees; what lies beyond the ends belongs to the outer bins."""
    return F.least(F.greatest(F.ceil((lat_deg + 90) / (180.0 / bins)) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def decode_latitude(number: Column, bins: int) -> Column:
    """Middle of a latitude bin, in radians."""
    return (-90 + (number + 0.5) * (180.0 / bins)) / 180 * math.pi


def squared(x: Column) -> Column:
    return x


def huber(x: Column, delta: float = 1.0) -> Column:
    """Of a squared residual: itself up to delta squared, then linear in the residual."""
    return F.when(x <= delta * delta, x).otherwise(2 * delta * F.sqrt(x) - delta * delta)


def barron(x: Column, alpha: float) -> Column:
    """The general robust loss of a squared residual, for alpha other than 0 and 2."""
    b = abs(alpha - 2.0)
    return b / alpha * (F.pow(x / b + 1, F.lit(alpha / 2)) - 1) * 2


def cauchy(x: Column, c: float = 0.007) -> Column:
    return c * c / 2 * F.log1p(x / (c * c))


def tone_log(x: Column, eps: float = 1e-4) -> Column:
    return (F.log(x + eps) - math.log(eps)) / (math.log(1 + eps) - math.log(eps))


def tone_gamma(x: Column, gamma: float = 2.2) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / gamma))


def quantise(x: Column, bits: int = 8) -> Column:
    """The lower edge of the level that holds a value, of 2^bits levels a unit, as published: 1 is a level of its own."""
    return F.floor(x * (1 << bits)) / (1 << bits)


def reexpose(x: Column, p90: Column, top: float = 0.8) -> Column:
    """Radiance scaled so that its 90th percentile lands at `top`, cut to [0, 1]."""
    return F.least(F.greatest(x * (top / (p90 + 1e-10)), F.lit(0.0)), F.lit(1.0))


def best_centre(scores: Column, centres: list[float]) -> Column:
    """The centre of the first bin with the greatest score."""
    return F.get(F.array(*[F.lit(c) for c in centres]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def huber_slope(x: Column, delta: float = 1.0) -> Column:
    """Derivative of `huber` by the squared residual: the weight of a residual in a robust fit."""
    return F.when(x <= delta * delta, F.lit(1.0)).otherwise(delta / F.sqrt(x))


def barron_slope(x: Column, alpha: float) -> Column:
    return F.pow(x / abs(alpha - 2.0) + 1, F.lit(alpha / 2 - 1))


def scaled(loss, x: Column, scale: float) -> Column:
    """A loss of a squared residual, with the residual in units of `scale`."""
    return loss(x / (scale * scale)) * (scale * scale)


def dot_loss(residuals: list[Column], targets: list[Column]) -> Column:
    return 1 - sum((r * t for r, t in zip(residuals, targets)), F.lit(0.0))


def log_map(x: Column, base: float = 10.0, scale: float = 1.0, offset: float = 1.0) -> Column:
    """Radiance on a logarithmic scale, cut to [-1, 1]."""
    return F.least(F.greatest(F.log(x * scale + offset) / math.log(base), F.lit(0.0)), F.lit(2.0)) - 1


def log_map_back(x: Column, base: float = 10.0, scale: float = 1.0, offset: float = 1.0) -> Column:
    return (F.pow(F.lit(base), x + 1) - offset) / scale


def linear_map(x: Column, scale: float = 5000.0, mean: float = 5000.0) -> Column:
    return F.least(F.greatest((x - mean) / scale, F.lit(-1.0)), F.lit(1.0))


def linear_map_back(x: Column, scale: float = 5000.0, mean: float = 5000.0) -> Column:
    return x * scale + mean


def gamma_back(x: Column, gamma: float = 2.2) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(gamma))


def exposure_value(ev: Column, mean: float = 5.12, scale: float = 6.0) -> Column:
    """An exposure value by the distribution of the data, cut to [-1, 1]."""
    return F.least(F.greatest((ev - mean) / scale, F.lit(-1.0)), F.lit(1.0))


def illuminance(x: Column, scale: float = 5.0) -> Column:
    return F.log10(x + 1) / (scale / 2) - 1


def illuminance_back(x: Column, scale: float = 5.0) -> Column:
    return F.pow(F.lit(10.0), (x + 1) * (scale / 2)) - 1


def to_level(pixel: Column) -> Column:
    """A value in [-1, 1] as a level of 0 to 255."""
    return F.floor(F.least(F.greatest(127.5 * pixel + 128.0, F.lit(0.0)), F.lit(255.0))).cast("int")


def from_level(level: Column) -> Column:
    """A level of 0 to 255 in [-1, 1]."""
    return 2 * (level / 255) - 1


#: Coefficients of a rational approximation to the normal quantile, good to 1e-9: the middle, then the tails (fixed values).
NORMAL_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
NORMAL_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
NORMAL_EDGE = 0.02425


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which the share p lies, for p in (0, 1)."""

    def poly(c: tuple[float, ...], x: Column) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return poly(NORMAL_TAIL[0], r) / poly(NORMAL_TAIL[1], r)

    d = p - 0.5
    middle = poly(NORMAL_MIDDLE[0], d * d) * d / poly(NORMAL_MIDDLE[1], d * d)
    return F.when(p < NORMAL_EDGE, tail(p)).when(p > 1 - NORMAL_EDGE, -tail(1 - p)).otherwise(middle)


def truncated_normal(u: Column, a: float, b: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    """The value at share u of a normal distribution cut to [a, b] deviations."""
    low, high = ((1 + math.erf(x / math.sqrt(2))) / 2 for x in (a, b))
    return loc + scale * normal_quantile(low + u * (high - low))
