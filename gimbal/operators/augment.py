"""Augmentation of images: what is done to each is drawn by hash in Spark, and done to its pixels in numpy.

A plan is a column: an array of steps (op, args, seed), the same whenever and wherever a row is worked on again. Images of one key have one plan; a null
key is a missing part of the hash. Pixels are rounded to levels of 0 to 255 after each step. A null image, or one without pixels, stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import hash_hex, unit

STEP = "struct<op:string,args:array<double>,seed:bigint>"


@dataclass(frozen=True)
class Step:
    """One operation, with probability `p`; `draws` are ranges of its arguments, of which those of `odd` are odd whole numbers, ends included."""

    op: str
    p: float = 1.0
    draws: tuple[tuple[float, float], ...] = ()
    odd: tuple[int, ...] = ()


@dataclass(frozen=True)
class OneOf:
    """With probability `p` the steps of one of the options, by their weights."""

    p: float
    options: tuple[tuple[float, tuple[Step, ...]], ...]


def _same(x: float) -> tuple[float, float]:
    return (x, x)


_U = (0.0, 1.0)
_LINE = (_U,) * 4


def _motion(p: float, top: int) -> Step:
    return Step("motion", p, ((3, top), *_LINE), (0,))


def _one(*weighted: tuple[float, Step]) -> tuple[tuple[float, tuple[Step, ...]], ...]:
    return tuple((w, (s,)) for w, s in weighted)


_TONE, _HUE = Step("exposure", 0.2, ((-0.2, 0.2),) * 2), Step("hue_saturation", 0.2, ((-20, 20), (-30, 30), (-20, 20)))
_JITTER = Step("jitter", 0.4, ((0.8, 1.2),) * 3 + ((-0.2, 0.2),))
_SHARP = Step("sharpen", 0.5, ((0.2, 0.5), (0.5, 1.0)))
_BENT = Step("bent_gaussian", 1.0, ((3, 7), (0.2, 1.0), (0.2, 1.0), (-90, 90), (0.5, 8.0), _same(0.9), _same(1.1)), (0,))
_USUAL = (
    _TONE, _HUE, Step("grey", 0.2), Step("jpeg", 0.5, ((30, 100),)),
    OneOf(0.2, _one((0.2, _motion(1.0, 7)), (0.1, Step("median", 1.0, (_same(3),), (0,))), (0.1, Step("box", 1.0, (_same(3),), (0,))))),
)
#: Probability of a set, and its steps (fixed values).
SETS: dict[str, tuple[float, tuple[Step | OneOf, ...]]] = {
    "identity": (1.0, ()),
    "default": (1.0, _USUAL),
    "perspective": (1.0, _USUAL),
    "dark": (0.75, (
        Step("rain", 0.2, ((-10, 10),)),
        Step("exposure", 0.5, ((-0.4, 0.0), (-0.3, 0.0))),
        OneOf(0.1, _one((0.1, Step("box", 1.0, ((3, 9),), (0,))), (0.2, _motion(1.0, 25)), (0.5, Step("sensor_noise", 1.0, ((0.01, 0.05), (0.1, 0.5)))), (0.5, Step("jpeg", 1.0, ((99, 100),))))),
        Step("gamma", 0.1, ((15, 65),)),
        OneOf(0.5, _one((0.5, Step("equalised")), (0.2, Step("locally_equalised", 1.0, ((1, 4),))), (0.5, Step("grey")), (0.1, Step("sepia")), (0.1, Step("hue_saturation", 1.0, ((-20, 20), (-30, 30), (-100, -40)))))),
    )),
    "deepcalib": (1.0, (
        Step("exposure", 0.5, ((-0.2, 0.2),) * 2), Step("gauss_noise", 0.75, ((5, 112),)), Step("coarsened", 0.5, ((0.5, 0.95), _same(0))), Step("coarsened", 0.5, ((0.5, 0.95), _same(1))),
        Step("jpeg", 1.0, ((20, 85),)), _JITTER, _SHARP, Step("grey", 0.2), Step("gaussian", 0.25, ((3, 5),), (0,)), _motion(0.25, 5), Step("factor_noise", 0.5, (_same(0.85), _same(1.15))),
    )),
    "geocalib": (1.0, (
        Step("gamma", 0.8, ((80, 180),)), Step("tone_curve", 0.5, (_same(0.1),)), Step("exposure", 0.5, ((-0.2, 0.2),) * 2), _JITTER,
        OneOf(1.0, ((0.1, (Step("grey"),)), (0.1, (Step("sepia"),)), (0.8, ()))),
        Step("gauss_noise", 0.75, ((5, 112),)), Step("jpeg", 1.0, ((20, 100),)), Step("sensor_noise", 0.5, ((0.01, 0.05), (0.1, 0.5))),
        OneOf(1.0, ((0.5, (_BENT, _SHARP)), (0.5, (_SHARP, _BENT)))),
        OneOf(1.0, _one(*[(0.25, Step("coarsened", 1.0, ((0.5, 0.99), _same(w)))) for w in (0, 2, 3, 4)])),
    )),
}
#: A shade, which no set has.
SHADE = Step("shade", 0.5, ((-0.5, 0.8), (151, 349)), (1,))


def _draws(item: Step | OneOf, path: str) -> Iterator[str]:
    """Names of the numbers that an item needs: whether, its seed and arguments, or which option."""
    yield path
    if isinstance(item, OneOf):
        yield f"{path}?"
        for k, (_, parts) in enumerate(item.options):
            for j, s in enumerate(parts):
                yield from _draws(s, f"{path}.{k}.{j}")
    else:
        yield f"{path}#"
        yield from (f"{path}/{k}" for k in range(len(item.draws)))


def _drawn(item: Step | OneOf, path: str, at: Callable[[str], Column]) -> Column:
    if isinstance(item, OneOf):
        total, reached, choice = sum(w for w, _ in item.options), 0.0, F.when(F.lit(False), _none())
        for k, (w, parts) in enumerate(item.options):
            reached += w
            own = [_drawn(s, f"{path}.{k}.{j}", at) for j, s in enumerate(parts)]
            choice = choice.when(at(f"{path}?") < reached / total, F.concat(*own) if own else _none())
        return F.when(at(path) < item.p, choice.otherwise(_none())).otherwise(_none())
    args = []
    for k, (low, high) in enumerate(item.draws):
        u = at(f"{path}/{k}")
        args.append(low + 2 * F.floor(u * ((high - low) // 2 + 1)) if k in item.odd else low + u * (high - low))
    number = (at(f"{path}#") * 4294967296.0).cast("long")
    step = F.struct(F.lit(item.op).alias("op"), F.array(*[a.cast("double") for a in args]).cast("array<double>").alias("args"), number.alias("seed"))
    return F.when(at(path) < item.p, F.array(step)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(f"array<{STEP}>")


def plan(steps: tuple[Step | OneOf, ...], p: float, seed: str, *key: Column) -> Column:
    """STEPs drawn for a row by hash of the seed and its key; with probability 1 - p there are none.

    All numbers are drawn first, as one array, so that a long plan stays a small expression.
    """
    names = ["all", *(n for i, s in enumerate(steps) for n in _draws(s, str(i)))]
    numbers = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: unit(seed, *key, n))

    def made(u: Column) -> Column:
        at = lambda n: F.get(u, F.lit(names.index(n)))
        every = [_drawn(s, str(i), at) for i, s in enumerate(steps)]
        return F.when(at("all") < p, F.concat(*every) if every else _none()).otherwise(_none())

    return F.element_at(F.transform(F.array(numbers), made), 1)


def named_plan(name: str, seed: str, *key: Column) -> Column:
    p, steps = SETS[name]
    return plan(steps, p, seed, *key)


def applied(image: np.ndarray, steps: list[dict]) -> np.ndarray:
    """The image (height, width, channels) after the steps of a plan."""
    x = image.astype(np.float64)
    for s in steps:
        x = getattr(K, s["op"])(x, np.random.default_rng(s["seed"]), *s["args"])
        x = np.clip(np.rint(x), 0, 255)
    return x


def augmented(df: DataFrame, steps: str = "steps", pixels: str = "pixels") -> DataFrame:
    """Rows with `pixels` (width, height, channels; row by row, channels together) after the plan in `steps`, an image at a time; other columns stay.

    A size that doesn't fit the pixels is an error, a null plan does nothing.
    """
    at = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, made = batch.column(at[pixels]), []
            sizes = zip(*(batch.column(at[c]).to_pylist() for c in ("height", "width", "channels")))
            for i, (size, todo) in enumerate(zip(sizes, batch.column(at[steps]).to_pylist())):
                own = values[i]
                if not own.is_valid or len(own.values) == 0 or not todo:
                    made.append(own.as_py() if not own.is_valid else own.values)
                    continue
                image = own.values.to_numpy(zero_copy_only=False).reshape(size)
                made.append(pa.array(applied(image, todo).ravel()).cast(values.type.value_type))
            columns = list(batch.columns)
            columns[at[pixels]] = pa.array([m if m is None else m.to_numpy(zero_copy_only=False) for m in made], values.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def tone_chain(
    df: DataFrame, key: str, curve: str = "none", value: float = 1.0, clip: bool = True, bits: int = 0, hue: float = 0.0, noise: float = 0.0, balance: list[list[float]] | None = None, seed: str = "tone", pixels: str = "pixels"
) -> DataFrame:
    """Radiance to levels in [0, 1]: rescaled so that the 90th percentile lands at 0.8, cut, mapped (`gamma`, `log10` or none), its hue turned, noise added, quantised, and its white balanced.

    `hue` is the deviation of the turn, `noise` the most deviation that the noise of an image is given; both are drawn by hash of the key. `balance` is a matrix of colours. An empty or
    null image stays as it is; hue and balance need three channels, interleaved. Adds `scale`, the factor that undoes the rescaling.
    """
    at = {c: i for i, c in enumerate(df.columns)}
    number = F.conv(F.substring(hash_hex(seed, F.col(key)), 1, 12), 16, 10).cast("long")
    rows = df.select(*[F.col(c) for c in df.columns], number.alias("_seed"), F.lit(None).cast("double").alias("scale"))
    matrix = None if balance is None else np.array(balance)

    def chain(x: np.ndarray, number: int) -> tuple[np.ndarray, float]:
        rng = np.random.default_rng(number)
        scale = (np.percentile(x, 90) + 1e-10) / 0.8
        x = x / scale
        x = np.clip(x, 0, 1) if clip else x
        if curve == "gamma":
            x = np.power(np.maximum(x, 0), 1 / value)
        elif curve == "log10":
            x = np.log(x + 1) / np.log(value)
        elif curve != "none":
            raise ValueError(curve)
        if hue:
            h, s, v = K.hsv_of(x.reshape(-1, 3))
            x = K.rgb_of((h + rng.normal(0, hue)) % 1, s, v).ravel()
        if noise:
            x = np.clip(x + rng.normal(0, rng.uniform(0, noise), x.shape), 0, 1)
        if bits:
            x = np.floor(x * 2**bits) / 2**bits
        return x if matrix is None else (x.reshape(-1, 3) @ matrix.T).ravel(), scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, made, scales = batch.column(at[pixels]), [], []
            for i, n in enumerate(batch.column(len(at)).to_pylist()):
                own = values[i]
                x, scale = (own.as_py(), None) if not own.is_valid or len(own.values) == 0 else chain(own.values.to_numpy(zero_copy_only=False).astype(np.float64), n)
                made.append(x)
                scales.append(scale)
            columns = list(batch.columns)
            columns[at[pixels]], columns[-1] = pa.array(made, values.type), pa.array(scales, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema).drop("_seed")
