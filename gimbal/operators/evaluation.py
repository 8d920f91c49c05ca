"""Evaluation of camera parameters that a model states in text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import text as X

ERRORS = ["roll_error", "pitch_error", "vfov_error"]


def predictions(outputs: DataFrame, suffix: str = "jpg") -> DataFrame:
    """fname, roll, pitch, vfov of each output with an id, at six decimals; defaults where nothing can be parsed.

    The file name is the id's stem with `suffix`, whatever folder or extension the id has. A null text has no numbers.
    """
    roll, pitch, vfov = X.triple(F.coalesce("output_text", F.lit("")), X.LENIENT, X.DEFAULTS)
    named = outputs.where(F.coalesce("id", F.lit("")) != "")
    return named.select(X.stem(F.col("id"), suffix).alias("fname"), *[F.round(c, 6).alias(n) for c, n in ((roll, "roll"), (pitch, "pitch"), (vfov, "vfov"))])


def some_rows(df: DataFrame, what: str) -> DataFrame:
    """The table itself, if it has a row; else an error, at once."""
    if not df.limit(1).count():
        raise ValueError(f"no rows: {what}")
    return df


def errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Absolute errors in degrees, without wrapping; a square crop's field of view is restored for portrait images."""
    p = predicted.select("fname", *[F.col(c).alias(f"{c}_pred") for c in ("roll", "pitch", "vfov")])
    both = truth.select("fname", "roll", "pitch", "vfov", "width", "height").join(p, "fname")
    both = both.withColumn("vfov_pred", C.crop_vfov(F.col("vfov_pred"), F.col("width"), F.col("height")))
    return both.withColumns({f"{c}_error": F.abs(C.rad2deg(F.col(f"{c}_pred")) - C.rad2deg(F.col(c))) for c in ("roll", "pitch", "vfov")})


def camera_table(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Errors between two tables of cameras (roll, pitch, vfov, height, k1): angles in degrees, without wrapping, focal lengths in pixels and as a share, and k1."""
    names = ["roll", "pitch", "vfov", "k1"]
    both = truth.join(predicted.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key)
    f, g = (C.fov2focal(F.col(c), F.col("height")) for c in ("vfov", "_vfov"))
    angle = C.gravity_angle(C.gravity(F.col("roll"), F.col("pitch")), C.gravity(F.col("_roll"), F.col("_pitch")))
    degrees = [F.abs(C.rad2deg(F.col(f"_{c}")) - C.rad2deg(F.col(c))).alias(f"{c}_error") for c in names[:3]]
    return both.select(key, *degrees, angle.alias("gravity_error"), F.abs(f - g).alias("focal_error"), (F.abs(f - g) / f).alias("rel_focal_error"), F.abs(F.col("_k1") - F.col("k1")).alias("k1_error"))
