"""Camera geometry as column expressions: angles in radians, pixels from the top left corner."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of view that a focal length update may reach, and bounds of k1 by model (fixed values).
VFOV_RANGE = (math.radians(5), math.radians(150))
TURN = 2 * math.pi
K1_LIMIT = {"simple_radial": 0.7, "radial": 0.7, "simple_divisional": 3.0}


def rad2deg(x: Column) -> Column:
    return x / math.pi * 180


def deg2rad(x: Column) -> Column:
    return x / 180 * math.pi


def fov2focal(fov: Column, size: Column) -> Column:
    return size / 2 / F.tan(fov / 2)


def focal2fov(focal: Column, size: Column) -> Column:
    return 2 * F.atan(size / (2 * focal))


def pitch2rho(pitch: Column, f: Column, h: Column) -> Column:
    return F.tan(pitch) * f / h


def rho2pitch(rho: Column, f: Column, h: Column) -> Column:
    return F.atan(rho * h / f)


def gravity(roll: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """The unit gravity vector in the camera's frame."""
    return -F.sin(roll) * F.cos(pitch), -F.cos(roll) * F.cos(pitch), F.sin(pitch)


def roll_pitch(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Angles of a gravity vector. The small term keeps the division finite, so a round trip is not exact."""
    roll = F.asin(-x / (F.sqrt(1 - z * z) + 1e-4))
    return F.when(y >= 0, -roll - math.pi * F.signum(x)).otherwise(roll), F.asin(z)


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(roll) Rx(pitch) Ry(yaw), as three rows."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cr * cy - sr * sp * sy, -sr * cp, cr * sy + sr * sp * cy],
        [sr * cy + cr * sp * sy, cr * cp, sr * sy - cr * sp * cy],
        [-cp * sy, sp, cp * cy],
    ]


def distortion(model: str, x: Column, y: Column, k1: Column, k2: Column) -> Column:
    """The factor that takes an ideal point to its distorted place."""
    r2 = x * x + y * y
    if model == "pinhole":
        return F.lit(1.0)
    if model == "simple_radial":
        return 1 + k1 * r2
    if model == "radial":
        return 1 + k1 * r2 + k2 * r2 * r2
    if model == "simple_divisional":
        return F.coalesce(F.try_divide(1 - F.sqrt(F.greatest(1 - 4 * k1 * r2, F.lit(0.0))), 2 * k1 * r2), F.lit(1.0))
    raise ValueError(model)


def undistortion(model: str, x: Column, y: Column, k1: Column, k2: Column) -> Column:
    """The factor that takes a distorted point back, to second order for the radial models."""
    r2 = x * x + y * y
    if model == "pinhole":
        return F.lit(1.0)
    if model == "simple_radial":
        return 1 - k1 * r2
    if model == "radial":
        return 1 - k1 * r2 + (3 * k1 * k1 - k2) * r2 * r2
    if model == "simple_divisional":
        return F.try_divide(F.lit(1.0), 1 + k1 * r2)
    raise ValueError(model)


def distortion_slope(model: str, x: Column, y: Column, k1: Column, k2: Column) -> Column:
    """Derivative of `distortion` by the squared radius; where a divisional model ends, that of its centre."""
    r2 = x * x + y * y
    if model == "pinhole":
        return F.lit(0.0)
    if model == "simple_radial":
        return k1 + 0 * r2
    if model == "radial":
        return k1 + 2 * k2 * r2
    if model == "simple_divisional":
        root = F.sqrt(F.greatest(1 - 4 * k1 * r2, F.lit(0.0)))
        return F.coalesce(F.try_divide(F.try_divide(F.lit(1.0), root) - distortion(model, x, y, k1, k2), r2), k1)
    raise ValueError(model)


def sphere_move(g: tuple[Column, Column, Column], d1: Column, d2: Column) -> tuple[Column, Column, Column]:
    """A unit vector moved along the sphere by a step (d1, d2) in its tangent plane.

    The plane's axes are the images of the first two axes under the reflection that takes the third axis to the vector.
    """
    x, y, z = g
    d = F.sqrt(d1 * d1 + d2 * d2)
    sinc = F.coalesce(F.try_divide(F.sin(d), d), F.lit(1.0))
    e = (sinc * d1, sinc * d2, F.cos(d))
    w = (x, y, z - 1)
    share = F.when(1 - z > 5e-8, (w[0] * e[0] + w[1] * e[1] + w[2] * e[2]) / (1 - z)).otherwise(0.0)
    return e[0] - w[0] * share, e[1] - w[1] * share, e[2] - w[2] * share


def update_focal(f: Column, h: Column, delta: Column, as_log: bool = True) -> Column:
    """A focal length moved by delta, its field of view kept within VFOV_RANGE."""
    moved = f * F.exp(delta) if as_log else f + delta
    low, high = (fov2focal(F.lit(v), h) for v in reversed(VFOV_RANGE))
    return F.least(F.greatest(moved, low), high)


def horizon(roll: Column, pitch: Column, f: Column, cx: Column, cy: Column, w: Column) -> tuple[Column, Column]:
    """Height of the horizon at the left and the right border."""
    x, y, z = gravity(roll, pitch)
    at = lambda u: cy - F.try_divide((u - cx) * x + f * z, y)
    return at(F.lit(0.0)), at(w)


def crop_vfov(vfov: Column, w: Column, h: Column) -> Column:
    """The whole image's field of view from that of a centred square crop, for portrait images."""
    return F.when(h > w, 2 * F.atan(F.tan(vfov / 2) * h / w)).otherwise(vfov)


def gravity_angle(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Degrees between two unit vectors."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return rad2deg(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def scale_camera(cam: dict[str, Column], sx: Column, sy: Column) -> dict[str, Column]:
    return {"w": cam["w"] * sx, "h": cam["h"] * sy, "fx": cam["fx"] * sx, "fy": cam["fy"] * sy, "cx": cam["cx"] * sx, "cy": cam["cy"] * sy}


def crop_camera(cam: dict[str, Column], px: Column, py: Column) -> dict[str, Column]:
    """Size and centre after a crop (negative) or padding by (px, py) pixels in all."""
    return cam | {"w": cam["w"] + px, "h": cam["h"] + py, "cx": cam["cx"] + px / 2, "cy": cam["cy"] + py / 2}


def dynamic_size(w: Column, h: Column, long_side: int = 512, unit: int = 32) -> tuple[Column, Column]:
    """The long side becomes `long_side`, the other is rounded up to a multiple of `unit`."""
    ratio = F.lit(float(long_side)) / F.greatest(w, h)
    up = lambda v: (F.ceil(v * ratio / unit) * unit).cast("int")
    return F.when(w >= h, F.lit(long_side)).otherwise(up(w)), F.when(h >= w, F.lit(long_side)).otherwise(up(h))


def resize_plan(w: Column, h: Column, size: int, side: str = "short") -> tuple[Column, Column]:
    """Target width and height with the named side at `size`; the other truncates."""
    by = {"short": F.least(w, h), "long": F.greatest(w, h), "vert": h, "horz": w}[side]
    return F.floor(w * size / by).cast("int"), F.floor(h * size / by).cast("int")


def centre_crop(w: Column, h: Column) -> tuple[Column, Column, Column]:
    """Left, top and side of the centred square."""
    s = F.least(w, h)
    return F.floor((w - s) / 2).cast("int"), F.floor((h - s) / 2).cast("int"), s


def brown_max_radius(k1: Column, k2: Column) -> Column:
    """Radius up to which a radial distortion still grows; infinite where it always does."""
    a, b = 3 * k1, 5 * k2
    room = a * a - 4 * b
    slope = F.when(room >= 0, F.sqrt(room) - a)
    return F.when(slope > 0, F.sqrt(2 / slope)).otherwise(F.lit(float("inf")))


def valid_focal(f: Column, w: Column, h: Column, k1: Column) -> Column:
    """The focal length, raised where the image's corner would lie beyond the greatest valid radius."""
    r = brown_max_radius(k1, F.lit(0.0))
    corner = F.sqrt(h / 2 * (h / 2) + w / 2 * (w / 2))
    return F.when(F.isnan(r) | (r == float("inf")), f).otherwise(F.greatest(f, corner / (r * (1 + k1 * r * r))))


def panorama_angles(u: Column, v: Column, roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column]:
    """Longitude and latitude at which a normalised point of a turned camera looks into a panorama."""
    zero = F.lit(0.0)
    turn, head = rotation(roll, pitch, zero), rotation(zero, zero, yaw)
    b = [u, v, F.lit(1.0)]
    q = [b[0] * turn[0][j] + b[1] * turn[1][j] + b[2] * turn[2][j] for j in range(3)]
    x, y, z = (q[0] * head[0][j] + q[1] * head[1][j] + q[2] * head[2][j] for j in range(3))
    return F.atan2(x, z), F.atan2(y, F.sqrt(x * x + z * z))


def build(w: Column, h: Column, given: dict[str, Column]) -> dict[str, Column]:
    """A camera from what is known of it: w, h, fx, fy, cx, cy, k1, k2.

    The focal length is that of `vfov`, else `f`. Distortion is `dist` (an array of one or two terms), else `k1_hat` (for a focal length of the
    image's height), else k1 and k2. `scale_x` and `scale_y` stretch fx. The centre is the image's unless `cx`, `cy` are given.
    """
    zero = F.lit(0.0)
    f = fov2focal(given["vfov"], h) if "vfov" in given else given["f"]
    k2 = given.get("k2", zero)
    if "dist" in given:
        k1, k2 = F.get(given["dist"], F.lit(0)), F.coalesce(F.get(given["dist"], F.lit(1)), zero)
    elif "k1_hat" in given:
        k1 = given["k1_hat"] * (f / h) * (f / h)
    else:
        k1 = given.get("k1", zero)
    fx = f * given["scale_x"] / given["scale_y"] if "scale_x" in given else f
    return {"w": w, "h": h, "fx": fx, "fy": f, "cx": given.get("cx", w / 2), "cy": given.get("cy", h / 2), "k1": k1, "k2": k2}


def views(cam: dict[str, Column]) -> tuple[Column, Column]:
    """Vertical and horizontal field of view."""
    return focal2fov(cam["fy"], cam["h"]), focal2fov(cam["fx"], cam["w"])


def matrix(cam: dict[str, Column]) -> Column:
    """The intrinsic matrix, row by row."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(cam["fx"], zero, cam["cx"], zero, cam["fy"], cam["cy"], zero, zero, one)


def k1_hat(cam: dict[str, Column]) -> Column:
    """k1 for a focal length of the image's height."""
    r = cam["fy"] / cam["h"]
    return cam["k1"] / (r * r)


def undo(cam: dict[str, Column], px: Column, py: Column, sx: Column, sy: Column) -> dict[str, Column]:
    """The camera before it was scaled by (sx, sy) and cropped by (px, py)."""
    return scale_camera(crop_camera(cam, -px, -py), 1 / sx, 1 / sy)


def update_distortion(k: Column, delta: Column, model: str = "simple_radial") -> Column:
    """A distortion term moved by delta, kept within the model's limit."""
    top = K1_LIMIT[model]
    return F.least(F.greatest(k + delta, F.lit(-top)), F.lit(top))


#: Points nearer to the camera's plane than this aren't seen (fixed value).
NEAREST = 1e-3


def project(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Normalised place of a point in the camera's frame, and whether it lies before the camera."""
    at = F.greatest(z, F.lit(NEAREST))
    return x / at, y / at, z > NEAREST


def in_image(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)


def world_to_image(cam: dict[str, Column], x: Column, y: Column, z: Column, model: str = "simple_radial") -> tuple[Column, Column, Column]:
    """Pixel of a point in the camera's frame, and whether it is seen."""
    u, v, before = project(x, y, z)
    s = distortion(model, u, v, cam["k1"], cam["k2"])
    px, py = u * s * cam["fx"] + cam["cx"], v * s * cam["fy"] + cam["cy"]
    return px, py, before & in_image(px, py, cam["w"], cam["h"])


def image_to_world(cam: dict[str, Column], px: Column, py: Column, model: str = "simple_radial") -> tuple[Column, Column]:
    """Ray (u, v, 1) of a pixel."""
    u, v = (px - cam["cx"]) / cam["fx"], (py - cam["cy"]) / cam["fy"]
    s = undistortion(model, u, v, cam["k1"], cam["k2"])
    return u * s, v * s


def to_multiple(w: Column, h: Column, unit: int, crop: bool = False, centre: bool = True) -> tuple[Column, Column, Column, Column]:
    """Pixels to add (or, negative, to cut) at left, right, top and bottom so that both sides are multiples of `unit`."""
    out = []
    for n in (w, h):
        pad = F.floor(n / unit).cast("int") * unit - n if crop else F.pmod(F.lit(unit) - n % unit, F.lit(unit)).cast("int")
        first = F.floor(pad / 2).cast("int") if centre else F.lit(0)
        out += [first, pad - first]
    return tuple(out)


def scaled_map(value: Column) -> Column:
    """A camera map's value over a right angle."""
    return value / (math.pi / 2)


def unscaled_view(x: Column, low: float = 20.0, high: float = 105.0) -> Column:
    """A field of view in [-1, 1] back in radians, over the range in degrees."""
    a, b = math.radians(low), math.radians(high)
    return (x + 1) / 2 * (b - a) + a


def scaled_view(vfov: Column, low: float = 20.0, high: float = 105.0) -> Column:
    a, b = math.radians(low), math.radians(high)
    return 2 * (vfov - a) / (b - a) - 1


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def outer(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """All products, row by row."""
    return F.array(*[x * y for x in a for y in b])


def skew(v: tuple[Column, Column, Column]) -> Column:
    """The matrix of the cross product with v, row by row."""
    zero = F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def unit_vector(a: Column) -> Column:
    """An array over its length; zeros stay."""
    n = F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays."""
    return F.aggregate(F.zip_with(unit_vector(a), unit_vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
