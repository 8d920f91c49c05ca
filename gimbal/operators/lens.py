"""Fields of many cameras at once in numpy: up directions, latitudes, and their slopes by gravity, focal length and lens.

Arrays are (images, pixels); x and y are pixels from the image's centre. The lens models are those of `functions.camera`: the up direction is taken
through `distortion` at the image's point, the latitude is that of the ray through `undistortion`.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

#: Distortion terms by model, and their bounds in a fit (fixed values).
TERMS = {"pinhole": 0, "simple_radial": 1, "radial": 2, "simple_divisional": 1}
LIMITS = {"pinhole": (), "simple_radial": (0.7,), "radial": (0.7, 0.7), "simple_divisional": (3.0,)}
#: The sine of a latitude stays this far from one.
POLE = 1e-6


def gravity_of(roll: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    return np.stack([-np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch), np.sin(pitch)], -1)


def lens_factors(lens: str, r2: np.ndarray, k: np.ndarray, slopes: bool) -> SimpleNamespace:
    """Of the squared radius: `d` distortion, `d1` its slope, `u` undistortion; with `slopes` also `d2`, `u1`, and lists by term `dk`, `d1k`, `uk`."""
    if lens == "pinhole":
        return SimpleNamespace(d=1.0, d1=0.0, u=1.0, d2=0.0, u1=0.0, dk=[], d1k=[], uk=[])
    k1 = k[:, :1]
    if lens == "simple_radial":
        return SimpleNamespace(d=1 + k1 * r2, d1=k1, u=1 - k1 * r2, d2=0.0, u1=-k1, dk=[r2], d1k=[1.0], uk=[-r2])
    if lens == "radial":
        k2, r4 = k[:, 1:2], r2 * r2
        c = 3 * k1 * k1 - k2
        out = SimpleNamespace(d=1 + k1 * r2 + k2 * r4, d1=k1 + 2 * k2 * r2, u=1 - k1 * r2 + c * r4)
        if slopes:
            out.d2, out.u1, out.dk, out.d1k, out.uk = 2 * k2, -k1 + 2 * c * r2, [r2, r4], [1.0, 2 * r2], [-r2 + 6 * k1 * r4, -r4]
        return out
    if lens == "simple_divisional":
        root = np.sqrt(np.maximum(1 - 4 * k1 * r2, 0))
        one, there = 1 + root, root > 0
        safe = np.where(there, root, 1.0)
        first = 4 / (safe * one * one)
        out = SimpleNamespace(d=2 / one, d1=np.where(there, k1 * first, k1), u=1 / (1 + k1 * r2))
        if slopes:
            bend = np.where(there, 8 / safe * (1 / (safe * safe * one * one) + 2 / (safe * one**3)), 0.0)
            out.d2, out.u1 = k1 * k1 * bend, -k1 * out.u**2
            out.dk, out.d1k, out.uk = [np.where(there, r2 * first, 0.0)], [np.where(there, first, 1.0) + k1 * r2 * bend], [-r2 * out.u**2]
        return out
    raise ValueError(lens)


def field(g: np.ndarray, f: np.ndarray, k: np.ndarray | None, x: np.ndarray, y: np.ndarray, lens: str = "pinhole") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up x, up y (NaN where the direction vanishes) and sine of the latitude; `g` (images, 3), `f` (images,), `k` (images, terms)."""
    at = _at(g, f, k, x, y, lens, False)
    with np.errstate(invalid="ignore", divide="ignore"):
        return at.px / at.n, at.py / at.n, at.s


def _at(g, f, k, x, y, lens, slopes) -> SimpleNamespace:
    g0, g1, g2 = (g[:, i, None] for i in range(3))
    u, v = x / f[:, None], y / f[:, None]
    r2 = u * u + v * v
    c = lens_factors(lens, r2, k, slopes)
    wx, wy = g0 - g2 * u, g1 - g2 * v
    if lens == "pinhole":
        q, px, py = None, wx, wy
    else:
        q = u * wx + v * wy
        px, py = c.d * wx + 2 * c.d1 * q * u, c.d * wy + 2 * c.d1 * q * v
    n = np.sqrt(px * px + py * py)
    ray = np.sqrt(c.u * c.u * r2 + 1)
    s = (c.u * (u * g0 + v * g1) + g2) / ray
    return SimpleNamespace(g0=g0, g1=g1, g2=g2, u=u, v=v, r2=r2, c=c, wx=wx, wy=wy, q=q, px=px, py=py, n=n, ray=ray, s=s)


def slopes(g: np.ndarray, f: np.ndarray, k: np.ndarray | None, x: np.ndarray, y: np.ndarray, lens: str, dirs: np.ndarray, free: np.ndarray):
    """Up x, up y, sine of the latitude, and (images, columns, pixels) of the turn of the up direction and the change of the sine.

    Columns are those of `free` among the directions of gravity `dirs` (images, 3, n), the log focal length, and the lens's terms. The up direction
    can only turn: it moves along (-up y, up x).
    """
    a = _at(g, f, k, x, y, lens, True)
    n = np.maximum(a.n, 1e-12)
    ux, uy, c, along = a.px / n, a.py / n, a.c, a.u * a.g0 + a.v * a.g1
    turn, sine, place = [], [], 0

    def add(dx, dy, ds):
        turn.append((ux * dy - uy * dx) / n)
        sine.append(ds)

    for i in range(dirs.shape[2]):
        if free[place]:
            h0, h1, h2 = (dirs[:, j, i, None] for j in range(3))
            dx, dy = h0 - h2 * a.u, h1 - h2 * a.v
            ds = (c.u * (a.u * h0 + a.v * h1) + h2) / a.ray
            if lens != "pinhole":
                dq = 2 * c.d1 * (a.u * dx + a.v * dy)
                dx, dy = c.d * dx + dq * a.u, c.d * dy + dq * a.v
            add(dx, dy, ds)
        place += 1
    if free[place]:
        m = -2 * a.r2 * c.u1 - c.u
        ds = along * m / a.ray - a.s * c.u * a.r2 * m / (a.ray * a.ray)
        dx, dy = a.g2 * a.u, a.g2 * a.v
        if lens != "pinhole":
            dd, turned = -2 * a.r2 * c.d1, 2 * (-2 * a.r2 * c.d2 * a.q + c.d1 * (a.g2 * a.r2 - 2 * a.q))
            dx, dy = dd * a.wx + c.d * dx + turned * a.u, dd * a.wy + c.d * dy + turned * a.v
        add(dx, dy, ds)
    place += 1
    for i in range(TERMS[lens]):
        if free[place]:
            turned = 2 * c.d1k[i] * a.q
            ds = along * c.uk[i] / a.ray - a.s * c.u * a.r2 * c.uk[i] / (a.ray * a.ray)
            add(c.dk[i] * a.wx + turned * a.u, c.dk[i] * a.wy + turned * a.v, ds)
        place += 1
    return ux, uy, a.s, np.stack(turn, 1), np.stack(sine, 1)


def columns(g: np.ndarray, f: np.ndarray, k: np.ndarray | None, x: np.ndarray, y: np.ndarray, lens: str = "pinhole"):
    """Up x, up y, sine of the latitude, where the up direction vanishes, and the columns that `slopes` are made of: (images, columns + 1, pixels) of the turn and of
    the sine, the last one free, with the matrices' part that turns gravity's three numbers, log focal length and lens terms into them as a function of directions.

    A move of gravity counts by three columns whatever its direction, so that sums of their products serve all directions.
    """
    terms = TERMS[lens]
    g0, g1, g2 = (g[:, i, None] for i in range(3))
    inv = 1 / f[:, None]
    shape = (len(g), x.shape[1])
    turn, sine = np.empty((shape[0], (4 if lens == "pinhole" else 5 + terms), shape[1])), np.empty((shape[0], 5 + terms, shape[1]))
    flat = lens == "pinhole"
    u, v = (x, y) if flat else (x * inv, y * inv)
    z = g2 * inv if flat else g2
    wx, wy = g0 - z * u, g1 - z * v
    if flat:
        px, py = wx, wy
    else:
        r2 = u * u + v * v
        c = lens_factors(lens, r2, k, True)
        q = u * wx + v * wy
        bend = 2 * c.d1 * q
        px, py = c.d * wx + bend * u, c.d * wy + bend * v
    n2 = px * px + py * py
    lost = n2 < 1e-24
    if not lost.any():
        lost = None
    else:
        n2 = np.maximum(n2, 1e-24)
    rn = 1 / np.sqrt(n2)
    ux, uy = px * rn, py * rn
    if flat:
        # In pixels: the focal length goes into the matrices.
        a, b = turn[:, 0], turn[:, 1]
        np.multiply(uy, -rn, out=a)
        np.multiply(ux, rn, out=b)
        np.multiply(a, x, out=turn[:, 2])
        turn[:, 2] += b * y
        near = sine[:, 2]
        np.divide(1.0, np.sqrt((x * x + y * y) * (inv * inv) + 1), out=near)
        np.multiply(x, near, out=sine[:, 0])
        np.multiply(y, near, out=sine[:, 1])
        s = np.matmul(np.concatenate([g0 * inv, g1 * inv, g2], 1)[:, None], sine[:, :3])[:, 0]
        np.multiply(near, g2 - s * near, out=sine[:, 3])
    else:
        kappa, omega = ux * v - uy * u, ux * wy - uy * wx
        side = 2 * c.d1 * kappa
        np.multiply(side * u - c.d * uy, rn, out=turn[:, 0])
        np.multiply(side * v + c.d * ux, rn, out=turn[:, 1])
        np.negative(turn[:, 0] * u + turn[:, 1] * v, out=turn[:, 2])
        kappa *= rn
        omega *= rn
        np.add((-2 * c.d1) * r2 * omega, (c.d * g2 - 4 * c.d2 * r2 * q + 2 * c.d1 * (g2 * r2 - 2 * q)) * kappa, out=turn[:, 3])
        ray = 1 / np.sqrt(c.u * c.u * r2 + 1)
        near, along = c.u * ray, u * g0 + v * g1
        np.multiply(u, near, out=sine[:, 0])
        np.multiply(v, near, out=sine[:, 1])
        sine[:, 2] = ray
        s = near * along + g2 * ray
        by = (along - s * near * r2) * ray
        np.multiply(by, -2 * r2 * c.u1 - c.u, out=sine[:, 3])
        for i in range(terms):
            np.add(c.dk[i] * omega, 2 * c.d1k[i] * q * kappa, out=turn[:, 4 + i])
            np.multiply(by, c.uk[i], out=sine[:, 4 + i])

    def ways(dirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the turn and of the sine, (images, columns, parameters)."""
        free = dirs.shape[2] + 1 + terms
        a, b = np.zeros((len(g), turn.shape[1] - 1, free)), np.zeros((len(g), sine.shape[1] - 1, free))
        a[:, :3, : dirs.shape[2]] = b[:, :3, : dirs.shape[2]] = dirs
        b[:, 3:, dirs.shape[2] :] = np.eye(1 + terms)
        if flat:
            a[:, 2, dirs.shape[2]] = g2[:, 0]
            a[:, 2] *= -inv
            a[:, 2, dirs.shape[2]] *= -1
            b[:, :2] *= inv[:, :, None]
        else:
            a[:, 3:, dirs.shape[2] :] = np.eye(1 + terms)
        return a, b

    return ux, uy, s, lost, turn, sine, ways


def pixel_grid(w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y from the centre, row by row from the top left pixel."""
    i = np.arange(w * h)
    return (i % w - w / 2)[None], (i // w - h / 2)[None]
