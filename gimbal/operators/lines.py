"""Cameras from straight lines: segments of a grey image, their vanishing points by linked preferences, then focal length and gravity.

Everything is numpy on one image at a time inside `mapInArrow`: images are independent and nothing is shuffled. Coordinates are pixels from
the image's centre (x - w/2, y - h/2) with y downwards, as in `lens`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Least lines of an image that is judged (fixed value).
MIN_LINES = 5
#: Pixels by which the ends of good segments miss: the scale of the loss.
NOISE = 0.1
#: Starts that are fitted, and scale of the loss in the last steps: this many median misses, within bounds (fixed values).
TRIED, SPREAD, SCALES = 8, 8.0, (0.02, 0.3)
#: Pixels that a segment crosses, at least and at most, for its weight (fixed values).
CROSSED = (0.2, 1.5)
#: Scale of the loss by which fits are compared (fixed value).
SHARP = 0.03
OUT = T.StructType([
    T.StructField("n_lines", T.IntegerType()),
    T.StructField("f", T.DoubleType()),
    T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("members", T.ArrayType(T.IntegerType())),
])


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part, for links a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def segments(image: np.ndarray, contrast: float = 5.2, turn: float = np.pi / 8, length: float = 12.0, width: float = 1.0) -> np.ndarray:
    """(n, 4) ends x1, y1, x2, y2 of straight edges.

    Places between pixels whose grey level changes by more than `contrast` are joined to neighbours of nearly the same direction, in two rounds: the
    second leaves out what turns away from its part's mean direction. A part is a segment if it is `length` long and no more than `width` wide
    (root mean square, across). Brighter-left and brighter-right edges are apart. Ends are `sharpened` at last.
    """
    h, w = image.shape
    if h < 3 or w < 3:
        return np.zeros((0, 4))
    up, low = image[:-1], image[1:]
    gx, gy = (up[:, 1:] + low[:, 1:] - up[:, :-1] - low[:, :-1]) / 2, (low[:, 1:] + low[:, :-1] - up[:, 1:] - up[:, :-1]) / 2
    size = np.hypot(gx, gy)
    j, i = np.nonzero(size > contrast)
    if not len(j):
        return np.zeros((0, 4))
    m, angle = size[j, i], np.arctan2(gy[j, i], gx[j, i])
    number = np.full((h + 1, w + 1), -1)
    number[j + 1, i + 1] = np.arange(len(j))
    steps = [number[j + 1 + dy, i + 1 + dx] for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))]
    a, b = np.tile(np.arange(len(j)), 4), np.concatenate(steps)
    a, b = a[b >= 0], b[b >= 0]
    off = lambda p, q: np.abs((p - q + np.pi) % (2 * np.pi) - np.pi)
    near = off(angle[a], angle[b]) < turn
    a, b = a[near], b[near]
    part = parts(len(j), a, b)
    total = lambda v: np.bincount(part, v, len(j))
    mean = np.arctan2(total(m * np.sin(angle)), total(m * np.cos(angle)))[part]
    true = off(angle, mean) < turn
    keep = true[a] & true[b]
    part = parts(len(j), a[keep], b[keep])
    x, y, mass = i + 0.5 - w / 2, j + 0.5 - h / 2, total(m)
    mass = np.maximum(mass, 1e-12)
    cx, cy = total(m * x) / mass, total(m * y) / mass
    dx, dy = x - cx[part], y - cy[part]
    xx, yy, xy = total(m * dx * dx) / mass, total(m * dy * dy) / mass, total(m * dx * dy) / mass
    axis = np.arctan2(2 * xy, xx - yy) / 2
    ux, uy = np.cos(axis), np.sin(axis)
    across = (xx + yy) / 2 - np.hypot((xx - yy) / 2, xy)
    along = dx * ux[part] + dy * uy[part]
    first, last = np.full(len(j), np.inf), np.full(len(j), -np.inf)
    np.minimum.at(first, part, along)
    np.maximum.at(last, part, along)
    with np.errstate(invalid="ignore"):
        good = (last - first >= length) & (across <= width * width)
    at = np.nonzero(good)[0]
    cx, cy, ux, uy, first, last = (v[at] for v in (cx, cy, ux, uy, first, last))
    return sharpened(image, np.stack([cx + first * ux, cy + first * uy, cx + last * ux, cy + last * uy], 1))


def sharpened(image: np.ndarray, seg: np.ndarray, reach: int = 3, end: float = 2.0) -> np.ndarray:
    """Segments laid through where the levels change in each row that they cross (or column, where they lie flat).

    That place is the mean of the changes within `reach` pixels, by their size, as exact as the levels are where an edge covers pixels in part. Rows near the ends,
    with another total change than most, or off the line by more than the others, aren't counted. A segment with too few rows, or moved by over half a pixel, stays as it is.
    """
    h, w = image.shape
    out = seg.copy()
    for n, (x1, y1, x2, y2) in enumerate(seg):
        steep = abs(y2 - y1) >= abs(x2 - x1)
        levels, side, across = (image, h, w) if steep else (image.T, w, h)
        a, b = ((x1, y1), (x2, y2)) if steep else ((y1, x1), (y2, x2))
        (p, s), (q, t) = (a, b) if a[1] <= b[1] else (b, a)
        slope = (q - p) / (t - s)
        rows = np.arange(max(int(np.ceil(s + end + side / 2)), 0), min(int(np.floor(t - end + side / 2)), side - 1) + 1)
        at = rows - side / 2
        near = np.rint(p + slope * (at - s) + across / 2 + 0.5).astype(int)  # the border of two pixels next to the line
        inside = (near >= reach) & (near <= across - reach)
        rows, at, near = rows[inside], at[inside], near[inside]
        if len(rows) < 6:
            continue
        change = np.diff(levels[rows[:, None], near[:, None] + np.arange(-reach, reach)], axis=1)
        total = change.sum(1)
        good = np.abs(total - np.median(total)) <= 0.05 * abs(np.median(total))
        with np.errstate(all="ignore"):
            place = near - 0.5 - across / 2 + change @ np.arange(1 - reach, reach) / total
        for _ in range(4):
            if good.sum() < 6:
                break
            by, where = np.polyfit(at[good], place[good], 1)
            miss = np.abs(place - by * at - where)
            good &= miss <= max(3 * 1.4826 * np.median(miss[good]), 0.02)
        if good.sum() < 6 or not max(abs(by * s + where - p), abs(by * t + where - q)) <= 0.5:
            continue
        ends = [(by * v + where, v) for v in (a[1], b[1])]
        out[n] = [v for e in ends for v in (e if steep else e[::-1])]
    return out


def misses(points: np.ndarray, mid: np.ndarray, half: np.ndarray) -> np.ndarray:
    """(points, segments): how far a segment's end is, in pixels, from the line through its middle and a vanishing point."""
    dx, dy = points[:, :1] - points[:, 2:] * mid[:, 0], points[:, 1:2] - points[:, 2:] * mid[:, 1]
    return np.abs(dx * half[:, 1] - dy * half[:, 0]) / np.maximum(np.hypot(dx, dy), 1e-12)


def linked(prefers: np.ndarray) -> list[np.ndarray]:
    """Groups of rows of a boolean matrix: the two groups whose common preferences overlap most (by Jaccard) are joined until none overlap.

    A group prefers what all its rows prefer. Ties go to the first pair.
    """
    own = prefers.astype(np.float32)
    size = own.sum(1)
    both = own @ own.T
    like = both / np.maximum(size[:, None] + size - both, 1)
    np.fill_diagonal(like, 0)
    groups = [[k] for k in range(len(own))]
    while len(own):
        p, q = divmod(int(like.argmax()), len(own))
        if like[p, q] <= 0:
            break
        groups[p] += groups[q]
        groups[q] = []
        own[p] *= own[q]
        own[q], size[p], size[q] = 0, own[p].sum(), 0
        both = own @ own[p]
        row = both / np.maximum(size + size[p] - both, 1)
        row[p] = 0
        like[p], like[:, p], like[q], like[:, q] = row, row, 0, 0
    return [np.array(sorted(g)) for g in groups if g]


def common_point(lines: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The point that weighted lines (n, 3) meet in, in the least squares."""
    return np.linalg.eigh((lines * weight[:, None]).T @ lines)[1][:, 0]


def turned(r: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Rotation `r` after a small turn."""
    a = np.linalg.norm(step)
    k = np.array([[0, -step[2], step[1]], [step[2], 0, -step[0]], [-step[1], step[0], 0]])
    s, c = (np.sin(a) / a, (1 - np.cos(a)) / (a * a)) if a > 1e-12 else (1.0, 0.5)
    return (np.eye(3) + s * k + c * k @ k) @ r


def loss(miss: np.ndarray, scale: float, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Sums of Cauchy's loss over the last axis."""
    return (np.log1p((miss / scale) ** 2) * weight).sum(-1)


def trust(half: np.ndarray) -> np.ndarray:
    """Weights of segments, 1 for one of 40 pixels askew: by length, as each row tells the place anew, and by the square of the few pixels that a nearly flat or upright one crosses.

    Such an edge meets its pixels all in the same part, and an image whose pixels are a few rays each moves it by up to a ray's share.
    """
    across = 2 * np.abs(half).min(1)
    return (np.clip(across, *CROSSED) / CROSSED[1]) ** 2 * np.hypot(half[:, 0], half[:, 1]) / 20


def right_angled(point: np.ndarray, others: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 3, 3) and focal lengths in pixels of a vanishing point with others at right angles to it, where these give one. Points are in units of `span`."""
    z = point[2] * others[:, 2]
    with np.errstate(all="ignore"):
        f2 = -(others[:, :2] @ point[:2]) / z
    good = (np.abs(z) >= 1e-9) & (f2 > 0.1) & (f2 < 100)
    f = np.sqrt(f2[good])
    rays = np.stack([np.broadcast_to(point, (len(f), 3)), others[good]], 1) * np.stack([np.ones_like(f), np.ones_like(f), f], 1)[:, None]
    rays /= np.linalg.norm(rays, axis=2)[:, :, None]
    return np.concatenate([rays, np.cross(rays[:, 0], rays[:, 1])[:, None]], 1), f * span


def fitted(r: np.ndarray, f: float, mid: np.ndarray, half: np.ndarray, limit: float, scale: float, rounds: int) -> tuple[np.ndarray, float] | None:
    """Rotation and focal length by damped steps to the segments that miss their nearest point by at most `limit`, by their `trust`; none where these are too few."""
    damp, sound = 1e-3, trust(half)

    def residuals(r, f, rows, which):
        v = r[which] * (f, f, 1)
        dx, dy = v[:, 0] - v[:, 2] * mid[rows, 0], v[:, 1] - v[:, 2] * mid[rows, 1]
        return (dx * half[rows, 1] - dy * half[rows, 0]) / np.maximum(np.hypot(dx, dy), 1e-12)

    for n in range(rounds):
        if n % 5 == 0:
            miss = misses(r * (f, f, 1), mid, half)
            which = miss.argmin(0)
            rows = np.nonzero(miss.min(0) <= limit)[0]
            which = which[rows]
            if len(rows) < MIN_LINES:
                return None
        e = residuals(r, f, rows, which)
        moves = [(turned(r, 1e-6 * d), f) for d in np.eye(3)] + [(r, f * (1 + 1e-6))]
        jac = np.stack([(residuals(*m, rows, which) - e) / 1e-6 for m in moves], 1)
        sure = sound[rows] / (1 + (e / scale) ** 2)  # of Cauchy's loss
        a = jac.T @ (jac * sure[:, None])
        step = -np.linalg.lstsq(a + damp * np.diag(np.diag(a)), jac.T @ (e * sure), rcond=None)[0]
        nr, nf = turned(r, step[:3]), f * np.exp(np.clip(step[3], -1, 1))
        if loss(residuals(nr, nf, rows, which), scale, sound[rows]) <= loss(e, scale, sound[rows]):
            r, f, damp = nr, nf, damp / 10
        else:
            damp *= 10
    return r, f


def camera(seg: np.ndarray, span: float, tolerance: float = 1.0, draws: int = 600, seed: int = 7):
    """(f, points, member) of segments from the centre, or None.

    `points` are three vanishing points of directions at right angles, (x, y, z) from the centre, and `member` is each segment's point, -1 for none. Pairs of
    segments, drawn with a seed by length, propose points; segments are grouped by which proposals they miss by at most `tolerance` pixels. Of a group's point with
    another group's, or with a proposal, the focal length follows from the right angle, and the third point too. Those that segments miss the least, by a robust loss, are
    fitted, unless they deal the segments alike; the best fit is gone on with, last at the scale that its own misses have.
    """
    n = len(seg)
    mid, half = (seg[:, :2] + seg[:, 2:]) / 2, (seg[:, 2:] - seg[:, :2]) / 2
    size = np.hypot(half[:, 0], half[:, 1])
    ends = [np.column_stack([seg[:, k : k + 2] / span, np.ones(n)]) for k in (0, 2)]
    lines = np.cross(*ends)
    lines /= np.hypot(lines[:, 0], lines[:, 1])[:, None]
    rng = np.random.default_rng(seed)
    first, second = rng.choice(n, (2, draws), p=size / size.sum())
    proposals = np.cross(lines[first], lines[second])
    proposals = proposals[np.linalg.norm(proposals, axis=1) > 1e-6]  # a segment with itself, or one line in two pieces
    scale = np.array([span, span, 1.0])
    prefers = misses(proposals * scale, mid, half).T <= tolerance
    groups = [g for g in linked(prefers) if len(g) > 2]
    found = np.array([common_point(lines[g], size[g] ** 2) for g in groups]).reshape(-1, 3)
    proposals /= np.linalg.norm(proposals, axis=1)[:, None]
    limit = 2 * tolerance
    off = lambda r, f: misses((r * np.stack([f, f, np.ones_like(f)], -1)[:, None]).reshape(-1, 3), mid, half).reshape(-1, 3, n)
    starts = []
    for p in range(len(found)):
        for others in (found[:p], proposals):
            r, f = right_angled(found[p], others, span)
            miss = off(r, f)
            least = miss.min(1)
            which = np.where(least <= limit, miss.argmin(1), -1)
            total = loss(np.minimum(least, limit), NOISE)
            best = total.argsort(kind="stable")[: 4 * TRIED]
            starts += [(total[k], which[k].tobytes(), r[k], f[k]) for k in best]

    def cost(r, f):
        """The robust loss of all segments; one that is alone at its point is half as bad as one that misses all, as a free focal length may explain any."""
        miss = misses(r * (f, f, 1), mid, half)
        which, miss = miss.argmin(0), np.minimum(miss.min(0), limit)
        worst, each = np.log1p((limit / SHARP) ** 2), np.log1p((miss / SHARP) ** 2)
        alone = np.bincount(which[miss < limit], minlength=3)[which] == 1
        return np.where(alone, np.maximum(each, worst / 2), each).sum()

    tried, best, least = set(), None, np.inf
    for _, dealt, r, f in sorted(starts, key=lambda s: s[0]):
        if dealt in tried:
            continue
        tried.add(dealt)
        if (got := fitted(r, f, mid, half, limit, NOISE, 15)) is not None:
            if (total := cost(*got)) < least:
                best, least = got, total
        if len(tried) == TRIED:
            break
    for _ in range(3):
        if best is None:
            return None
        miss = misses(best[0] * (best[1], best[1], 1), mid, half).min(0)
        own = np.clip(SPREAD * np.median(miss[miss <= limit]), *SCALES) if (miss <= limit).any() else NOISE
        best = fitted(*best, mid, half, limit, own, 20)
    if best is None:
        return None
    r, f = best
    miss = misses(r * (f, f, 1), mid, half)
    return f, r * (f, f, 1), np.where(miss.min(0) <= limit, miss.argmin(0), -1)


def cameras_from_lines(images: DataFrame, key: str, pixels: str = "pixels", **options) -> DataFrame:
    """(key, n_lines, f, points, members) per grey image of `width`, `height` and an array of levels from 0 to 255, row by row.

    `points` are three homogeneous image points (x, y, z) of directions at right angles, `members` how many lines go to each. An image that is null or of another
    size than stated has null everywhere; with fewer than five lines, or no two groups of lines that give a focal length, only `n_lines`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w, h, levels in zip(*(batch.column(k).to_pylist() for k in (1, 2)), batch.column(3)):
                if w is None or h is None or not levels.is_valid or len(levels) != w * h:
                    rows.append((None, None, None, None))
                    continue
                image = levels.values.to_numpy(zero_copy_only=False).reshape(h, w)
                seg = segments(np.nan_to_num(image.astype(float)))
                got = camera(seg, max(w, h) / 2, **options) if len(seg) >= MIN_LINES else None
                if got is None:
                    rows.append((len(seg), None, None, None))
                    continue
                f, points, member = got
                points = points + points[:, 2:] * (w / 2, h / 2, 0)
                rows.append((len(seg), f, points.tolist(), np.bincount(member[member >= 0], minlength=3).tolist()))
            types = [pa.int32(), pa.float64(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.int32())]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *OUT.names])

    schema = T.StructType([images.schema[key], *OUT.fields])
    return images.select(key, "width", "height", pixels).mapInArrow(run, schema)
