"""Pixel operations on one image in numpy: height x width x channels, values of 0 to 255. What they draw is given, or comes from a seeded generator.

Borders are mirrored without their last line. Colours are turned only where there are three channels. JPEG losses are those of its transform and
tables with all chroma kept; local equalisation works on luma.
"""

from __future__ import annotations

import numpy as np

#: Weights of luma, the sepia matrix, and JPEG's quantisation of luma and chroma at quality 50, row by row (fixed values).
LUMA = np.array([0.299, 0.587, 0.114])
SEPIA = np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]])
CHROMA = np.array([[-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
JPEG_LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
JPEG_CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    kh, kw = kernel.shape
    wide = np.pad(x, ((kh // 2, kh // 2), (kw // 2, kw // 2), (0, 0)), "reflect" if min(x.shape[:2]) > 1 else "edge")
    out = np.zeros(x.shape)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * wide[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def box(x, rng, k):
    taps = np.full((int(k), 1), 1 / int(k))
    return convolved(convolved(x, taps), taps.T)


def gaussian(x, rng, k):
    k = int(k)
    at = np.arange(k) - k // 2
    taps = np.exp(-0.5 * (at / (0.3 * ((k - 1) * 0.5 - 1) + 0.8)) ** 2)[:, None]
    return convolved(convolved(x, taps / taps.sum()), taps.T / taps.sum())


def median(x, rng, k):
    k = int(k)
    wide = np.pad(x, ((k // 2, k // 2), (k // 2, k // 2), (0, 0)), "edge").astype(np.uint8)
    out = np.empty(x.shape)
    for c in range(x.shape[2]):
        near = np.lib.stride_tricks.sliding_window_view(wide[:, :, c], (k, k)).reshape(*x.shape[:2], k * k)
        out[:, :, c] = np.partition(near, k * k // 2, -1)[:, :, k * k // 2]
    return out


def motion(x, rng, k, x1, y1, x2, y2):
    """A line between two places of the kernel."""
    k = int(k)
    ends = (np.array([[y1, x1], [y2, x2]]) * k).astype(int)
    steps = np.linspace(ends[0], ends[1], int(np.abs(ends[1] - ends[0]).max()) + 1).round().astype(int)
    kernel = np.zeros((k, k))
    kernel[steps[:, 0], steps[:, 1]] = 1
    return convolved(x, kernel / kernel.sum())


def bent_gaussian(x, rng, k, sx, sy, turn, power, low, high):
    at = np.arange(int(k)) - int(k) // 2
    a = np.radians(turn)
    u, v = np.cos(a) * at[None] + np.sin(a) * at[:, None], np.cos(a) * at[:, None] - np.sin(a) * at[None]
    kernel = np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2) ** power) * rng.uniform(low, high, (len(at), len(at)))
    return convolved(x, kernel / kernel.sum())


def sharpen(x, rng, alpha, light):
    kernel = np.full((3, 3), -alpha)
    kernel[1, 1] = 1 - alpha + alpha * (8 + light)
    return convolved(x, kernel)


def exposure(x, rng, bright, contrast):
    return x * (1 + contrast) + bright * 255


def gamma(x, rng, percent):
    return 255 * (x / 255) ** (percent / 100)


def tone_curve(x, rng, scale):
    t, (low, high) = x / 255, np.clip(rng.normal((0.25, 0.75), scale), 0, 1)
    return 255 * (3 * (1 - t) ** 2 * t * low + 3 * (1 - t) * t**2 * high + t**3)


def grey(x, rng):
    return np.repeat((x @ LUMA)[:, :, None], 3, 2) if x.shape[2] == 3 else x


def sepia(x, rng):
    return x @ SEPIA.T if x.shape[2] == 3 else x


def hsv_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in turns, saturation and value of colours in [0, 1]."""
    top, low = rgb.max(-1), rgb.min(-1)
    span = top - low
    r, g, b = (np.divide(top - rgb[..., i], span, out=np.zeros_like(top), where=span > 0) for i in range(3))
    h = np.where(top == rgb[..., 0], b - g, np.where(top == rgb[..., 1], 2 + r - b, 4 + g - r))
    return np.where(span > 0, h / 6 % 1, 0.0), np.divide(span, top, out=np.zeros_like(top), where=top > 0), top


def rgb_of(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    def channel(n):
        k = (n + h * 6) % 6
        return v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1)

    return np.stack([channel(5), channel(3), channel(1)], -1)


def hue_saturation(x, rng, hue, saturation, value):
    """Hue by half degrees, saturation and value by levels."""
    if x.shape[2] != 3:
        return x
    h, s, v = hsv_of(x / 255)
    return 255 * rgb_of((h + hue / 180) % 1, np.clip(s + saturation / 255, 0, 1), np.clip(v + value / 255, 0, 1))


def jitter(x, rng, bright, contrast, saturation, hue):
    """Brightness, contrast and saturation as factors, hue in turns, in an order drawn."""
    for i in rng.permutation(4):
        y = x @ LUMA if x.shape[2] == 3 else x[:, :, 0]
        if i == 0:
            x = x * bright
        elif i == 1:
            x = y.mean() + (x - y.mean()) * contrast
        elif i == 2:
            x = y[:, :, None] + (x - y[:, :, None]) * saturation
        else:
            x = hue_saturation(x, rng, hue * 180, 0, 0)
        x = np.clip(x, 0, 255)
    return x


def gauss_noise(x, rng, variance):
    return x + rng.normal(0, np.sqrt(variance), x.shape)


def factor_noise(x, rng, low, high):
    return x * rng.uniform(low, high, x.shape)


def sensor_noise(x, rng, shift, strength):
    """Poisson noise of lightness by its spread, and normal noise of hue."""
    if x.shape[2] != 3:
        return x
    rgb = x / 255
    light = (rgb.max(-1) + rgb.min(-1)) / 2
    more = rng.poisson(light.std() * strength * 255, light.shape) / 255 * (1 - light)
    h, s, v = hsv_of(rgb)
    turned = rgb_of((h + rng.normal(0, shift * strength, h.shape)) % 1, s, v)
    room = np.divide(1 - light - more, 1 - light, out=np.zeros_like(light), where=light < 1)  # lightness grows towards white
    return 255 * (1 - (1 - turned) * room[..., None])


def _ycc(x):
    return np.concatenate([(x @ LUMA)[..., None], x @ CHROMA.T + 128], -1)


_BACK = np.linalg.inv(np.vstack([LUMA, CHROMA]))
_PLACE = np.arange(8)
_DCT = np.sqrt(np.where(_PLACE == 0, 1, 2) / 8)[:, None] * np.cos((2 * _PLACE[None] + 1) * _PLACE[:, None] * np.pi / 16)


def jpeg(x, rng, quality):
    q = np.clip(np.rint(quality), 1, 100)
    scale = 5000 / q if q < 50 else 200 - 2 * q
    y = _ycc(x) if x.shape[2] == 3 else x
    h, w, n = y.shape
    y = np.pad(y, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge") - 128
    for c in range(n):
        table = np.array((JPEG_CHROMA if c and n == 3 else JPEG_LUMA).split(), float).reshape(8, 8)
        table = np.clip(np.floor((table * scale + 50) / 100), 1, 255)
        blocks = y[:, :, c].reshape(y.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        kept = np.rint(_DCT @ blocks @ _DCT.T / table) * table
        y[:, :, c] = (_DCT.T @ kept @ _DCT).swapaxes(1, 2).reshape(y.shape[:2])
    y = np.clip(np.rint(y[:h, :w] + 128), 0, 255)
    return (y - [0, 128, 128]) @ _BACK.T if n == 3 else y


def _resampling(n: int, to: int, how: str) -> np.ndarray:
    """The matrix that brings n values to `to`."""
    out = np.zeros((to, n))
    if how == "area":
        edges = np.arange(to + 1) * n / to
        for i in range(to):
            cells = np.arange(n)
            out[i] = np.clip(np.minimum(edges[i + 1], cells + 1) - np.maximum(edges[i], cells), 0, None)
        return out / out.sum(1, keepdims=True)
    at = (np.arange(to) + 0.5) * n / to - 0.5
    low = np.floor(at).astype(int)
    reach = (0, 1) if how == "linear" else (-1, 0, 1, 2)
    for d in reach:
        t = np.abs(at - low - d)
        cubic = np.where(t <= 1, 1.25 * t**3 - 2.25 * t**2 + 1, -0.75 * (t**3 - 5 * t**2 + 8 * t - 4))
        np.add.at(out, (np.arange(to), np.clip(low + d, 0, n - 1)), 1 - t if how == "linear" else cubic)
    return out


#: Ways to make an image smaller and larger again, by number.
WAYS = (("area", "linear"), ("linear", "linear"), ("linear", "cubic"), ("cubic", "linear"), ("linear", "area"))


def coarsened(x, rng, scale, way):
    for how, (h, w) in zip(WAYS[int(way)], ([max(1, int(n * scale)) for n in x.shape[:2]], x.shape[:2])):
        x = np.einsum("ij,jwc->iwc", _resampling(x.shape[0], h, how), x)
        x = np.einsum("ij,hjc->hic", _resampling(x.shape[1], w, how), x)
    return x


def equalised(x, rng):
    out = np.empty(x.shape)
    for c in range(x.shape[2]):
        levels = x[:, :, c].astype(np.uint8)
        total = np.bincount(levels.ravel(), minlength=256).cumsum()
        first = total[levels.min()]
        out[:, :, c] = levels if first == levels.size else np.rint((total - first) / (levels.size - first) * 255)[levels]
    return out


def locally_equalised(x, rng, clip, tiles=8):
    """Luma equalised tile by tile, counts above the limit shared out, and tables mixed between the middles of tiles."""
    y = np.rint(x @ LUMA if x.shape[2] == 3 else x[:, :, 0]).clip(0, 255)
    h, w = y.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    cells = np.pad(y, ((0, th * tiles - h), (0, tw * tiles - w)), "symmetric" if min(h, w) >= tiles else "edge").astype(int)
    cells = cells.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, -1)
    counts = np.zeros((tiles * tiles, 256))
    np.add.at(counts, (np.arange(tiles * tiles)[:, None], cells), 1)
    limit = max(1, int(clip * th * tw / 256))
    over = np.clip(counts - limit, 0, None).sum(1, keepdims=True)
    tables = ((np.minimum(counts, limit) + over / 256).cumsum(1) * 255 / (th * tw)).reshape(tiles, tiles, 256)
    at = [np.clip((np.arange(n) + 0.5) / t - 0.5, 0, tiles - 1) for n, t in ((h, th), (w, tw))]
    low = [np.minimum(a.astype(int), tiles - 2) for a in at]
    (fi, fj), (i, j), level = [a - b for a, b in zip(at, low)], low, y.astype(int)
    corner = lambda di, dj: tables[(i + di)[:, None], (j + dj)[None], level]
    new = (corner(0, 0) * (1 - fj) + corner(0, 1) * fj) * (1 - fi)[:, None] + (corner(1, 0) * (1 - fj) + corner(1, 1) * fj) * fi[:, None]
    return x + (new - y)[:, :, None]


def shade(x, rng, transparency, k, ellipses=10):
    """Darker or lighter by blurred ellipses."""
    h, w = x.shape[:2]
    mask, (yy, xx), quarter = np.zeros((h, w, 1)), np.mgrid[:h, :w], min(h, w) / 4
    for _ in range(ellipses):
        ax, ay = (max(1, int(max(u * quarter, quarter / 5))) for u in rng.random(2))
        reach, a = max(ax, ay), np.radians(rng.random() * 90)
        cx, cy = rng.integers(reach, max(w - reach, reach + 1)), rng.integers(reach, max(h - reach, reach + 1))
        u, v = (xx - cx) * np.cos(a) + (yy - cy) * np.sin(a), (yy - cy) * np.cos(a) - (xx - cx) * np.sin(a)
        mask[(u / ax) ** 2 + (v / ay) ** 2 <= 1] = 1
    return x * (1 - transparency * gaussian(mask, rng, k))


def rain(x, rng, slant, length=20):
    """Streaks of one slant, blurred, in a darker image."""
    h, w = x.shape[:2]
    n = h * w // 770
    y, at, out = rng.integers(0, max(1, h - length), n), rng.integers(0, w, n), x.copy()
    for t in range(length):
        out[np.minimum(y + t, h - 1), np.clip(at + int(slant * t / length), 0, w - 1)] = 200
    return box(out, rng, 7) * 0.7
