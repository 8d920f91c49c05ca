"""Bytes of images (PNG, PPM, PGM) and of tensors (.npy), from and to numpy arrays. What can't be read raises ValueError with the reason."""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type (fixed values): grey, RGB, palette, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
COLOUR = {1: 0, 3: 2, 2: 4, 4: 6}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (2,), level: int = 6) -> bytes:
    """A PNG of (height, width, channels) in 8 or 16 bits; line by line the filters take turns: none, left, up, mean of both, Paeth's."""
    h, w, channels = pixels.shape
    depth = pixels.dtype.itemsize * 8
    if pixels.dtype not in (np.uint8, np.uint16) or channels not in COLOUR:
        raise ValueError("pixels are 8 or 16 bits in 1 to 4 channels")
    rows = np.ascontiguousarray(pixels.astype(pixels.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1).astype(np.int16)
    unit = channels * depth // 8
    left = np.pad(rows, ((0, 0), (unit, 0)))[:, : rows.shape[1]]
    up = np.pad(rows, ((1, 0), (0, 0)))[:h]
    corner = np.pad(left, ((1, 0), (0, 0)))[:h]
    guess = [0 * rows, left, up, (left + up) // 2, _paeth(left, up, corner)]
    kind = np.array([filters[i % len(filters)] for i in range(h)], np.uint8)
    lines = (rows - np.stack(guess)[kind, np.arange(h)]).astype(np.uint8)
    data = zlib.compress(np.concatenate([kind[:, None], lines], 1).tobytes(), level)
    head = struct.pack(">IIBBBBB", w, h, depth, COLOUR[channels], 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one nearest to left + up - corner, in this order."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _unfilter(kind: np.ndarray, lines: np.ndarray, unit: int) -> np.ndarray:
    """Bytes of lines from what their filters left. Left and mean run along a line, pixel after pixel; a pixel's bytes go together."""
    h, width = lines.shape
    out = np.zeros((h + 1, width + unit), np.int16)
    for y in range(h):
        line, row, above = lines[y].astype(np.int16), out[y + 1], out[y]
        if kind[y] == 0:
            row[unit:] = line
        elif kind[y] == 1:
            row[unit:] = np.cumsum(line.reshape(-1, unit), axis=0, dtype=np.int64).reshape(-1) % 256
        elif kind[y] == 2:
            row[unit:] = (line + above[unit:]) % 256
        elif kind[y] in (3, 4):
            for x in range(unit, width + unit, unit):
                a, b, c = row[x - unit : x], above[x : x + unit], above[x - unit : x]
                row[x : x + unit] = (line[x - unit : x] + ((a + b) // 2 if kind[y] == 3 else _paeth(a, b, c))) % 256
        else:
            raise ValueError(f"line filter {kind[y]}")
    return out[1:, unit:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) in 8 or 16 bits; 1 to 4 bits of grey are stretched to 8, a palette gives its colours. Interlaced files aren't read."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at, head, palette, alpha, parts = len(PNG), None, None, None, []
    while True:
        if at + 12 > len(data):
            raise ValueError("it ends early")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    w, h, depth, colour, _, _, interlaced = head or (0, 0, 0, -1, 0, 0, 0)
    if colour not in CHANNELS or not w or not h or depth not in (1, 2, 4, 8, 16) or interlaced:
        raise ValueError("a kind of PNG that isn't read")
    channels = CHANNELS[colour]
    width = (w * channels * depth + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != h * (width + 1):
        raise ValueError("too few or too many pixels")
    raw = raw.reshape(h, width + 1)
    rows = _unfilter(raw[:, 0], raw[:, 1:], max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :w]
        rows = rows if colour == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
    pixels = rows.view(">u2").astype(np.uint16) if depth == 16 else rows
    pixels = pixels.reshape(h, w, channels)
    if colour != 3:
        return pixels
    if palette is None or pixels.max() >= len(palette):
        raise ValueError("a colour that its palette lacks")
    table = palette
    if alpha is not None:
        table = np.concatenate([palette, np.pad(alpha, (0, len(palette) - len(alpha)), constant_values=255)[:, None]], 1)
    return table[pixels[:, :, 0]]


_NETPBM = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary PGM and PPM, 8 or 16 bits."""
    m = _NETPBM.match(data)
    if not m:
        raise ValueError("not a binary PGM or PPM")
    kind, (w, h, top) = m[1], map(int, m.groups()[1:])
    shape, dtype = (h, w, 3 if kind == b"P6" else 1), np.uint8 if top < 256 else np.dtype(">u2")
    want = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if not want or len(data) - m.end() < want:
        raise ValueError("it ends early")
    pixels = np.frombuffer(data, dtype, int(np.prod(shape)), m.end()).reshape(shape)
    return pixels if top < 256 else pixels.astype(np.uint16)


def encode_netpbm(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    if channels not in (1, 3) or pixels.dtype not in (np.uint8, np.uint16):
        raise ValueError("pixels are 8 or 16 bits in 1 or 3 channels")
    top = np.iinfo(pixels.dtype).max
    return f"{'P5' if channels == 1 else 'P6'}\n{w} {h}\n{top}\n".encode() + pixels.astype(pixels.dtype.newbyteorder(">")).tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_png(data) if data[:4] == PNG[:4] else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 1): the usual weights of red, green and blue, rounded; alpha is left out."""
    if pixels.shape[2] < 3:
        return pixels[:, :, :1]
    return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None].astype(pixels.dtype)


def encode_npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def decode_npy(data: bytes) -> np.ndarray:
    """Either order of storage and of bytes; objects aren't read."""
    try:
        return np.load(io.BytesIO(data), allow_pickle=False)
    except (EOFError, OSError, ValueError) as e:
        raise ValueError("not a whole .npy file of numbers") from e
