"""Numeric codec: row scales, k-bit codes, bit planes (column forms) and 8-bit scalar streams (array forms)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def row_scale(values: Column, bits: int) -> Column:
    """1 bit: mean magnitude; k bits: largest magnitude over 2^(k-1)-1; at least 1e-8."""
    size = F.transform(doubles(values), lambda x: F.abs(x))
    if bits == 1:
        scale = F.aggregate(size, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    else:
        scale = F.array_max(size) / F.lit(float(2 ** (bits - 1) - 1))
    return F.greatest(scale, F.lit(1e-8))


def codes(values: Column, scale: Column, bits: int) -> Column:
    """Unsigned codes; halves are rounded to even, zero counts as positive where there is one bit."""
    if bits == 1:
        return F.transform(doubles(values), lambda x: F.when(x >= 0, 1).otherwise(0))
    top = 2 ** (bits - 1) - 1
    return F.transform(doubles(values), lambda x: (F.least(F.lit(float(top)), F.greatest(F.lit(float(-top - 1)), F.rint(x / scale))) + top + 1).cast("int"))


def dequantize(code: Column, scale: Column, bits: int) -> Column:
    if bits == 1:
        return F.transform(code, lambda c: F.when(c == 1, scale).otherwise(-scale))
    top = 2 ** (bits - 1) - 1
    return F.transform(code, lambda c: (c - (top + 1)) * scale)


def plane_words(code: Column, plane: int) -> Column:
    """32-bit words of one bit plane: bit i of word w is bit ``plane`` of code 32w+i; the last word is padded."""
    n = F.floor((F.size(code) + 31) / 32).cast("int")

    def word(w: Column) -> Column:
        part = F.slice(code, w * 32 + 1, F.lit(32))
        bits = F.transform(part, lambda c, i: F.shiftright(c, plane).bitwiseAND(1).cast("long") * F.pow(F.lit(2.0), i).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<long>"))


# ------------------------------------------------------------------ scalar streams


def half(x: float) -> np.float32:
    return np.float32(np.float16(x))


def int8_encode(x: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """Symmetric 8-bit codes and their step, which is what a half-precision header holds."""
    x = np.asarray(x, np.float32)
    step = half(max(float(np.abs(x).max(initial=0.0)) / 127.0, 1e-4))
    return np.clip(np.rint(x / step), -127, 127).astype(np.int8), step


def log8_encode(x: np.ndarray) -> tuple[np.ndarray, np.float32, np.float32]:
    """8-bit codes uniform in the logarithm, for positive values; low end and step in half precision."""
    logs = np.log(np.maximum(np.asarray(x, np.float32), np.float32(1e-8)))
    lo = half(logs.min())
    step = half(max(float(logs.max() - lo) / 255.0, 1e-4))
    return np.clip(np.rint((logs - lo) / step), 0, 255).astype(np.uint8), lo, step


def decode_segments(segments: list[tuple[str, int]], halves: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """Values of a stream of segments (encoding, count): plain halves, 8-bit linear, 8-bit logarithmic."""
    halves = np.asarray(halves, np.float16).astype(np.float32)
    out, h, o = [], 0, 0
    for how, n in segments:
        if how == "f16":
            out.append(halves[h : h + n])
            h += n
            continue
        part = octets[o : o + n]
        o += n
        if how == "i8":
            out.append(part.view(np.int8).astype(np.float32) * halves[h])
            h += 1
        elif how == "log8":
            out.append(np.exp(halves[h] + part.astype(np.float32) * halves[h + 1]))
            h += 2
        else:
            raise ValueError(f"unknown encoding {how}")
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def pack_planes(code: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a matrix of codes, rows padded to whole words: (bits, rows, words) of uint32."""
    rows, cols = code.shape
    words = -(-cols // 32)
    wide = np.zeros((rows, words * 32), np.uint32)
    wide[:, :cols] = code
    shift = np.arange(32, dtype=np.uint32)
    cells = wide.reshape(rows, words, 32)
    return np.stack([(((cells >> np.uint32(b)) & 1) << shift).sum(-1, dtype=np.uint64).astype(np.uint32) for b in range(bits)])


def unpack_planes(planes: np.ndarray, cols: int) -> np.ndarray:
    shift = np.arange(32, dtype=np.uint32)
    out = 0
    for b, plane in enumerate(planes):
        bits = (plane[:, :, None] >> shift) & np.uint32(1)
        out = out + (bits.reshape(plane.shape[0], -1)[:, :cols].astype(np.int64) << b)
    return np.asarray(out)
