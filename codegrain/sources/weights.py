"""Packed weight files: bit planes, then half-precision headers, then 8-bit codes, beside a JSON directory."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from codegrain.functions import codec

FORMAT = 1


def save_weights(folder: str | Path, tensors: dict[str, np.ndarray], bits: dict[str, int]) -> dict:
    """Write ``weights.bin`` and ``weights.json``; returns the directory.

    Matrices listed in ``bits`` become k-bit codes with one scale per row (kept as logarithmic octets), all
    other arrays become linear octets.  Rows are padded to whole words.
    """
    planes: list[np.ndarray] = []
    segments: list[tuple[str, int]] = []
    halves: list[float] = []
    octets: list[np.ndarray] = []
    entries: dict[str, dict] = {}
    words = 0
    for name, x in tensors.items():
        x = np.asarray(x, np.float32)
        entry = {"shape": list(x.shape), "segment": len(segments)}
        if name in bits:
            k = bits[name]
            size = np.abs(x)
            scale = np.maximum(size.mean(1) if k == 1 else size.max(1) / (2 ** (k - 1) - 1), 1e-8)
            code8, lo, step = codec.log8_encode(scale)
            segments.append(("log8", len(scale)))
            halves += [float(lo), float(step)]
            octets.append(code8)
            kept = codec.decode_segments([("log8", len(scale))], np.array([lo, step]), code8)[:, None]
            top = 2 ** (k - 1) - 1
            code = (x >= 0).astype(np.int64) if k == 1 else (np.clip(np.rint(x / kept), -top - 1, top) + top + 1).astype(np.int64)
            packed = codec.pack_planes(code, k)
            entry |= {"bits": k, "words": words}
            words += packed.size
            planes.append(packed.ravel())
        else:
            code, step = codec.int8_encode(x.ravel())
            segments.append(("i8", x.size))
            halves.append(float(step))
            octets.append(code.view(np.uint8))
        entries[name] = entry
    blob = [np.concatenate(planes) if planes else np.zeros(0, np.uint32), np.array(halves, np.float16), np.concatenate(octets) if octets else np.zeros(0, np.uint8)]
    meta = {"format": FORMAT, "words": words, "halves": len(halves), "octets": int(blob[2].size), "segments": segments, "tensors": entries}
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "weights.bin").write_bytes(blob[0].astype("<u4").tobytes() + blob[1].astype("<f2").tobytes() + blob[2].tobytes())
    (folder / "weights.json").write_text(json.dumps(meta))
    return meta


def load_weights(folder: str | Path) -> dict[str, np.ndarray]:
    """All tensors of a folder, dequantised.  A file of another length than its directory says is refused."""
    folder = Path(folder)
    meta = json.loads((folder / "weights.json").read_text())
    raw = (folder / "weights.bin").read_bytes()
    if meta["format"] != FORMAT or len(raw) != 4 * meta["words"] + 2 * meta["halves"] + meta["octets"]:
        raise ValueError("the weight file does not fit its directory")
    planes = np.frombuffer(raw, "<u4", meta["words"])
    halves = np.frombuffer(raw, "<f2", meta["halves"], 4 * meta["words"])
    octets = np.frombuffer(raw, np.uint8, offset=4 * meta["words"] + 2 * meta["halves"])
    flat = codec.decode_segments([tuple(s) for s in meta["segments"]], halves, octets)
    starts = np.concatenate(([0], np.cumsum([n for _, n in meta["segments"]]))).astype(int)
    out = {}
    for name, e in meta["tensors"].items():
        part = flat[starts[e["segment"]] : starts[e["segment"] + 1]]
        if "bits" not in e:
            out[name] = part.reshape(e["shape"])
            continue
        k, (rows, cols) = e["bits"], e["shape"]
        width = -(-cols // 32)
        code = codec.unpack_planes(planes[e["words"] : e["words"] + k * rows * width].reshape(k, rows, width), cols)
        step = part[:, None]
        out[name] = np.where(code == 1, step, -step) if k == 1 else (code - 2 ** (k - 1)) * step
    return {n: np.asarray(x, np.float32) for n, x in out.items()}


def verify(folder: str | Path, tensors: dict[str, np.ndarray], most: float = 2e-3) -> float:
    """Largest error of the unquantised arrays after a round trip, relative to their range; raises beyond ``most``."""
    back = load_weights(folder)
    meta = json.loads((Path(folder) / "weights.json").read_text())
    worst = 0.0
    for name, x in tensors.items():
        if "bits" not in meta["tensors"][name]:
            worst = max(worst, float(np.abs(back[name] - x).max(initial=0)) / max(float(np.abs(x).max(initial=0)) * 2, 1e-3))
    if worst > most + 1 / 127 / 4:
        raise ValueError(f"round trip error {worst}")
    return worst
