"""Classifying tokens: a small bidirectional gated-recurrence network over token features, in NumPy.

Weights are seeded here or given by the caller; nothing is trained in this module.  A batch of Arrow rows is
one call: features of all its texts are made at once, the dense layers run over all their tokens, and only
the recurrences step, over all texts side by side.  Documents are independent, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.featurize import features, group_sums
from codegrain.functions.lexing import CLASSES
from codegrain.functions.shingles import text_buffers
from codegrain.operators.parallel import spread
from codegrain.schemas import LAYOUTS, N_FLAGS, WORD_HASHES


@dataclass(frozen=True)
class Config:
    layout: str = "compact_v2"
    dim: int = 16
    embed: int = 8
    layers: int = 2
    kernel: int = 5
    dilations: tuple[int, ...] = (1, 2, 4)
    film: int = 4
    erase: int = 4
    hidden: int = 24
    classes: int = 9
    views: str = "prefix_suffix"
    decay_ahead: tuple[float, float] = (0.90, 0.998)
    decay_back: tuple[float, float] = (0.20, 0.93)


def decay_logits(dim: int, lo: float, hi: float) -> np.ndarray:
    """Logits whose sigmoids run from lo to hi, evenly in log(1 - decay)."""
    gamma = np.clip(1 - np.exp(np.linspace(np.log(1 - lo), np.log(1 - hi), dim)), 1e-4, 1 - 1e-4)
    return np.log(gamma / (1 - gamma)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def squash(x: np.ndarray) -> np.ndarray:
    return np.tanh(np.clip(x, -15, 15))


def rms(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return x * gain / np.sqrt(np.mean(np.square(x), -1, keepdims=True) + 1e-6)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + np.tanh(0.7978845608 * x * (1 + 0.044715 * x * x))) / 2


def seeded_weights(c: Config, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights for tests and smoke runs: every tensor by name, drawn from one seed."""
    rng = np.random.default_rng(seed)
    views = 4 if c.views == "full" else 2
    shapes = {
        "embed": (LAYOUTS[c.layout].rows, c.embed), "up": (c.dim, c.embed), "film_down": (c.film, 2 * c.dim), "film_up": (c.layers * 2 * c.dim, c.film),
        "summary": (c.dim, views * c.dim), "gate": (c.dim, c.dim), "head_hidden": (c.hidden, 2 * c.dim), "head_out": (c.classes, c.hidden),
    }
    for i in range(c.layers):
        shapes |= {f"conv{i}": (c.dim, c.kernel), f"in{i}": (2 * c.dim, c.dim), f"erase_down{i}": (c.erase, c.dim), f"erase_up{i}": (2 * c.dim, c.erase), f"out{i}": (c.dim, 2 * c.dim)}
    w = {n: (rng.standard_normal(s) / np.sqrt(s[1])).astype(np.float32) for n, s in shapes.items()}
    w["strength"] = (rng.standard_normal((c.layers, c.dim)) / 4).astype(np.float32)
    for i in range(c.layers):
        w[f"ahead{i}"], w[f"back{i}"] = decay_logits(c.dim, *c.decay_ahead), decay_logits(c.dim, *c.decay_back)
    return w


class Texts:
    """Tokens of several texts laid side by side: (text, position) with a mask."""

    def __init__(self, row: np.ndarray, n: int):
        self.length = np.bincount(row, minlength=n)
        self.row, self.col = row, np.arange(len(row)) - np.concatenate(([0], np.cumsum(self.length)))[row]
        self.shape = (n, int(self.length.max(initial=0)))
        self.mask = np.arange(self.shape[1])[None, :] < self.length[:, None]

    def spread(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((*self.shape, x.shape[-1]), np.float32)
        out[self.row, self.col] = x
        return out

    def gather(self, x: np.ndarray) -> np.ndarray:
        return x[self.row, self.col]


def recur(keep: np.ndarray, add: np.ndarray, back: bool = False) -> np.ndarray:
    """h = keep * h + add along the positions of all texts at once, forwards or backwards."""
    out = np.empty_like(add)
    h = np.zeros_like(add[:, 0]) if add.shape[1] else None
    steps = range(add.shape[1])
    for t in reversed(steps) if back else steps:
        h = keep[:, t] * h + add[:, t]
        out[:, t] = h
    return out


def dilated_conv(x: np.ndarray, taps: np.ndarray, step: int) -> np.ndarray:
    """Depthwise convolution along positions, zeros beyond the ends; ``taps``: (channels, taps)."""
    half = taps.shape[1] // 2
    wide = np.pad(x, ((0, 0), (half * step, half * step), (0, 0)))
    return sum(wide[:, j * step : j * step + x.shape[1]] * taps[:, j] for j in range(taps.shape[1]))


def logits(f: dict[str, np.ndarray], n: int, c: Config, w: dict[str, np.ndarray]) -> np.ndarray:
    """Class scores per token, tokens in the order of ``f``."""
    lay = LAYOUTS[c.layout]
    e = np.zeros((len(f["row"]), c.embed), np.float32)
    for name, at in lay.offsets.items():
        if name == "flags":
            e += ((f["flags"][:, None] >> np.arange(N_FLAGS)) & 1).astype(np.float32) @ w["embed"][at : at + N_FLAGS]
        else:
            part = w["embed"][at + f[name]]
            e += part * (f["kind"] == 0)[:, None] if name in WORD_HASHES else part
    t = Texts(f["row"], n)
    x = t.spread(e @ w["up"].T)
    m = t.mask[:, :, None].astype(np.float32)
    size = np.maximum(t.length, 1)[:, None]
    top = np.where(t.mask[:, :, None], x, -np.inf).max(1, initial=-np.inf)
    top[~np.isfinite(top)] = 0
    mean = x.sum(1) / size
    film = squash(rms(np.concatenate((mean, top), -1), np.float32(1)) @ w["film_down"].T) @ w["film_up"].T
    film = squash(film.reshape(n, c.layers, 2, c.dim))
    first = x
    for i in range(c.layers):
        h = rms(x, np.float32(1)) * (1 + w["strength"][i] * film[:, None, i, 0]) + w["strength"][i] * film[:, None, i, 1]
        h = dilated_conv(h * m, w[f"conv{i}"], c.dilations[i] if i < len(c.dilations) else 1)
        both = h @ w[f"in{i}"].T
        add = squash(both[..., : c.dim]) * sigmoid(both[..., c.dim :]) * m
        forget = sigmoid(squash(h @ w[f"erase_down{i}"].T) @ w[f"erase_up{i}"].T)
        ahead = recur(sigmoid(w[f"ahead{i}"]) * (1 - forget[..., : c.dim]), add)
        back = recur(sigmoid(w[f"back{i}"]) * (1 - forget[..., c.dim :]), add, back=True)
        x = (x + np.concatenate((ahead, back), -1) @ w[f"out{i}"].T / 2) * m
    open_ = sigmoid(x) * m
    prefix = np.cumsum(x * open_, 1) / np.maximum(np.cumsum(open_, 1), 1)
    tail = np.cumsum((x * m)[:, ::-1], 1)[:, ::-1] / np.maximum(np.cumsum(m[:, ::-1], 1)[:, ::-1], 1)
    views = [prefix, tail]
    if c.views == "full":
        views = [np.broadcast_to((x.sum(1) / size)[:, None], x.shape), np.broadcast_to(np.where(t.mask[:, :, None], x, -np.inf).max(1, keepdims=True, initial=-1e30), x.shape), *views]
    # the head looks at one token at a time: from here on without the padding
    view, x, first = t.gather(np.concatenate(views, -1).astype(np.float32)), t.gather(x), t.gather(first)
    context = squash(view @ w["summary"].T) * sigmoid(x @ w["gate"].T)
    head = np.concatenate((rms(x + 0.5 * first, np.float32(1)), context), -1)
    return gelu(head @ w["head_hidden"].T) @ w["head_out"].T


SPAN = "array<struct<type:string,start:int,end:int>>"
_BATCH = 1 << 18  # bytes of text, padded, that run through the layers at once


class Lexer:
    """The inference API: token classes and spans of a text column.

    ``classify`` gives one row per token, ``spans`` one row per text with merged spans; texts without tokens
    keep their row with an empty array.  ``features`` and ``tokens`` are the stages before.
    """

    def __init__(self, config: Config | None = None, weights: dict[str, np.ndarray] | None = None):
        self.config = config or Config()
        self.weights = weights or seeded_weights(self.config)

    def supports(self, lang: str | None) -> bool:
        """Any language: the features need no grammar."""
        return True

    def features(self, df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
        from codegrain.functions.featurize import token_rows

        lay = LAYOUTS[self.config.layout]
        return token_rows(df, id_col, text_col, self.config.layout, ["start", "end", *lay.fields, "flags"], *carry)

    def _classes(self, column: pa.Array) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]]:
        """Groups of texts of like length, so that little is padded: their places, features and classes."""
        size = np.diff(text_buffers(column)[0])
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and size[order[stop]] * (stop + 1 - at) <= _BATCH:
                stop += 1
            places = order[at:stop]
            offsets, raw = text_buffers(column.take(pa.array(places)))
            f = features(offsets, raw, self.config.layout)
            cls = logits(f, len(places), self.config, self.weights).argmax(-1) if len(f["row"]) else np.zeros(0, np.int64)
            yield places, f, cls
            at = stop

    def classify(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, tok_ix, start, end, cls`` per token."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for places, f, cls in self._classes(b.column(1)):
                    row = f["row"]
                    ix = np.arange(len(row)) - np.searchsorted(row, row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places[row])), *[pa.array(v.astype(np.int32)) for v in (ix, f["start"], f["end"], cls)]], names=[id_col, "tok_ix", "start", "end", "cls"])

        src = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")))
        return src.mapInArrow(work, f"`{id_col}` {src.schema[0].dataType.simpleString()}, tok_ix int, start int, end int, cls int")

    def class_counts(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, cls, n``: tokens of each text by class, counted in the batch."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for places, f, cls in self._classes(b.column(1)):
                    row, (kind,), (n,) = group_sums(f["row"], [cls], [])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places[row])), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=[id_col, "cls", "n"])

        src = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")))
        return src.mapInArrow(work, f"`{id_col}` {src.schema[0].dataType.simpleString()}, cls int, n long")

    def alone(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, same``: whether a text's classes in a batch are those that it gets alone."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                same = np.ones(b.num_rows, bool)
                for places, f, cls in self._classes(b.column(1)):
                    bounds = np.searchsorted(f["row"], np.arange(len(places) + 1))
                    for i, place in enumerate(places.tolist()):
                        own = [c for _, _, c in self._classes(b.column(1).slice(place, 1))]
                        same[place] = np.array_equal(cls[bounds[i] : bounds[i + 1]], own[0] if own else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same)], names=[id_col, "same"])

        src = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")))
        return src.mapInArrow(work, f"`{id_col}` {src.schema[0].dataType.simpleString()}, same boolean")

    def spans(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, spans``: neighbours of equal class merged, a span covering the blanks inside it."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for places, f, cls in self._classes(b.column(1)):
                    row = f["row"]
                    cut = np.flatnonzero(np.concatenate(([True], (cls[1:] != cls[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)
                    stop = np.concatenate((cut[1:], [len(row)])) - 1 if len(row) else cut
                    for i, j in zip(cut.tolist(), stop.tolist(), strict=True):
                        out[places[row[i]]].append({"type": CLASSES[cls[i]], "start": int(f["start"][i]), "end": int(f["end"][j])})
                kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[id_col, "spans"])

        src = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")))
        return src.mapInArrow(work, f"`{id_col}` {src.schema[0].dataType.simpleString()}, spans {SPAN}")


def parse(spark: SparkSession, text: str) -> list[dict]:
    """Spans of one text, by the shared default model; an empty text has none."""
    if not text:
        return []
    row = Lexer().spans(spark.createDataFrame([(0, text)], "id int, text string"), "id", "text").first()
    return [s.asDict() for s in row["spans"]]
