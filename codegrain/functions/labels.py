"""Labels of tokens and characters: run-length codes, rule classes, alignment.

Array code that runs where the text is read; column forms for what the JVM does well.  Class 9 stands for
"masked" in run-length codes only; everywhere else a masked label is null (-1 inside array code).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.featurize import SPACE, SYMBOL, WORD, Tokens, features, group_sums, summed_rows
from codegrain.functions.lexing import CLASSES, NUMERIC, SCREAMING
from codegrain.functions.shingles import row_chunks, text_buffers

_NUMERIC, _SCREAMING = re.compile(NUMERIC), re.compile(SCREAMING)
_RUN = re.compile(r"([0-9]):([0-9]+)")
#: Letters of the older run-length code.
LETTERS = {"i": "identifier", "k": "keyword", "s": "string", "c": "class", "p": "property", "e": "entity", "j": "jsxliterals", "g": "sign", "m": "comment", "b": "break", "w": "space"}


# ------------------------------------------------------------------ column forms


def rle_runs(rle: Column) -> Column:
    """Array of (cls, n) of a run-length code; whatever stands between the runs is ignored."""
    cls = F.regexp_extract_all(rle, F.lit(r"([0-9]):([0-9]+)"), F.lit(1))
    n = F.regexp_extract_all(rle, F.lit(r"([0-9]):([0-9]+)"), F.lit(2))
    return F.zip_with(cls, n, lambda c, k: F.struct(c.cast("int").alias("cls"), k.cast("long").alias("n")))


def rle_length(rle: Column) -> Column:
    """Number of characters that a run-length code covers."""
    n = F.regexp_extract_all(rle, F.lit(r"([0-9]):([0-9]+)"), F.lit(2))
    return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


# ------------------------------------------------------------------ array forms


def decode_rle(rle: str | None, length: int) -> np.ndarray:
    """Class per character, -1 where masked or not covered."""
    out = np.full(length, -1, np.int64)
    at = 0
    for cls, n in _RUN.findall(rle or ""):
        end = at + int(n)
        if at < length:
            out[at : min(end, length)] = int(cls) if cls != "9" else -1
        at = end
    return out


def run_starts(rle: str | None) -> tuple[np.ndarray, np.ndarray]:
    """First character and class (-1 masked) of each run; the last entry is what follows the code."""
    runs = [(int(c), int(n)) for c, n in _RUN.findall(rle or "") if int(n)]
    start = np.concatenate(([0], np.cumsum([n for _, n in runs], dtype=np.int64))).astype(np.int64)
    return start, np.array([c if c != 9 else -1 for c, _ in runs] + [-1], np.int64)


def encode_rle(classes: np.ndarray, lengths: np.ndarray) -> str:
    """Run-length code of consecutive pieces, equal neighbours merged, -1 written as 9."""
    if not len(classes):
        return ""
    cut = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    total = np.add.reduceat(lengths, cut)
    return ",".join(f"{c if c >= 0 else 9}:{n}" for c, n in zip(classes[cut].tolist(), total.tolist(), strict=True))


def rule_classes(t: Tokens) -> np.ndarray:
    """Rule class of each raw token, -1 for blanks: 3 number, 7 screaming, 6 applied, 8 symbol, else 0."""
    n = len(t.kind)
    odd = np.add.reduceat(((t.b == 11) | (t.b == 12)).astype(np.int64), t.start) if n else t.kind
    paren = (t.kind == SYMBOL) & (t.first == 40)
    later = lambda x, k: np.concatenate((x[k:], np.zeros(min(k, n), x.dtype)))[:n]
    same = lambda k: later(t.row + 1, k) == t.row + 1
    applied = (later(paren, 1) & same(1)) | (later((t.kind == SPACE) & (odd == 0), 1) & later(paren, 2) & same(2))
    out = np.where(t.kind == WORD, np.where(applied, 6, 0), np.where(t.kind == SYMBOL, 8, -1))
    # a character above U+007F reads like "_" in the buckets but belongs to no number or constant
    narrow = ~np.logical_or.reduceat(t.wide, t.start) if n else t.wide
    special = np.flatnonzero((t.kind == WORD) & narrow & (((t.first >= 48) & (t.first <= 57)) | ((t.first >= 65) & (t.first <= 90) & (t.length > 1))))
    known: dict[bytes, int] = {}
    b = t.b.tobytes()
    for i, s, e in zip(special.tolist(), t.start[special].tolist(), t.end[special].tolist(), strict=True):
        w = b[s:e]
        c = known.get(w)
        if c is None:
            text = w.decode("ascii")
            c = known[w] = 3 if _NUMERIC.match(text) else 7 if _SCREAMING.match(text) else -1
        if c >= 0:
            out[i] = c
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, raw = text_buffers(batch.column(batch.schema.get_field_index("text")))
    for lo, hi in row_chunks(offsets):
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]


def _gold(offsets: np.ndarray, raw: np.ndarray) -> tuple[Tokens, np.ndarray]:
    t = Tokens(offsets, raw)
    return t, rule_classes(t)


def scored_rows(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """Raw tokens with gold (rule class) and prediction (by kind alone).

    Columns: the id, carried ones, ``tok_ix, start, len, kind, gold, pred, prev_gold, prev_pred``; gold and
    pred are -1 for blanks, ``prev_*`` those of the scored token before in the text, -1 for the first.
    """
    names = ["tok_ix", "start", "len", "kind", "gold", "pred", "prev_gold", "prev_pred"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "text"]
            for lo, _, offsets, raw in _chunks(batch):
                t, gold = _gold(offsets, raw)
                pred = np.where(gold < 0, -1, np.where(t.kind == SYMBOL, 8, 0))
                scored = np.flatnonzero(gold >= 0)
                before_g, before_p = np.full(len(gold), -1), np.full(len(gold), -1)
                if len(scored) > 1:
                    same = t.row[scored[1:]] == t.row[scored[:-1]]
                    before_g[scored[1:]] = np.where(same, gold[scored[:-1]], -1)
                    before_p[scored[1:]] = np.where(same, pred[scored[:-1]], -1)
                ix = np.arange(len(t.row)) - t.at[t.row] if len(t.row) else t.row
                vals = [ix, t.start - t.bounds[t.row] if len(t.row) else t.start, t.length, t.kind, gold, pred, before_g, before_p]
                take = pa.array(lo + t.row)
                cols = [batch.column(batch.schema.get_field_index(n)).take(take) for n in rest] + [pa.array(v.astype(np.int32)) for v in vals]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, *names])

    src = df.select(F.col(id_col), *carry, F.col(text_col).alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("text").schema] + [f"{n} int" for n in names]
    return src.mapInArrow(work, ", ".join(kinds))


def scored_counts(df: DataFrame, text_col: str, keys: list[str], *carry: str) -> DataFrame:
    """Scored tokens of each text per combination of ``keys`` (gold, pred, prev_gold, kind): carried columns, keys, ``n, chars``."""

    def count(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        t, gold = _gold(offsets, raw)
        s = np.flatnonzero(gold >= 0)
        row, g = t.row[s], gold[s]
        before = np.full(len(s), -1)
        if len(s) > 1:
            before[1:] = np.where(row[1:] == row[:-1], g[:-1], -1)
        have = {"gold": g, "pred": np.where(t.kind[s] == SYMBOL, 8, 0), "prev_gold": before, "kind": t.kind[s]}
        row, found, sums = group_sums(row, [have[k] for k in keys], [t.length[s]])
        return row, [*found, *sums]

    return summed_rows(df, text_col, [*keys, "n", "chars"], count, *carry)


def raw_counts(df: DataFrame, text_col: str, *carry: str) -> DataFrame:
    """``tokens, labelled`` (those with a rule class) of each text that has tokens."""

    def count(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        t, gold = _gold(offsets, raw)
        row, _, sums = group_sums(t.row, [], [gold >= 0])
        return row, sums

    return summed_rows(df, text_col, ["tokens", "labelled"], count, *carry)


def boundary_counts(df: DataFrame, text_col: str, *carry: str) -> DataFrame:
    """Per text: scored tokens beside a gold transition (``adjacent``), and transitions of gold and prediction (``tp, predicted, gold``), and ``scored`` tokens."""

    def count(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        t, gold = _gold(offsets, raw)
        s = np.flatnonzero(gold >= 0)
        row, g, p = t.row[s], gold[s], np.where(t.kind[s] == SYMBOL, 8, 0)
        same = row[1:] == row[:-1]
        cut, guess = np.zeros(len(s) + 1, bool), np.zeros(len(s), bool)
        cut[1:-1] = same & (g[1:] != g[:-1])
        guess[1:] = same & (p[1:] != p[:-1])
        mine = cut[:-1]
        row, _, sums = group_sums(row, [], [mine | cut[1:], mine & guess, guess, mine])
        return row, [*sums[1:], sums[0]]

    return summed_rows(df, text_col, ["adjacent", "tp", "predicted", "gold", "scored"], count, *carry)


def gold_spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, class, start and end of the merged spans of scored tokens."""
    t, gold = _gold(offsets, raw)
    s = np.flatnonzero(gold >= 0)
    row, g = t.row[s], gold[s]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1]))) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(s)])) - 1 if len(s) else first
    base = t.bounds[row[first]]
    return row[first], g[first], t.start[s[first]] - base, t.end[s[last]] - base


def span_rows(df: DataFrame, text_col: str, *carry: str) -> DataFrame:
    """``cls, start, end`` of the merged spans of each text."""

    def spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        row, *rest = gold_spans(offsets, raw)
        return row, rest

    return summed_rows(df, text_col, ["cls", "start", "end"], spans, *carry)


def piece_counts(df: DataFrame, text_col: str, *carry: str) -> DataFrame:
    """Per text: ``n_spans``, ``n_gaps`` between and around them, and the characters they cover; every text has a row."""

    def count(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(offsets) - 1
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        size = np.diff(lead[offsets])
        row, _, start, end = gold_spans(offsets, raw)
        fresh = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        before = np.where(fresh, 0, np.concatenate(([0], end[:-1]))) if len(row) else start
        stop = np.zeros(n, np.int64)
        np.maximum.at(stop, row, end)
        gaps = np.bincount(row, weights=start > before, minlength=n) + (size > stop)
        return np.arange(n), [np.bincount(row, minlength=n), gaps.astype(np.int64), np.bincount(row, weights=end - start, minlength=n).astype(np.int64)]

    return summed_rows(df, text_col, ["n_spans", "n_gaps", "covered"], count, *carry)


def _aligned(offsets: np.ndarray, raw: np.ndarray, codes: list[str | None], layout: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, first token of each text (and one past the last), label of each token (-1 for none)."""
    f = features(offsets, raw, layout)
    row = f["row"]
    first = np.searchsorted(row, np.arange(len(offsets)))
    label = np.full(len(row), -1, np.int64)
    for i, code in enumerate(codes):
        a, b = first[i], first[i + 1]
        if a < b:
            start, cls = run_starts(code)
            label[a:b] = cls[np.searchsorted(start, f["start"][a:b], "right") - 1]
    label[np.isin(f["kind"], (1, 2))] = -1
    return f, first, label


def aligned_counts(df: DataFrame, text_col: str, rle_col: str, layout: str, keys: list[str], *carry: str) -> DataFrame:
    """Tokens of each text per combination of ``keys``: carried columns, keys and ``n``, counted in the batch.

    Keys are fields of the layout, ``label`` (-1 for none) or ``chunk``, the number of the run of 512 tokens.
    """

    def count(offsets: np.ndarray, raw: np.ndarray, codes: list) -> tuple[np.ndarray, list[np.ndarray]]:
        f, first, label = _aligned(offsets, raw, codes, layout)
        f |= {"label": label, "chunk": (np.arange(len(label)) - first[f["row"]]) // 512 if len(label) else label}
        row, found, sums = group_sums(f["row"], [f[k] for k in keys], [])
        return row, [*found, *sums]

    return summed_rows(df, text_col, [*keys, "n"], count, *carry, also=(rle_col,))


def construct_counts(df: DataFrame, text_col: str, rle_col: str, window: int, *carry: str) -> DataFrame:
    """``win, complete``: complete comment and string runs of each window of ``window`` tokens with a scored token.

    Runs are counted over scored tokens, within a window; a window of fewer than three of them has none.
    """

    def count(offsets: np.ndarray, raw: np.ndarray, codes: list) -> tuple[np.ndarray, list[np.ndarray]]:
        f, first, label = _aligned(offsets, raw, codes, "compact_v2")
        s = np.flatnonzero(label >= 0)
        row, lab = f["row"][s], label[s]
        win = (s - first[row]) // window if len(s) else s
        edge = np.ones(len(s) + 1, bool)
        if len(s):
            edge[1:-1] = (row[1:] != row[:-1]) | (win[1:] != win[:-1])
        change = np.ones(len(s) + 1, bool)
        if len(s):
            change[1:-1] = edge[1:-1] | (lab[1:] != lab[:-1])
        values = [(lab == c) & x for c in (1, 2) for x in (change[:-1], change[1:])]
        row, (win,), (n, s1, e1, s2, e2) = group_sums(row, [win], values)
        return row, [win, np.where(n >= 3, np.minimum(s1, e1) + np.minimum(s2, e2), 0)]

    return summed_rows(df, text_col, ["win", "complete"], count, *carry, also=(rle_col,))


BRACKETS = (("paren", 40, 41), ("brace", 123, 125), ("bracket", 91, 93))


def depth_counts(df: DataFrame, text_col: str, rle_col: str, *carry: str) -> DataFrame:
    """Per text: tokens behind a comment or string token, and tokens at depth 1 and 2 or more of each bracket.

    Depth is a running sum cut at 0 afterwards: an unmatched closer has to be repaid.
    """
    names = ["after_comment", "after_string", *[f"{n}{k}" for n, _, _ in BRACKETS for k in (1, 2)]]

    def count(offsets: np.ndarray, raw: np.ndarray, codes: list) -> tuple[np.ndarray, list[np.ndarray]]:
        f, first, label = _aligned(offsets, raw, codes, "compact_v2")
        row = f["row"]
        before = np.full(len(row), -1)
        if len(row):
            before[1:] = np.where(row[1:] == row[:-1], label[:-1], -1)
        values = [before == 1, before == 2]
        symbol = f["kind"] == SYMBOL
        for _, o, c in BRACKETS:
            step = np.where(symbol, (f["first_char"] == o).astype(np.int64) - (f["first_char"] == c), 0)
            total = np.concatenate(([0], np.cumsum(step)))
            depth = total[1:] - total[first[row]] if len(row) else step
            values += [depth >= 1, depth >= 2]
        row, _, sums = group_sums(row, [], values)
        return row, sums[1:]

    return summed_rows(df, text_col, names, count, *carry, also=(rle_col,))


def painted(df: DataFrame, id_col: str, length_col: str, spans_col: str, fill: int, gate: bool) -> DataFrame:
    """One row per text: the id and ``rle``, the run-length code of its characters' classes.

    ``spans_col`` is an array of (start, end, type, confidence) in order: later spans overwrite, unknown types are
    skipped, ends are cut to the text, characters of no span get ``fill``; with ``gate`` spans of a confidence under
    1 are skipped too (none counts as 1).  A null length is 0, null spans are none.
    """
    known = {name: i for i, name in enumerate(CLASSES)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, spans in zip(b.column("n").to_pylist(), b.column("spans").to_pylist(), strict=True):
                line = np.full(max(n or 0, 0), fill, np.int64)
                for x in spans or []:
                    if x is None or x["type"] not in known or (gate and x["confidence"] is not None and x["confidence"] < 1):
                        continue
                    line[max(x["start"] or 0, 0) : max(x["end"] or 0, 0)] = known[x["type"]]
                out.append(encode_rle(line, np.ones(len(line), np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "rle"])

    src = df.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("n"), F.col(spans_col).cast("array<struct<start:long,end:long,type:string,confidence:double>>").alias("spans"))
    return src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, rle string").withColumnRenamed("id", id_col)


def gold_rle(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """One row per text: the id, carried columns and ``rle``, the run-length code of its rule classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "text"]
            out: list[str] = []
            for lo, hi, offsets, raw in _chunks(batch):
                t, gold = _gold(offsets, raw)
                out += [encode_rle(gold[a:b], t.length[a:b]) for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in rest], pa.array(out, pa.string())], names=[*rest, "rle"])

    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), *carry, F.col(text_col).alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("text").schema]
    return src.mapInArrow(work, ", ".join([*kinds, "rle string"]))


def aligned_rows(df: DataFrame, id_col: str, text_col: str, rle_col: str, layout: str, fields: list[str], *carry: str) -> DataFrame:
    """Tokens of a layout labelled from the run-length code beside the text.

    A token's label is the class of its first character; blanks, masked and uncovered places give null.
    Columns: the id, carried ones, ``tok_ix, label`` and the asked fields.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n not in ("text", "rle")]
            codes = batch.column(batch.schema.get_field_index("rle")).to_pylist()
            for lo, hi, offsets, raw in _chunks(batch):
                f, first, label = _aligned(offsets, raw, codes[lo:hi], layout)
                row = f["row"]
                take = pa.array(lo + row)
                ix = np.arange(len(row)) - first[row] if len(row) else row
                cols = [batch.column(batch.schema.get_field_index(n)).take(take) for n in rest]
                cols += [pa.array(ix.astype(np.int32)), pa.array(label.astype(np.int32), mask=label < 0), *[pa.array(f[x].astype(np.int32)) for x in fields]]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "tok_ix", "label", *fields])

    src = df.select(F.col(id_col), *carry, F.col(text_col).alias("text"), F.col(rle_col).alias("rle"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("text", "rle").schema]
    return src.mapInArrow(work, ", ".join([*kinds, "tok_ix int", "label int", *[f"`{x}` int" for x in fields]]))
