"""Token features of whole batches of texts with array operations.

Texts arrive as Arrow string arrays.  Characters above U+007F count as the bucket 95 everywhere, so all
features follow from the array of character buckets; tokens tile it, and everything that looks like a loop
over tokens is a prefix sum, a running minimum or a segmented reduction.  Only the quote state machine walks,
and only over quotes and backslashes.  No shuffle: a document's tokens are made where its text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.functions.shingles import row_chunks, text_buffers
from codegrain.schemas import LAYOUTS

WORD, SPACE, NEWLINE, SYMBOL = range(4)

#: Character pairs that begin, end or join constructs, and their numbers.
TRANSITIONS = {"//": 1, "/*": 2, "*/": 3, "--": 4, "=>": 5, "::": 6, "</": 7, "{{": 8, "${": 9, "}}": 10, "->": 11, "??": 12, "?.": 13, "<>": 14}
#: Fixed value: symbols that may begin a line, numbered from 1.
LINE_FIRST = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
#: Seeds and multipliers of the two word hashes.
HASHES = ((2166136261, 16777619), (2654435769, 2246822519))

_KIND = np.full(256, SYMBOL, np.uint8)
_KIND[[9, 11, 12, 32]] = SPACE
_KIND[[10, 13]] = NEWLINE
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = WORD
_KIND[95] = WORD
_KIND[128:] = WORD
_FLAG = np.zeros(256, np.uint8)
_FLAG[97:123], _FLAG[65:91], _FLAG[48:58] = 1, 2, 4
_FLAG[95], _FLAG[9], _FLAG[92] = 8, 32, 64
_TRANS = np.zeros((128, 128), np.int64)
for _pair, _n in TRANSITIONS.items():
    _TRANS[ord(_pair[0]), ord(_pair[1])] = _n
_LINE_FIRST = np.zeros(128, np.int64)
for _i, _c in enumerate(LINE_FIRST):
    _LINE_FIRST[ord(_c)] = _i + 1


class Tokens:
    """Raw tokens of a batch: parallel arrays, ``row`` being the text each belongs to."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        lead = (raw & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(lead)))
        self.b = np.where(raw[lead] > 127, 95, raw[lead]).astype(np.uint8)
        self.bounds = before[offsets]  # of the texts, in characters
        self.wide = raw[lead] > 127
        b, n = self.b, len(self.b)
        kind = _KIND[b]
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == WORD) | (kind[1:] == SPACE)) | ((b[1:] == 10) & (b[:-1] == 13))
        inner = self.bounds[(self.bounds > 0) & (self.bounds < n)]
        same[inner] = False
        self.start = np.flatnonzero(~same)
        self.end = np.concatenate((self.start[1:], [n])) if n else self.start
        self.kind = kind[self.start].astype(np.int64)
        self.row = np.searchsorted(self.bounds, self.start, "right") - 1
        self.first = b[self.start].astype(np.int64)
        self.last = b[self.end - 1].astype(np.int64) if n else self.first
        self.length = self.end - self.start
        # tokens of each text, and the lines of all texts numbered through
        self.at = np.searchsorted(self.row, np.arange(len(offsets)))
        t = len(self.start)
        begins = np.zeros(t, bool)
        begins[self.at[:-1][self.at[:-1] < self.at[1:]]] = True
        self.text_begins = begins
        after_newline = np.zeros(t, bool)
        after_newline[1:] = self.kind[:-1] == NEWLINE
        self.line_begins = begins | after_newline
        self.line = np.cumsum(self.line_begins) - 1
        solid = ((self.kind == WORD) | (self.kind == SYMBOL)).astype(np.int64)
        before_solid = np.cumsum(solid) - solid
        base = np.maximum.accumulate(np.where(self.line_begins, before_solid, 0)) if t else before_solid
        self.solid, self.line_pos = solid.astype(bool), before_solid - base
        self.line_start = self.line_pos == 0
        tabs = np.add.reduceat((b == 9).astype(np.int64), self.start) if n else self.length
        self.tabs = np.where(self.kind == SPACE, tabs, 0)

    def flags(self) -> np.ndarray:
        out = np.bitwise_or.reduceat(_FLAG[self.b], self.start).astype(np.int64) if len(self.b) else self.kind
        out = out | np.where(self.line_start, 16, 0)
        return out | np.where((self.kind == WORD) & ((out & 2) > 0) & ((out & 1) == 0), 128, 0)

    def len_bucket(self) -> np.ndarray:
        return np.minimum(7, np.floor(np.log2(np.maximum(self.length, 1)))).astype(np.int64)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Finalised 32-bit hashes of the words, 0 elsewhere."""
        words = np.flatnonzero(self.kind == WORD)
        order = words[np.argsort(-self.length[words], kind="stable")]
        length, start = self.length[order], self.start[order]
        out = []
        for seed, mult in HASHES:
            h = np.full(len(order), seed, np.uint64)
            m, k = len(order), 0
            while m:
                h[:m] = ((h[:m] ^ self.b[start[:m] + k]) * np.uint64(mult)) & np.uint64(0xFFFFFFFF)
                k += 1
                m = int(np.searchsorted(-length, -k, "left"))  # words longer than k
            full = np.zeros(len(self.kind), np.int64)
            full[order] = (h ^ (h >> np.uint64(16))).astype(np.int64)
            out.append(full)
        return out[0], out[1]

    def quotes(self) -> np.ndarray:
        """Quote state before each token: 0 none, 1 ', 2 ", 3 `."""
        heavy = self.kind != SPACE
        place = np.cumsum(heavy) - 1  # number among the tokens that are not blanks
        some = np.flatnonzero((self.kind == SYMBOL) & np.isin(self.first, (39, 34, 96, 92)))
        after = np.zeros(len(some), np.int64)
        state, escaped, was, text = 0, False, -2, -1
        for i, (at, c, row) in enumerate(zip(place[some].tolist(), self.first[some].tolist(), self.row[some].tolist(), strict=True)):
            if row != text:
                state, escaped, was, text = 0, False, -2, row
            hit = escaped and at == was + 1
            if c == 92:
                escaped = not hit
            else:
                if not hit:
                    mine = 1 if c == 39 else 2 if c == 34 else 3
                    state = 0 if state == mine else mine if state == 0 else state
                escaped = False
            was = at
            after[i] = state
        seen = np.searchsorted(some, np.arange(len(self.kind)), "left") - 1
        ok = seen >= 0
        out = np.zeros(len(self.kind), np.int64)
        if len(some):
            out[ok] = np.where(self.row[some[seen[ok]]] == self.row[ok], after[seen[ok]], 0)
        return out


def _pairs(kind: np.ndarray, first: np.ndarray, last: np.ndarray, begins: np.ndarray, joined: np.ndarray) -> dict[str, np.ndarray]:
    """Transition and symbol-pair ids of neighbours; ``joined``: the pair touches physically."""
    n = len(kind)
    trans, sym = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n > 1:
        a, b = last[:-1], first[1:]
        ok = ~begins[1:]
        trans[1:] = np.where(ok & joined[1:], _TRANS[a, b], 0)
        value = 1 + ((((a + 1) * 131) & 0xFFFFFFFF) ^ b) % 31
        sym[1:] = np.where(ok & ((kind[:-1] == SYMBOL) | (kind[1:] == SYMBOL)), value, 0)
    nxt = lambda x: np.concatenate((x[1:], [0]))[:n]
    return {"trans_prev": trans, "trans_next": nxt(trans), "sym_prev": sym, "sym_next": nxt(sym)}


def _depth(step: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A counter per text that a closer never takes below 0, after each token."""
    if not len(step):
        return step
    total = np.cumsum(step)
    first = np.concatenate(([True], row[1:] != row[:-1]))
    base = np.where(first, total - step, 0)
    total = total - base[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
    drop = np.int64(2 * len(step) + 2)
    low = np.minimum.accumulate(total - row * drop) + row * drop
    return total - np.minimum(0, low)


def _indent(width: np.ndarray) -> np.ndarray:
    return np.select([width <= 2, width <= 4, width <= 16], [width, 3, 4 + (width - 5) // 4], 7)


def features(offsets: np.ndarray, raw: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """All fields of a layout, with ``row, start, end``; one entry per token."""
    lay = LAYOUTS[name]
    t = Tokens(offsets, raw)
    h1, h2 = t.word_hashes()
    flags = t.flags()
    lead = (t.kind == SPACE) & t.line_start
    lines = int(t.line[-1]) + 1 if len(t.line) else 0
    width = np.bincount(t.line[lead], weights=(t.length + 3 * t.tabs)[lead], minlength=lines).astype(np.int64)
    quote = t.quotes() if lay.large else None
    out = {"row": t.row, "start": t.start - t.bounds[t.row] if len(t.row) else t.start, "end": t.end - t.bounds[t.row] if len(t.row) else t.end}
    out |= {"kind": t.kind, "len_bucket": t.len_bucket(), "first_char": t.first, "last_char": t.last}
    out |= {"hash1": h1 & (lay.fields["hash1"] - 1), "hash2": h2 & (lay.fields["hash2"] - 1), "flags": flags}
    symbol = t.kind == SYMBOL
    if lay.large:
        shut = quote > 0
        for field, opener, closer in (("paren_depth", 40, 41), ("brace_depth", 123, 125), ("bracket_depth", 91, 93)):
            step = np.where(symbol & ~shut, (t.first == opener).astype(np.int64) - (t.first == closer), 0)
            after = _depth(step, t.row)
            before = np.concatenate(([0], after[:-1])) if len(after) else after
            out[field] = np.minimum(np.where(t.text_begins, 0, before), 7)
        out["line_pos"] = np.minimum(t.line_pos, 7)
        out["quote_state"] = quote
    if not lay.drop_blanks:
        out |= _pairs(t.kind, t.first, t.last, t.text_begins, np.ones(len(t.kind), bool))
        if lay.large:
            own = np.where(lead, 0, width[t.line]) if lines else t.kind
            out["indent_bucket"] = np.minimum(np.ceil(np.log2(own + 1)).astype(np.int64), 7)
        return out
    keep = np.flatnonzero(t.solid)
    line = t.line[keep]
    if lines:
        tab_lines = np.bincount(t.line[lead], weights=t.tabs[lead], minlength=lines) > 0
        out["flags"] = flags | np.where(t.solid & tab_lines[t.line], 32, 0)
    out = {f: v[keep] for f, v in out.items()}
    row = out["row"]
    begins = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    newline, space = np.cumsum(t.kind == NEWLINE), np.cumsum(t.kind == SPACE)
    head = t.at[row] if len(row) else keep  # first raw token of the text
    at_head = lambda c: np.where(head > 0, c[np.maximum(head - 1, 0)], 0)
    prior = np.concatenate(([0], keep[:-1])) if len(keep) else keep
    nl = newline[keep] - np.where(begins, at_head(newline) - 1, newline[prior])
    sp = space[keep] - np.where(begins, at_head(space), space[prior])
    gap = np.where(nl >= 2, 3, np.where(nl == 1, 2, np.where(sp > 0, 1, 0)))
    out["gap_prev"] = gap
    nxt = np.concatenate((gap[1:], [2]))[: len(gap)]
    ends = np.concatenate((begins[1:], [True]))[: len(gap)]
    out["gap_next"] = np.where(ends, 2, nxt)
    out["indent"] = _indent(width[line]) if lines else line
    opens = t.line_start[keep]
    mark = np.zeros(max(lines, 1), np.int64)
    mark[line[opens]] = np.where(out["kind"][opens] == WORD, 0, _LINE_FIRST[out["first_char"][opens]])
    out["line_first"] = mark[line]
    if not lay.large:
        own = out["kind"] == SYMBOL
        c = out["first_char"]
        for field, openers, closers in (("brace_depth", (123,), (125,)), ("paren_depth", (40, 91), (41, 93))):
            step = np.where(own, np.isin(c, openers).astype(np.int64) - np.isin(c, closers), 0)
            out[field] = np.minimum(_depth(step, row) - (step > 0), 3)
    out |= _pairs(out["kind"], out["first_char"], out["last_char"], begins, gap == 0)
    return out


def pack(f: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    """The packed 32-bit words of each token, as 64-bit integers."""
    large = LAYOUTS[name].large
    w0 = f["kind"] | f["len_bucket"] << 2 | f["first_char"] << 5 | f["last_char"] << 12 | f["flags"] << 19 | f["sym_next"] << 27
    shift = (18, 22, 26) if large else (17, 21, 25)
    w1 = f["hash1"] | f["hash2"] << 10 | f["trans_prev"] << shift[0] | f["trans_next"] << shift[1] | f["sym_prev"] << shift[2]
    out = {"w0": w0 & 0xFFFFFFFF, "w1": w1 & 0xFFFFFFFF}
    if name == "compact_v2":
        at = {"gap_prev": 0, "gap_next": 2, "indent": 4, "line_first": 7, "brace_depth": 12, "paren_depth": 14}
    elif name == "large_v1":
        at = {"paren_depth": 0, "brace_depth": 3, "bracket_depth": 6, "line_pos": 9, "indent_bucket": 12, "quote_state": 15}
    elif name == "large_v2":
        at = {"gap_prev": 0, "gap_next": 2, "indent": 4, "line_first": 7, "brace_depth": 12, "paren_depth": 15, "bracket_depth": 18, "line_pos": 21, "quote_state": 24}
    else:
        return out
    w2 = np.zeros(len(w0), np.int64)
    for field, bit in at.items():
        w2 = w2 | f[field] << bit
    return out | {"w2": w2}


def group_sums(row: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows, keys and sums of the groups of ``row`` and ``keys``: first the number of members, then each of ``values``."""
    code, spans = row.astype(np.int64), []
    for k in keys:
        low = int(k.min(initial=0))
        spans.append((low, int(k.max(initial=0)) - low + 1))
        code = code * spans[-1][1] + (k - low)
    top = int(code.max(initial=0)) + 1
    if top <= 4 * len(code) + (1 << 16):
        n = np.bincount(code, minlength=top)
        found = np.flatnonzero(n)
        sums = [n[found], *[np.bincount(code, weights=v, minlength=top)[found].astype(np.int64) for v in values]]
    else:
        found, at, n = np.unique(code, return_inverse=True, return_counts=True)
        sums = [n, *[np.bincount(at, weights=v, minlength=len(found)).astype(np.int64) for v in values]]
    out = []
    for low, span in reversed(spans):
        out.append(found % span + low)
        found = found // span
    return found, out[::-1], sums


def summed_rows(df: DataFrame, text_col: str, names: list[str], work_on, *carry: str, also: tuple[str, ...] = ()) -> DataFrame:  # noqa: ANN001
    """Small rows of whole texts: the carried columns and the long columns ``names``.

    ``work_on(offsets, raw, *also)`` gets the texts of a chunk (and the values of the columns ``also``) and returns the
    place of each of its rows in the chunk and its columns.  Nothing but these rows leaves the task that reads a text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            offsets, raw = text_buffers(column("text"))
            extra = [column(f"also_{i}").to_pylist() for i in range(len(also))]
            for lo, hi in row_chunks(offsets):
                at, values = work_on(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], *[x[lo:hi] for x in extra])
                take = pa.array(lo + at)
                cols = [column(f"carry_{i}").take(take) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, pa.int64()) for v in values]], names=[*carry, *names])

    src = df.select(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], *[F.col(c).alias(f"also_{i}") for i, c in enumerate(also)], F.col(text_col).alias("text"))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry]
    return src.mapInArrow(work, ", ".join([*kinds, *[f"`{n}` long" for n in names]]))


def feature_counts(df: DataFrame, text_col: str, name: str, fields: list[str], *carry: str) -> DataFrame:
    """Tokens of each text per combination of fields: the carried columns, the fields and ``n``, counted in the batch."""

    def count(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        f = features(offsets, raw, name)
        row, keys, sums = group_sums(f["row"], [f[x] for x in fields], [])
        return row, [*keys, *sums]

    return summed_rows(df, text_col, [*fields, "n"], count, *carry)


def token_arrays(df: DataFrame, id_col: str, text_col: str, name: str, fields: list[str], *carry: str) -> DataFrame:
    """One row per text: the id, carried columns, ``n`` and an array per field, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = text_buffers(batch.column(batch.schema.get_field_index("text")))
            rest = [n for n in batch.schema.names if n != "text"]
            for lo, hi in row_chunks(offsets):
                f = features(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], name)
                bounds = np.searchsorted(f["row"], np.arange(hi - lo + 1)).astype(np.int32)
                cols = [batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in rest]
                cols += [pa.array(np.diff(bounds)), *[pa.ListArray.from_arrays(pa.array(bounds), pa.array(f[x].astype(np.int32))) for x in fields]]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "n", *fields])

    src = df.select(F.col(id_col), *carry, F.col(text_col).alias("text"))
    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in src.drop("text").schema]
    return src.mapInArrow(work, ", ".join([*kinds, "n int", *[f"`{x}` array<int>" for x in fields]]))


def token_rows(df: DataFrame, id_col: str, text_col: str, name: str, fields: list[str], *carry: str, packed: bool = False) -> DataFrame:
    """One row per token: the id, the carried columns, ``tok_ix`` and the asked fields.

    Null and empty texts have no tokens.  Rows delivered twice are not merged here.
    """
    want = list(fields) + (["w0", "w1", *(["w2"] if name != "compact_v1" else [])] if packed else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = text_buffers(batch.column(batch.schema.get_field_index("text")))
            rest = [n for n in batch.schema.names if n != "text"]
            for lo, hi in row_chunks(offsets):
                f = features(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], name)
                if packed:
                    f = f | pack(f, name)
                row = f["row"]
                first = np.searchsorted(row, row, "left")
                take = pa.array(lo + row)
                cols = [batch.column(batch.schema.get_field_index(n)).take(take) for n in rest]
                cols += [pa.array((np.arange(len(row)) - first).astype(np.int32))] + [pa.array(f[w].astype(np.int64 if w[0] == "w" and packed else np.int32)) for w in want]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "tok_ix", *want])

    src = df.select(F.col(id_col), *carry, F.col(text_col).alias("text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("text").schema]
    kinds += ["tok_ix int"] + [f"`{w}` {'long' if w[0] == 'w' and packed else 'int'}" for w in want]
    return src.mapInArrow(work, ", ".join(kinds))
