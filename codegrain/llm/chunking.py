"""Problem 2: cutting oversized token streams at natural boundaries by agglomerative merging.

An item starts as atomic segments (its lines; a line longer than a piece can be is cut hard).  Adjacent
pairs wait in a heap, weakest boundary first (inside a line, then a line end, then a block end), smaller
result first among equals, and are merged while the merged size plus the overlap (what there is to repeat of it:
a piece that starts at token 3 repeats 3) stays in the limit.  Two
neighbours merge only if the right one ends at a boundary at least as strong as the one given up, so every
piece ends at a block end if one is in reach, else at a line end if one is in reach, else anywhere.

Defined results: null entries of ``offsets`` are ignored, its order and repetitions do not matter and it
may count from anywhere; positions of the pieces count from the item's least offset.  Items with no tokens
(null, empty or one-valued offsets) give no piece.  A null or non-positive limit means no limit.  A null or
negative overlap is 0, one of the limit or more is cut to the limit less 1.  Block starts outside the item
are ignored.  Of rows of one id the latest delivered counts.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT, LINE, BLOCK = 0, 1, 2
KINDS = ("cut", "line", "block", "end")

SCHEMA = "id long, piece_ix int, tok_from long, own_from long, tok_to long, ends_at string"


def segments(offsets: np.ndarray, blocks: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments of an item that starts at 0, and the strength of each end."""
    ends: list[int] = []
    strength: list[int] = []
    at = 0
    is_block = np.isin(offsets, blocks)
    # a piece near the item's start has less to repeat and so holds lines that no later piece could: if one of
    # them stands before the last block end in reach of the first, what comes before that end is one segment
    near = np.flatnonzero(is_block & (offsets > 0) & (offsets <= limit))
    if len(near) and np.any(np.diff(offsets[: near[-1] + 1]) > limit - np.minimum(overlap, offsets[: near[-1]])):
        at = int(offsets[near[-1]])
        ends.append(at)
        strength.append(BLOCK)
        offsets, is_block = offsets[near[-1] :], is_block[near[-1] :]
    for end, block in zip(offsets[1:].tolist(), is_block[1:].tolist(), strict=True):
        while end - at > (room := limit - min(overlap, at)):
            at += room
            ends.append(at)
            strength.append(CUT)
        ends.append(end)
        strength.append(BLOCK if block else LINE)
        at = end
    strength[-1] = BLOCK + 1
    return ends, strength


def merge(ends: list[int], strength: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ends and their strengths of the pieces that agglomerative merging leaves."""
    n = len(ends)
    left = list(range(-1, n - 1))
    right = [*range(1, n), -1]
    start = [0, *ends[:-1]]
    version = [0] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        # the boundary at the end of segment i
        j = right[i]
        if j < 0:
            return
        version[i] += 1
        whole = ends[j] - start[i]
        if strength[j] >= strength[i] and whole + min(overlap, start[i]) <= limit:
            heapq.heappush(heap, (strength[i], whole, i, version[i]))

    for i in range(n):
        offer(i)
    while heap:
        _, _, i, v = heapq.heappop(heap)
        if version[i] != v or right[i] < 0:
            continue
        j = right[i]
        # segment i takes over j; i keeps its place and gets j's end
        ends[i], strength[i], right[i] = ends[j], strength[j], right[j]
        if right[j] >= 0:
            left[right[j]] = i
        version[j] += 1
        right[j] = -1
        version[i] += 1
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i >= 0:
        out.append((ends[i], strength[i]))
        i = right[i]
    return out


def pieces(offsets: np.ndarray, blocks: np.ndarray, limit: int | None, overlap: int | None) -> list[tuple[int, int, int, str]]:
    """``(tok_from, own_from, tok_to, ends_at)`` of each piece of one item."""
    offsets = np.unique(offsets)
    if len(offsets) < 2:
        return []
    blocks = blocks - offsets[0]
    offsets = offsets - offsets[0]
    blocks = np.unique(blocks[(blocks > 0) & (blocks < offsets[-1])])
    offsets = np.union1d(offsets, blocks)
    total = int(offsets[-1])
    if limit is None or limit <= 0 or total <= limit:
        return [(0, 0, total, KINDS[-1])]
    overlap = min(max(overlap or 0, 0), limit - 1)
    out, before, own = [], 0, 0
    for end, kind in merge(*segments(offsets, blocks, limit, overlap), limit, overlap):
        before = max(before, own - overlap)
        out.append((before, own, end, KINDS[kind]))
        own = end
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (no nulls) and bounds per row of a list column; null lists are empty."""
    column = column.cast(pa.large_list(pa.int64()))
    flat = column.flatten()
    parent = column.value_parent_indices() if hasattr(column, "value_parent_indices") else pa.compute.list_parent_indices(column)
    ok = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.filter(flat.is_valid()).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.asarray(parent.to_numpy(zero_copy_only=False))[ok]
    return values, np.searchsorted(rows, np.arange(len(column) + 1))


def split_items(
    df: DataFrame, id_col: str, offsets_col: str, limit_col: str, overlap_col: str | None = None, blocks_col: str | None = None, version_col: str | None = None
) -> DataFrame:
    """One row per piece: ``id, piece_ix, tok_from, own_from, tok_to, ends_at``.

    ``tok_from`` .. ``tok_to`` is what the piece holds, ``own_from`` where its own tokens begin after the
    overlap.  Items are independent, so the only shuffle is the one that keeps one row per id.
    """
    import pyarrow.compute  # noqa: F401  (pa.compute)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, at = _lists(b.column("offsets"))
            blk, bt = _lists(b.column("blocks"))
            ids, limits, overlaps = (b.column(c).to_pylist() for c in ("id", "seq_limit", "seq_overlap"))
            rows: list[tuple] = []
            for i, key in enumerate(ids):
                rows += [(key, n, *p) for n, p in enumerate(pieces(off[at[i] : at[i + 1]], blk[bt[i] : bt[i + 1]], limits[i], overlaps[i]))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "piece_ix", "tok_from", "own_from", "tok_to", "ends_at"])

    none = F.lit(None)
    src = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(offsets_col).cast("array<long>").alias("offsets"),
        (F.col(blocks_col) if blocks_col else none).cast("array<long>").alias("blocks"),
        F.col(limit_col).cast("long").alias("seq_limit"),
        (F.col(overlap_col) if overlap_col else none).cast("long").alias("seq_overlap"),
        (F.col(version_col).cast("timestamp") if version_col else none.cast("timestamp")).alias("version"),
    ).where("id is not null")
    whole = ["offsets", "blocks", "seq_limit", "seq_overlap"]
    latest = src.groupBy("id").agg(F.max_by(F.struct(*whole), F.struct(F.col("version").isNotNull(), "version", F.xxhash64(*whole))).alias("x"))
    return latest.select("id", *[f"x.{c}" for c in whole]).mapInArrow(work, SCHEMA)
