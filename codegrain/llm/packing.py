"""Problem 6: filling containers with items by variable-capacity best-fit on the histogram of sizes.

Items are told apart by their size only, so best-fit decreasing runs on the histogram: at most ``capacity``
rows reach the driver, whatever the number of items, and the plan it returns (which sizes share how many
containers) is as bounded.  Items then find their place by their rank within their size, a distributed
running count.  Several permitted capacities are optimised jointly: where no open bin has room, each capacity is
tried by filling it up with the items still to come, largest first, and the one of the least cost per token
held is opened.  What a bin costs is a parameter; by default its capacity and ``OVERHEAD`` tokens, so that a small
bin is opened only where a large one would stay emptier.  In the
end every bin is taken down to the least permitted capacity that holds its contents.

An item longer than the capacity is cut into full pieces and one rest; nothing else is split.

Defined results: null and non-positive sizes get no place; equal sizes are ordered by a hash of the id,
then the id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.durable import durable
from codegrain.operators.ordered import running_sum


@dataclass
class Bins:
    """``n`` alike bins: each holds ``k`` items of ``size`` for every (size, k, first rank)."""

    n: int
    capacity: int
    room: int
    contents: list[tuple[int, int, int]] = field(default_factory=list)


OVERHEAD = 16  # what a bin costs beside its capacity, in tokens


def fill(room: int, most: int, left: np.ndarray) -> int:
    """What stays of ``room`` after taking items of at most ``most``, largest first, from ``left`` (items per size)."""
    size = min(most, room)
    while size > 0:
        has = np.flatnonzero(left[: size + 1])
        if not len(has) or has[-1] == 0:
            break
        size = int(has[-1])
        room -= size * min(int(left[size]), room // size)
        size = min(size - 1, room)
    return room


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...], costs: dict[int, float] | None = None) -> list[Bins]:
    """Best-fit decreasing over ``histogram`` {size: items}, all sizes from 1 to the largest capacity."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    costs = costs or {c: c + OVERHEAD for c in capacities}
    by_room: list[list[Bins]] = [[] for _ in range(top + 1)]
    has = np.zeros(top + 1, bool)
    waiting = np.zeros(top + 1, np.int64)  # items still to come, by size
    for s, n in histogram.items():
        waiting[s] = n
    done: list[Bins] = []

    def put(b: Bins) -> None:
        if b.room == 0:
            done.append(b)
        else:
            by_room[b.room].append(b)
            has[b.room] = True

    for s in sorted(histogram, reverse=True):
        left, rank = histogram[s], 0
        waiting[s] = 0
        while left:
            ahead = has[s:]
            at = int(ahead.argmax()) if len(ahead) else 0
            if len(ahead) and ahead[at]:
                room = s + at
                b = by_room[room].pop()
                has[room] = bool(by_room[room])
            else:
                # cost of each token that a bin of capacity c holds in the end if its first item is s
                unused = {c: fill(c - s * min(left, c // s), s - 1, waiting) for c in capacities if c >= s}
                c = min(unused, key=lambda c: (costs[c] / (c - unused[c]), -c))
                b = Bins(-(-left // (c // s)), c, c)
            k = min(b.room // s, left)
            full = min(b.n, left // k)
            if full < b.n and b.contents:
                put(Bins(b.n - full, b.capacity, b.room, [(s2, k2, r2 + full * k2) for s2, k2, r2 in b.contents]))
            put(Bins(full, b.capacity, b.room - k * s, [*b.contents, (s, k, rank)]))
            rank += full * k
            left -= full * k
    for room in range(1, top + 1):
        done += by_room[room]
    for b in done:
        used = b.capacity - b.room
        best = next(c for c in capacities if c >= used)
        b.capacity, b.room = best, best - used
    return done


def pack(items: DataFrame, id_col: str, size_col: str, capacities: tuple[int, ...], costs: dict[int, float] | None = None) -> DataFrame:
    """One row per item or piece: ``doc, piece_ix, tok_from, tok_to, container, place, capacity``.

    ``costs`` is what a bin of each capacity costs.

    ``place`` is the offset in the container.  Containers are numbered from 0: first those of the plan,
    then those filled by one piece alone.
    """
    top = max(capacities)
    src = items.select(F.col(id_col).alias("doc"), F.col(size_col).cast("long").alias("n")).where("doc is not null and n > 0")
    src = durable(src.withColumn("h", F.xxhash64("doc")), "pack-items")
    part = src.select("doc", "h", (F.col("n") % top).cast("int").alias("size"), (F.col("n") - F.col("n") % top).alias("tok_from")).where("size > 0")
    histogram = {r["size"]: r["count"] for r in part.groupBy("size").count().collect()}
    bins = plan_bins(histogram, capacities, costs)
    first, rows = 0, []
    for b in bins:
        place = 0
        for s, k, rank in b.contents:
            rows.append((s, rank, first, k, place, b.capacity))
            place += s * k
        first += b.n
    rows.sort()
    shared = src.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 6))
    ranked = running_sum(part.withColumn("one", F.lit(1)), ["size"], "h", ["doc"], {"rank": "one"})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            size, rank = b.column("size").to_numpy().astype(np.int64), b.column("rank").to_numpy().astype(np.int64)
            row = plan[np.searchsorted(key, (size << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            start = b.column("tok_from").to_numpy()
            cols = [b.column("doc"), pa.array((start // top).astype(np.int32)), pa.array(start), pa.array(start + size), pa.array(row[:, 2] + nth // row[:, 3]), pa.array((row[:, 4] + nth % row[:, 3] * size).astype(np.int32)), pa.array(row[:, 5].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "piece_ix", "tok_from", "tok_to", "container", "place", "capacity"])

    kind = src.schema["doc"].dataType.simpleString()
    placed = ranked.select("doc", "size", "rank", "tok_from").mapInArrow(work, f"doc {kind}, piece_ix int, tok_from long, tok_to long, container long, place int, capacity int")
    long = src.where(F.col("n") >= top).withColumn("full", F.floor(F.col("n") / top)).withColumn("all", F.lit(0))
    long = running_sum(long, ["all"], "h", ["doc"], {"before": "full"})
    long = long.select("doc", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
    alone = long.select("doc", F.col("i").cast("int").alias("piece_ix"), (F.col("i") * top).alias("tok_from"), ((F.col("i") + 1) * top).alias("tok_to"), (F.lit(first) + F.col("before") + F.col("i")).alias("container"), F.lit(0).alias("place"), F.lit(top).alias("capacity"))
    return placed.union(alone)
