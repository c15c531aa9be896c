"""Problem 7: mixing sources to target shares along a curriculum.

Every source has a weight schedule over the training time t in [0, 1], given by knots between which it is linear;
scaled to integrate to 1 it says when the source's share is taken, not how large it is.  The default is a
curriculum in which sources of longer documents come later: ``1 + slope * (2t - 1)``, the slopes centred so that
all sources' weights sum to 1 at every t.  The integral of a source's weight is its token demand up to t.  A
source's documents stand in hash order, pass after pass; the middle token of each occurrence is looked up in the
inverted integral, which gives its training position, and occurrences whose tokens lie beyond the demand have
none.  Range-sorting by position yields the training order, and counting a document's positions how often it is
taken.

The total is the largest at which every stocked source with a positive share can give its share within its
repeat limits, or the total asked for; then sources that run short give all they may and are reported so.

Defined results: sources are read without regard to case and outer blanks; documents of no target source
(or with no source, no text or no tokens) are taken 0 times; a null or negative share is 0, a null repeat
limit 1; shares are scaled to sum to 1; ids count once.  What the driver gets is one row per target source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.operators.durable import durable
from codegrain.operators.ordered import running_sum


@dataclass(frozen=True)
class Mixture:
    """``docs (doc, source, n_tokens, times)``, ``shares`` per source, ``order (position, doc, pass_ix, source)``."""

    docs: DataFrame
    shares: DataFrame
    order: DataFrame


def source_key(col: str):
    return F.lower(F.trim(F.col(col)))


def slopes(shares: dict[str, float], mean_size: dict[str, float]) -> dict[str, float]:
    """Schedule slopes: sources of longer documents come later; the share-weighted mean is 0."""
    ranked = sorted(shares, key=lambda s: (mean_size.get(s, 0.0), s))
    raw = {s: (i + 0.5) / len(ranked) - 0.5 for i, s in enumerate(ranked)}
    mean = sum(shares[s] * raw[s] for s in ranked)
    return {s: raw[s] - mean for s in ranked}


Schedule = list[tuple[float, float]]


def integrated(knots: Schedule) -> list[tuple[float, float, float, float]]:
    """``(t, integral up to t, weight at t, slope from t on)`` of each piece of a schedule, scaled to integrate to 1.

    Times are brought into [0, 1] and the first and last weights reach to its ends; negative weights are 0, and a
    schedule without weight is an even one.
    """
    # knots of one time stay in their order: the weight jumps there
    points = sorted(((min(max(float(t), 0.0), 1.0), max(float(w), 0.0)) for t, w in knots), key=lambda p: p[0]) or [(0.0, 1.0)]
    points = [(0.0, points[0][1]), *[p for p in points if 0 < p[0] < 1], (1.0, points[-1][1])]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    if area <= 0:
        points, area = [(0.0, 1.0), (1.0, 1.0)], 1.0
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        if t1 > t0:
            out.append((t0, before, w0 / area, (w1 - w0) / area / (t1 - t0)))
            before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position_of(x: Column, pieces: Column) -> Column:
    """The time at which the integral of a schedule (an array of :func:`integrated` pieces) reaches ``x``."""
    piece = F.element_at(F.filter(pieces, lambda p: (p["before"] <= x) | (p["t"] == 0)), -1)
    over, w, a = F.greatest(x - piece["before"], F.lit(0.0)), piece["weight"], piece["slope"]
    # the stable form of the root, which also holds for a slope of 0
    root = F.sqrt(F.greatest(w * w + 2 * a * over, F.lit(0.0)))
    return F.least(F.lit(1.0), piece["t"] + F.when(over <= 0, 0.0).otherwise(2 * over / (w + root)))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedules: dict[str, Schedule] | None = None) -> Mixture:
    """Mix ``docs (doc, source, n_tokens)`` to ``targets (source, target_share, max_repeats)``.

    ``schedules`` has the knots (time, weight) of sources that do not follow the default curriculum.
    """
    spark = docs.sparkSession
    want: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_key("source").alias("s"), "target_share", "max_repeats").where("s is not null").orderBy("s", F.desc("target_share")).collect():
        want.setdefault(r["s"], (max(r["target_share"] or 0.0, 0.0), 1 if r["max_repeats"] is None else max(r["max_repeats"], 0)))
    scale = sum(p for p, _ in want.values()) or 1.0
    share = {s: p / scale for s, (p, _) in want.items()}
    kind = docs.schema["doc"].dataType.simpleString()
    base = docs.select("doc", source_key("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    base = durable(base.withColumn("h", F.xxhash64("doc")), "mix-documents")
    used = base.where(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
    stock = {r["source"]: (r["t"], r["c"]) for r in used.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).collect()}
    most = {s: stock.get(s, (0, 0))[0] * want[s][1] for s in want}
    # a source without a token can give nothing at any total: the others keep their proportions
    stocked = sum(share[s] for s in want if most[s] > 0) or 1.0
    part = {s: share[s] / stocked if most[s] > 0 else 0.0 for s in want}
    if total_tokens is None:
        total_tokens = int(min((most[s] / part[s] for s in want if part[s] > 0), default=0.0))
    demand = {s: min(int(part[s] * total_tokens), most[s]) for s in want}
    slope = slopes(share, {s: t / c for s, (t, c) in stock.items()})
    given = {s.strip().lower(): k for s, k in (schedules or {}).items()}
    pieces = {s: integrated(given.get(s, [(0.0, 1 - slope[s]), (1.0, 1 + slope[s])])) for s in stock}
    rows = [(s, stock[s][0], demand[s] // stock[s][0], demand[s] % stock[s][0], demand[s], pieces[s]) for s in stock]
    plan = spark.createDataFrame(rows, "source string, stock long, passes long, rest long, demand long, pieces array<struct<t:double,before:double,weight:double,slope:double>>")
    before = running_sum(used, ["source"], "h", ["doc"], {"before": "n_tokens"})
    placed = before.join(F.broadcast(plan), "source")
    # the last, partial pass takes the documents that lie whole before the cut, and then the one document
    # that comes nearest to what is still missing
    partial = F.col("before") + F.col("n_tokens") <= F.col("rest")
    placed = durable(placed.withColumn("inside", partial), "mix-placed")
    got = placed.groupBy("source").agg(F.first("rest").alias("rest"), F.sum(F.when(F.col("inside"), F.col("n_tokens")).otherwise(0)).alias("got")).collect()
    gap = spark.createDataFrame([(r["source"], r["rest"] - r["got"]) for r in got], "source string, gap long")
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    near = placed.where("NOT inside").join(F.broadcast(gap), "source").where(off < F.col("gap"))
    near = {r["source"]: r["doc"] for r in near.groupBy("source").agg(F.min_by("doc", F.struct(off, "h", "doc")).alias("doc")).collect()}
    last = spark.createDataFrame(list(near.items()), f"source string, last {kind}")
    placed = placed.join(F.broadcast(last), "source", "left")
    # the occurrences that have a position
    turns = placed.withColumn("pass_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    begins = F.col("pass_ix") * F.col("stock") + F.col("before")
    closing = F.coalesce(F.col("last") == F.col("doc"), F.lit(False)) & (F.col("pass_ix") == F.col("passes"))
    turns = turns.where((begins + F.col("n_tokens") <= F.col("demand")) | closing)
    x = F.least(F.lit(1.0), (begins + F.col("n_tokens") / 2) / F.greatest("demand", F.lit(1)))
    order = turns.select(position_of(x, F.col("pieces")).alias("position"), F.col("doc").cast(kind).alias("doc"), F.col("pass_ix").cast("int").alias("pass_ix"), "source", "n_tokens")
    order = durable(order, "mix-order")
    counted = order.groupBy("doc").agg(F.count("*").cast("int").alias("times"))
    times = durable(used.join(counted, "doc", "left").select("doc", "source", "n_tokens", F.coalesce("times", F.lit(0)).alias("times")), "mix-taken")
    nothing = base.where(~(F.coalesce(F.col("source").isin(list(want)), F.lit(False)) & (F.col("n_tokens") > 0)))
    every = times.union(nothing.select("doc", "source", "n_tokens", F.lit(0).alias("times")))

    goal = spark.createDataFrame([(s, share[s], want[s][1], float(demand[s])) for s in want], "source string, target_share double, max_repeats int, demand double")
    taken = times.groupBy("source").agg(F.sum("n_tokens").alias("stock_tokens"), F.sum(F.col("n_tokens") * F.col("times")).alias("taken_tokens"), F.max("times").alias("most_times"), F.sum((F.col("times") > 0).cast("long")).alias("documents"))
    whole = F.sum("taken_tokens").over(Window.partitionBy())  # of the target sources' rows
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = goal.join(taken, "source", "left").withColumn("whole", whole).select(
        "source", "target_share", "max_repeats", zero("stock_tokens"), zero("taken_tokens"), zero("most_times"), zero("documents"),
        F.when(F.col("whole") > 0, F.coalesce("taken_tokens", F.lit(0)) / F.col("whole")).otherwise(0.0).alias("share"),
        (F.col("demand") < F.lit(float(total_tokens)) * F.col("target_share") - 1).alias("runs_short"),
    )

    return Mixture(every, shares, order.repartitionByRange("position", "doc").sortWithinPartitions("position", "doc", "pass_ix"))
