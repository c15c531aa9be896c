"""Containers and mixtures: whole items, bounds, shares."""

import random

from codegrain.llm.mixing import mix
from codegrain.llm.packing import pack, plan_bins
from codegrain.llm.tokens import encoding, token_counts, vocabulary_path


def test_plan_covers_every_item_once():
    rng = random.Random(1)
    for _ in range(60):
        hist = {s: rng.randint(1, 30) for s in rng.sample(range(1, 64), rng.randint(1, 40))}
        bins = plan_bins(hist, (16, 32, 64))
        seen = {s: [] for s in hist}
        for b in bins:
            used = sum(s * k for s, k, _ in b.contents)
            assert used + b.room == b.capacity and b.room >= 0 and b.capacity in (16, 32, 64)
            for s, k, rank in b.contents:
                seen[s].append((rank, rank + k * b.n))
        for s, n in hist.items():
            at = 0
            for lo, hi in sorted(seen[s]):
                assert lo == at
                at = hi
            assert at == n
        volume = sum(s * n for s, n in hist.items())
        assert sum(b.n * b.capacity for b in bins) <= volume * 2 + 64


def test_containers_hold_whole_items(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 5, 30, 64, 65, 130, 7, 7, 7])) for i in range(500)] + [(1000, None), (None, 5)]
    out = pack(spark.createDataFrame(sizes, "id long, n long").selectExpr("id", "n", "1 AS container", "2 AS place"), "id", "n", (16, 32, 64)).toPandas()
    want = {i: n for i, n in sizes if i is not None and n}
    got = out.assign(n=out.tok_to - out.tok_from)
    assert got.groupby("doc").n.sum().to_dict() == want
    assert (got[got.doc.map(want) <= 64].groupby("doc").size() == 1).all()
    full = got.groupby("container").agg(n=("n", "sum"), cap=("capacity", "max"), lo=("capacity", "min"))
    assert (full.n <= full.cap).all() and (full.cap == full.lo).all()
    s = got.sort_values(["container", "place"])
    before = s.groupby("container").n.cumsum() - s.n
    assert (before == s.place).all()
    assert pack(spark.createDataFrame([], "id long, n long"), "id", "n", (16,)).count() == 0


def test_token_counts_match_the_tokenizer(spark):
    texts = [(1, "def f(x):\n    return x"), (2, ""), (3, None), (4, "<|endoftext|> été 新的"), (1, "def f(x):\n    return x"), (None, "a")]
    got = {r["doc"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    enc = encoding(vocabulary_path())
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in texts if i and t is not None}


def test_mixture_reaches_shares_within_limits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" Big", "big", "mid", "small", "other", None]), rng.choice([0, 10, 50, 90, None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc long, source string, n_tokens long")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("SMALL ", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mix(docs, goal)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert shares["absent"]["share"] == 0 and shares["absent"]["runs_short"]
    for s, p in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[s]["share"] - p) < 0.01
        assert shares[s]["most_times"] <= shares[s]["max_repeats"]
    per = m.docs.toPandas()
    assert sorted(per.doc) == list(range(3000))
    assert (per[~per.source.isin(["big", "mid", "small"])].times == 0).all()
    order = m.order.toPandas()
    assert len(order) == per.times.sum() and order.position.is_monotonic_increasing and order.position.between(0, 1).all()
    assert order.groupby("doc").size().to_dict() == {d: t for d, t in zip(per.doc, per.times, strict=True) if t}


def test_larger_total_reports_what_runs_short(spark):
    docs = spark.createDataFrame([(i, "a" if i < 10 else "b", 100) for i in range(110)], "doc long, source string, n_tokens long")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mix(docs, goal, total_tokens=10_000).shares.collect()}
    assert shares["a"]["taken_tokens"] == 2000 and shares["a"]["runs_short"] and not shares["b"]["runs_short"]
    empty = mix(docs.where("false"), goal)
    assert empty.docs.count() == 0 and empty.shares.count() == 2 and empty.order.count() == 0


def test_costs_decide_what_is_opened():
    from codegrain.llm.packing import plan_bins

    even = plan_bins({500: 40, 12: 40}, (512, 1024, 2048))
    assert {b.capacity for b in even} == {2048}
    steep = plan_bins({500: 40, 12: 40}, (512, 1024, 2048), {512: 512, 1024: 1100, 2048: 2600})
    assert {b.capacity for b in steep} == {512} and sum(b.n for b in steep) == 40
    lone = plan_bins({509: 1}, (512, 1024, 2048))  # nothing else would fill a larger one
    assert [b.capacity for b in lone] == [512]


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    from codegrain.llm.mixing import integrated, position_of

    for knots in ([(0, 1), (1, 1)], [(0, 0), (1, 2)], [(0, 3), (0.25, 0), (0.5, 0), (1, 1)], [(0.5, 1)], [], [(0, 0), (1, 0)], [(0, -1), (1, 1)]):
        pieces = integrated(knots)
        assert abs(sum(w * d + a * d * d / 2 for (t, _, w, a), d in zip(pieces, [y[0] - x[0] for x, y in zip(pieces, [*pieces[1:], (1.0,)], strict=True)], strict=True)) - 1) < 1e-9
        df = spark.range(101).select((F.col("id") / 100).alias("x"))
        arr = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, ("t", "before", "weight", "slope"), strict=True)]) for p in pieces])
        for r in df.select("x", position_of(F.col("x"), arr).alias("t")).collect():
            t = r["t"]
            assert 0 <= t <= 1
            p = [p for p in pieces if p[0] <= t][-1]
            d = t - p[0]
            assert abs(p[1] + p[2] * d + p[3] * d * d / 2 - r["x"]) < 1e-6


def test_a_given_schedule_moves_a_source(spark):
    from codegrain.llm.mixing import mix

    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(200)], "doc long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    out = mix(docs, targets, schedules={"A ": [(0, 1), (0.5, 1), (0.5, 0), (1, 0)]})
    rows = out.order.collect()
    assert len(rows) == 200 and max(r["position"] for r in rows if r["source"] == "a") <= 0.5 + 1e-9
    assert {r["times"] for r in out.docs.collect()} == {1}
