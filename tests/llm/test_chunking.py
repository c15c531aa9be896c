"""Pieces of oversized items: limits, overlaps and natural ends, against the definition."""

import random

import numpy as np

from codegrain.llm.chunking import pieces, split_items


def check(offsets, blocks, limit, overlap):
    got = pieces(np.array(offsets, np.int64), np.array(blocks, np.int64), limit, overlap)
    pos = sorted(set(offsets))
    total = pos[-1] - pos[0]
    lines = {p - pos[0] for p in pos}
    ends = {b - pos[0] for b in blocks if pos[0] < b < pos[-1]} | {total}
    lines |= ends
    over = min(max(overlap or 0, 0), limit - 1)
    at = 0
    for n, (frm, own, to, _) in enumerate(got):
        assert own == at and to > own and to - frm <= limit
        assert frm == (max(own - over, got[n - 1][0]) if n else 0)
        reach = own + limit - min(over, own)  # a piece near the start has less to repeat
        if total > limit:
            if any(own < e <= reach for e in ends):
                assert to in ends
            elif any(own < e <= reach for e in lines):
                assert to in lines
        at = to
    assert at == total


def test_random_items_end_naturally():
    rng = random.Random(0)
    for _ in range(1500):
        lens = [rng.choice([1, 3, 9, 20, 70]) for _ in range(rng.randint(1, 40))]
        pos = np.cumsum([rng.randint(0, 99), *lens]).tolist()
        blocks = [p for p in pos[1:] if rng.random() < 0.2]
        check(pos, blocks, rng.choice([8, 16, 64]), rng.choice([0, 1, 5, 7, 200, None]))


def test_many_small_items_end_naturally():
    rng = random.Random(1)
    for _ in range(20_000):
        pos = sorted({rng.randrange(60) for _ in range(rng.randint(2, 9))})
        if len(pos) > 1:
            check(pos, [p for p in pos if rng.random() < 0.4], rng.randint(2, 20), rng.randint(0, 19))
    got = pieces(np.array([0, 1, 11, 17, 22]), np.zeros(0, np.int64), 12, 6)
    assert [p[2] for p in got] == [11, 17, 22]


def test_awkward_items():
    none = np.zeros(0, np.int64)
    assert pieces(none, none, 10, 0) == [] and pieces(np.array([5]), none, 10, 0) == []
    assert pieces(np.array([9, 5, 5, 7]), none, None, 3) == [(0, 0, 4, "end")]
    assert pieces(np.array([0, 25]), none, 10, 0) == [(0, 0, 10, "cut"), (10, 10, 20, "cut"), (20, 20, 25, "end")]


def test_table_with_nulls_and_copies(spark):
    schema = "file_id long, offsets array<long>, block_starts array<long>, seq_len int, overlap int, built_at timestamp, id string, blocks string, version string"
    rows = [
        (1, [10, 20, None, 30, 45], [20], 20, 4, None, "a", "b", "c"),
        (1, [10, 20, None, 30, 45], [20], 20, 4, None, "a", "b", "c"),
        (2, None, None, 5, None, None, None, None, None),
        (3, [], None, None, None, None, None, None, None),
        (None, [1, 2], None, 1, None, None, None, None, None),
        (4, [0, 3], None, 0, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in split_items(df, "file_id", "offsets", "seq_len", "overlap", "block_starts", "built_at").orderBy("id", "piece_ix").collect():
        got.setdefault(r["id"], []).append((r["tok_from"], r["own_from"], r["tok_to"], r["ends_at"]))
    assert got == {1: [(0, 0, 10, "block"), (6, 10, 20, "line"), (16, 20, 35, "end")], 4: [(0, 0, 3, "end")]}
    assert split_items(df.where("false"), "file_id", "offsets", "seq_len").count() == 0
