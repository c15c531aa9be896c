"""Near-duplicate and cross-split joins against brute force, and on awkward tables."""

import random
import re
from itertools import combinations

import pytest

from codegrain.llm.crosssplit import cross_split, report
from codegrain.llm.neardup import expand_pairs, groups, near_duplicates

SCHEMA = "file_id long, text string, split string, ingested_at timestamp, doc string, rep string, size string, token string"


def shingles(text, k):
    w = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", text)
    return len(w), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den, least):
    sets = {i: s for i, t in rows.items() if t is not None for n, s in [shingles(t, k)] if n >= least and s}
    out = set()
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both * den >= num * len(sets[a] | sets[b]):
            out.add((a, b))
    return out


def corpus(seed, hot=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "слово", "x_1", "X_1"]
    rows, n = {}, 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows[n] = rng.choice([" ", "\n", " ; "]).join(t)
            n += 1
    for _ in range(hot):
        rows[n] = " ".join(["same"] * 3 + [f"h{i}" for i in range(40)])
        n += 1
    rows[n], rows[n + 1], rows[n + 2] = None, "", "   "
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed, hot=6)
    df = spark.createDataFrame([(i, t, None, None, "x", "y", "z", "w") for i, t in rows.items()] * 2, SCHEMA)
    found = near_duplicates(df, "file_id", "text", "ingested_at", k=4, num=7, den=10, least_words=30)
    got = [tuple(r) for r in expand_pairs(found.texts, found.links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 4, 7, 10, 30)


def test_groups_are_components(spark):
    rows = corpus(3, hot=5)
    df = spark.createDataFrame(list(rows.items()), "file_id long, text string")
    found = near_duplicates(df, "file_id", "text")
    got = {r["doc"]: r for r in groups(found).collect()}
    pairs = brute(rows, 5, 4, 5, 1)
    root = {i: i for i, t in rows.items() if t is not None and shingles(t, 5)[0] >= 1}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert set(got) == set(root)
    for i in root:
        assert find(got[i]["group_id"]) == find(i)
    same = [i for i in root if rows[i] == rows[max(j for j in rows if rows[j] and rows[j].startswith("same"))]]
    assert {got[i]["n_copies"] for i in same} == {5}


def test_salted_postings_lose_nothing(spark, monkeypatch):
    from codegrain.llm import similarity

    monkeypatch.setattr(similarity, "HOT", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = {i: " ".join(base[: 50 + i % 7] + [f"u{i}"]) for i in range(40)} | {100 + i: " ".join(rng.choice(base) for _ in range(50)) for i in range(10)}
    df = spark.createDataFrame(list(rows.items()), "file_id long, text string")
    found = near_duplicates(df, "file_id", "text", k=4, num=7, den=10, least_words=30)
    assert {tuple(r) for r in expand_pairs(found.texts, found.links).collect()} == brute(rows, 4, 7, 10, 30)


def test_cross_split_equals_brute_force(spark):
    rows = corpus(4, hot=6)
    rng = random.Random(1)
    split = {i: rng.choice([" Train", "TRAIN", "val", "Test ", None, "dev"]) for i in rows}
    df = spark.createDataFrame([(i, t, split[i], None, "x", "y", "z", "w") for i, t in rows.items()] * 2, SCHEMA)
    found = cross_split(df, "file_id", "text", "split", "ingested_at", k=4, num=7, den=10, least_words=30)
    got = {tuple(r) for r in found.pairs.collect()}
    side = {i: (s or "").strip().lower() for i, s in split.items()}
    want = {(a, b) for a, b in brute(rows, 4, 7, 10, 30) if {side[a], side[b]} in ({"train", "val"}, {"train", "test"})}
    assert got == want
    rep = report(found, df.selectExpr("file_id AS doc", "'r' AS repo").distinct()).collect()
    assert sum(r["n_pairs"] for r in rep) == len(want)


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = near_duplicates(empty, "file_id", "text", "ingested_at")
    assert expand_pairs(found.texts, found.links).count() == 0 and groups(found).count() == 0
    nulls = spark.createDataFrame([(None,) * 8, (1,) + (None,) * 7], SCHEMA)
    assert cross_split(nulls, "file_id", "text", "split", "ingested_at").pairs.count() == 0
    found = near_duplicates(nulls, "file_id", "text", "ingested_at")
    assert groups(found).count() == 0


def test_long_text_is_read_whole(spark):
    long = " ".join(f"t{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    found = near_duplicates(spark.createDataFrame(rows, "file_id long, text string"), "file_id", "text")
    assert {tuple(r) for r in expand_pairs(found.texts, found.links).collect()} == {(1, 2)}
