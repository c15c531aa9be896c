"""Families, torn families and the allocation of splits."""

import random

from pyspark.sql import functions as F

from codegrain.llm.splits import QUOTAS, allocate, assign, families, owner_links, torn

FILES = "file_id long, path string, split string, lang string, ingested_at timestamp, doc string, owner string, family string, n string"
REPOS = "slug string, parent_slug string, renamed_to string"


def tables(spark):
    p = "corpus/raw/python/{}__repo__a.py"
    rows = [
        (1, p.format("Ann"), "train"), (2, "x\\raw\\c\\ ann \\r\\f.c", " VAL "), (3, p.format("bob"), None), (4, p.format("cid"), "train"),
        (5, p.format("Dan"), "test"), (6, "raw/c/only.c", "train"), (7, None, "val"), (8, p.format("eve"), "train"), (9, p.format("eve"), "Train"), (10, p.format("fay"), "test"),
    ]
    files = spark.createDataFrame([(i, path, s, "py", None, "d", "o", "f", "n") for i, path, s in [*rows, rows[0]]] + [(None,) * 9], FILES)
    repos = spark.createDataFrame([("BOB /x", None, " cid/y"), ("cid/z", "Dan/q", None), ("noslash", "eve/a", None), (None, None, None), ("fay/x", "fay/x", None)], REPOS)
    return files, repos


def test_owners_and_torn_families(spark):
    files, repos = tables(spark)
    assert {tuple(sorted(r)) for r in owner_links(repos).collect()} == {("bob", "cid"), ("cid", "dan")}
    fams = families(files, repos, "file_id", "path", "ingested_at", "split", "lang")
    of = {r["doc"]: r["family"] for r in fams.collect()}
    assert len(of) == 10 and of[1] == of[2] == "ann" and of[3] == of[4] == of[5] and of[6] is None and of[7] is None
    assert {r[0] for r in torn(fams, "split").collect()} == {1, 2, 3, 4, 5}
    placed = assign(fams.withColumn("label", F.lit("x")), "label", given="split").collect()
    assert {r["doc"] for r in placed if r["torn"]} == {1, 2, 3, 4, 5} and len(placed) == fams.count()


def test_splits_keep_families_and_quotas(spark):
    rng = random.Random(0)
    rows, n = [], 0
    for f in range(600):
        size = 700 if f == 0 else rng.choice([1, 1, 1, 2, 3, 5, 9])
        for _ in range(size):
            rows.append((n, f"fam{f}" if f % 10 else None, rng.choice(["a", "b", "c", None])))
            n += 1
    fams = spark.createDataFrame(rows, "doc long, family string, lang string")
    out = assign(fams, "lang").toPandas()
    assert sorted(out.doc) == list(range(n))
    assert (out.dropna(subset=["family"]).groupby("family").split.nunique() == 1).all()
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.9) < 0.01 and abs(share["val"] - 0.05) < 0.01 and abs(share["test"] - 0.05) < 0.01
    again = assign(fams, "lang").toPandas().set_index("doc").split.sort_index()
    assert again.equals(out.set_index("doc").split.sort_index())


def test_allocation_is_whole_and_spares_quotas():
    bundles = [("a", "=1", 1, 1000, 1000), ("a", "=9", 9, 50, 450), ("b", "one", 900, 1, 900), ("b", "=1", 1, 100, 100)]
    plan = allocate(bundles, QUOTAS)
    assert plan["b", "one"] == {"train": 1, "val": 0, "test": 0}
    for lb, cls, size, k, _ in bundles:
        assert sum(plan[lb, cls].values()) == k
    val = sum(plan[lb, cls]["val"] * size for lb, cls, size, _, _ in bundles)
    assert abs(val - 2450 * 0.05) <= 9


def test_empty_tables(spark):
    files, repos = tables(spark)
    fams = families(files.where("false"), repos.where("false"), "file_id", "path", "ingested_at", "split", "lang")
    assert torn(fams, "split").count() == 0 and assign(fams, "lang").count() == 0
