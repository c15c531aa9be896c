"""Draws, folds, painted spans, offset maps, guards and name rules, against brute force and known figures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.functions.labels import painted
from codegrain.operators import allocate as al
from codegrain.operators import curate as cu
from codegrain.operators.durable import shared_dir
from codegrain.plans import labels as pl
from codegrain.plans.curation import joined_logits, mixed_models
from codegrain.plans.lexing import utf16_breaks, utf16_point


def test_draws_are_with_replacement_and_exact_in_number(spark):
    rows = [(i + 1_000_000, 1 if i else 600, "x") for i in range(400)] + [(5, 0, "x"), (6, None, "x"), (7, -3, "x")]
    df = spark.createDataFrame(rows, "id long, w long, times string")
    got = {r["id"]: r["times"] for r in al.weighted_sample(df, "id", "w", 1000, 7).collect()}
    assert sum(got.values()) == 1000 and not {5, 6, 7} & set(got)
    assert 540 < got[1_000_000] < 660 and any(n > 1 for i, n in got.items() if i > 1_000_000)
    assert got == {r["id"]: r["times"] for r in al.weighted_sample(df.repartition(7), "id", "w", 1000, 7).collect()}
    assert al.weighted_sample(df.where("w <= 0"), "id", "w", 10, 7).count() == 0
    halves = df.where("w > 0").withColumn("w", F.col("w") / 2)
    assert sum(r["times"] for r in al.weighted_sample(halves, "id", "w", 50, 1).collect()) == 50


def test_folds_follow_the_order_of_ids(spark):
    rng = random.Random(4)
    rows = [(lang, i * 7 + lang, rng.choice([1, 1, 2, 3, 5])) for lang in range(4) for i in range((3, 4, 17, 60)[lang])]
    got = {(r["l"], r["g"]): r["fold"] for r in al.folds(spark.createDataFrame(rows, "l int, g long, s long"), "l", "g", "s").collect()}
    for lang in range(4):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], r[1]))
        load = [0, 0]
        for _, g, s in mine:
            fold = load.index(min(load)) if len(mine) >= 4 else -1
            assert got[lang, g] == fold
            load[fold] += s if fold >= 0 else 0


def test_known_budgets():
    large = al.exact_budgets(al.large_weights(sorted(dims.TARGETS_LARGE)), 160_000_000)
    assert len(large) == 185 and large["javascript"] == 3_654_569 and large["zephir"] == 704_859 and sum(large.values()) == 160_000_000
    assert sum(al.floored_budgets(al.compact_weights(), 24_000_000).values()) == 30_069_311


def test_painted_spans(spark):
    rng = random.Random(1)
    kinds = [*dims.CLASS, "nosuch"]
    rows = [(i, rng.choice([0, 1, 7, 30]), [(rng.randint(-2, 25), rng.randint(0, 40), rng.choice(kinds), rng.choice([None, 0.5, 1.0])) for _ in range(rng.randint(0, 6))]) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None, None)], "id long, n int, s array<struct<start:long,end:long,type:string,confidence:double>>")
    for gate, fill in ((True, 9), (False, 0)):
        got = {r["id"]: r["rle"] for r in painted(df, "id", "n", "s", fill, gate).collect()}
        assert got.pop(99) == ""
        for i, n, spans in rows:
            line = [fill] * n
            for a, b, t, c in spans:
                if t in dims.CLASS and not (gate and c is not None and c < 1):
                    line[max(a, 0) : b] = [dims.CLASS[t]] * len(line[max(a, 0) : b])
            assert "".join(str(c) * int(k) for c, k in (x.split(":") for x in got[i].split(",") if x)) == "".join(map(str, line))


def test_utf16_map(spark):
    texts = ["", "plain", "a\U0001f600b", "\U0001f600\U0001f601", "xé\U0001d11e世\U0001f680z"]
    df = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts) for k in range(len(t) + 3)], "id int, t string, unit int")
    for r in df.select("t", "unit", utf16_point(F.col("unit"), utf16_breaks(F.col("t"))).alias("p")).collect():
        units = [0]
        for i, c in enumerate(r["t"], 1):
            units += [i, i] if ord(c) > 0xFFFF else [i]
        if r["unit"] < len(units):
            assert r["p"] == units[r["unit"]], r


def test_codecs_round_trip(spark):
    import numpy as np

    df = spark.range(0, 1 << 32, 104_729_033).select((F.col("id")).alias("w"))
    assert df.where(pl.base85_decode(pl.base85_encode(F.col("w"))) != F.col("w")).count() == 0
    bits = spark.range(65536).select(F.col("id").cast("int").alias("b")).select("b", pl.half_to_double(F.col("b")).alias("x")).collect()
    want = np.arange(65536, dtype=np.uint16).view(np.float16).astype(np.float64)
    assert all(r["x"] == want[r["b"]] or (np.isnan(r["x"]) and np.isnan(want[r["b"]])) for r in bits)


def test_letter_spans(spark):
    df = spark.createDataFrame([("k3w1i5",), ("",), (None,), ("s12 x4c2",)], "c string")
    got = [[tuple(x) for x in r["s"] or []] for r in df.select(pl.letter_spans(F.col("c")).alias("s")).collect()]
    assert got == [[(0, 3, "keyword"), (3, 4, "space"), (4, 9, "identifier")], [], [], [(0, 12, "string"), (12, 14, "class")]]


def test_stems_aliases_and_grammars(spark):
    rows = [("raw/x/Makefile", "make"), ("raw/x/Dockerfile.dev", "dockerfile"), ("raw/x/dockerfiles", "dockerfile"), ("raw/x/BUILD", "starlark"), ("raw/build/BUILD", "starlark"), ("raw/x/f.MK", "make")]
    df = spark.createDataFrame(rows, "p string, l string").withColumn("e", F.array(F.lit(".mk")))
    assert [r["ok"] for r in df.select(cu.wanted_path(F.col("p"), F.col("e"), cu.stems_of(F.col("l"))).alias("ok")).collect()] == [True, True, False, False, False, True]  # a file named BUILD is taken for a skipped folder
    names = spark.createDataFrame([("shell",), ("html",), ("zig",), ("tsql",), (None,)], "x string")
    assert [r[0] for r in names.select(cu.target_of(F.col("x"), True)).collect()] == ["bash", "xml", None, "sql", None]
    assert [r[0] for r in names.select(cu.target_of(F.col("x"), False)).collect()] == ["shell", "html", "zig", None, None]
    assert [r[0] for r in names.select(cu.grammar_of(F.col("x"))).collect()] == ["shellscript", "html", "zig", "sql", None]


def test_split_repair_of_a_large_language(spark):
    rows = [(i, 0, "train", i * 3, 0) for i in range(100)] + [(200, 1, "train", 5, 0), (201, 2, "train", 6, 0), (202, 2, "val", 7, 0), (203, 2, "train", 8, 0)]
    df = spark.createDataFrame(rows, "w long, l int, s string, ord long, c int")
    got = {r["w"]: r["s"] for r in cu.repair_splits(df, "l", "s", ["ord", "c", "w"]).collect()}
    assert [w for w, s in sorted(got.items()) if s == "val" and w < 100] == list(range(5))
    assert [w for w, s in sorted(got.items()) if s == "test" and w < 100] == list(range(5, 9))
    assert got[200] == "val" and got[201] == "test" and got[202] == "val" and got[203] == "train"


def test_logits_of_another_shape_or_set_are_refused(spark):
    wins = spark.createDataFrame([(1, "a"), (2, "b")], "win_id long, x string")
    logits = spark.createDataFrame([(1, [1.0, 2.0])], "win_id long, v array<double>")
    assert joined_logits(wins, logits, "win_id", "v", 2).where("v IS NULL").count() == 1
    with pytest.raises(ValueError, match="wide"):
        joined_logits(wins, logits, "win_id", "v", 3)
    with pytest.raises(ValueError, match="another"):
        joined_logits(wins, logits, "win_id", "v", 2, "x", "y")


def test_models_are_mixed_by_fold(spark):
    df = spark.createDataFrame([(f, [1.0, 2.0], [3.0, 5.0]) for f in (-1, 0, 1)], "f int, a array<double>, b array<double>")
    got = {r["f"]: r["m"] for r in df.select("f", mixed_models([F.col("a"), F.col("b")], F.col("f")).alias("m")).collect()}
    assert got == {-1: [2.0, 3.5], 0: [3.0, 5.0], 1: [1.0, 2.0]}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_counts_in_batches_equal_token_rows(spark):
    from codegrain.functions.featurize import feature_counts, token_rows

    texts = ["", None, "def f(x):\n\treturn {x: [1, 2]}\n", "a" * 500, "é \U0001f600('q\\'')\n\n}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for name, fields in (("compact_v2", ["kind", "brace_depth", "gap_prev"]), ("large_v1", ["quote_state", "line_pos"])):
        a = Counter((r["id"], *[r[f] for f in fields]) for r in token_rows(df, "id", "text", name, fields).collect())
        assert a == {(r["id"], *[r[f] for f in fields]): r["n"] for r in feature_counts(df, "text", name, fields, "id").collect()}


def test_late_versions_do_not_replace_newer_ones(spark, tmp_path):
    from codegrain.streaming.lexing import latest_wins, read_latest

    sink = latest_wins(str(tmp_path / "out"), "k", "v")
    for i, rows in enumerate(([("a", 3), ("b", 2)], [("a", 1), ("c", 1)], [("b", 5)])):
        sink(spark.createDataFrame(rows, "k string, v int"), i)
        sink(spark.createDataFrame(rows, "k string, v int"), i)
    assert {tuple(r) for r in read_latest(spark, str(tmp_path / "out"), "k", "v").collect()} == {("a", 3), ("b", 5), ("c", 1)}


def test_resync_skips_what_stands_between():
    from codegrain.operators.engines import resync

    assert resync("a  b\r\nb", ["a", "", "b", "b"]) == [0, 3, 6]
    assert resync("ab", ["b", "a"]) == [1] and resync("", ["x"]) == []


def test_labels_that_do_not_make_up_the_text_are_dropped(spark):
    from codegrain.operators.engines import label_texts

    def first(text, lang):
        if lang == "bad":
            raise RuntimeError("no grammar")
        return None if lang is None else [(text[:-1], 3)] if text.endswith("!") else [(text[:2], 1), (text[2:], 2)]

    df = spark.createDataFrame([(1, "abcd", "x"), (2, "abc!", "x"), (3, "abcd", "bad"), (4, "abcd", None), (5, None, "x"), (6, "", "x")], "id long, t string, l string")
    got = {r["id"]: (r["engine"], r["rle"]) for r in label_texts(df, "id", "t", "l", first, lambda t, x: [(t, 0)]).collect()}
    assert got == {1: ("first", "1:2,2:2"), 2: ("first", None), 3: ("fallback", "0:4"), 4: ("fallback", "0:4"), 5: (None, None), 6: ("first", "")}


def test_a_cache_is_resumed(spark, tmp_path):
    from codegrain.operators.engines import resumed

    runs = []

    def work(df):
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("lost")
        return df.withColumn("y", F.col("id") * 2)

    df, path = spark.range(50), str(tmp_path / "cache")
    with pytest.raises(RuntimeError):
        resumed(df, "id", work, path, "one", buckets=4)
    assert {r["id"]: r["y"] for r in resumed(df, "id", work, path, "one", buckets=4).collect()} == {i: 2 * i for i in range(50)}
    assert len(runs) == 5
    with pytest.raises(ValueError, match="made for"):
        resumed(df, "id", work, path, "two", buckets=4)
