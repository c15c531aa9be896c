"""Queries of the numeric codec, recurrences and inference (N, W12 to W15, X)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.functions import codec
from codegrain.operators.model import Config, Lexer, decay_logits
from codegrain.plans.common import file_values, files
from codegrain.tables import table

S = SparkSession
DECAY = 0.9
TAPS = (0.25, -0.5, 1.0, 0.5, 0.125)


def vectors(s: S, d: str) -> DataFrame:
    """Vectors, each once."""
    return table(s, d, "embeddings").where("embedding IS NOT NULL").groupBy("vec_id").agg(F.first("embedding").alias("v"), F.max("label").alias("label"))


BITS = (1, 2, 3, 4)


def _all_bits(s: S, d: str) -> DataFrame:
    """``vec_id, v, bits, scale, code, back`` from one scan."""
    v = vectors(s, d)
    v = v.withColumns({f"s{b}": codec.row_scale(F.col("v"), b) for b in BITS})
    v = v.withColumns({f"c{b}": codec.codes(F.col("v"), F.col(f"s{b}"), b) for b in BITS})
    each = [F.struct(F.lit(b).alias("bits"), F.col(f"s{b}").alias("scale"), F.col(f"c{b}").alias("code"), codec.dequantize(F.col(f"c{b}"), F.col(f"s{b}"), b).alias("back")) for b in BITS]
    return v.select("vec_id", "v", F.explode(F.array(*each)).alias("q")).select("vec_id", "v", "q.*")


def N01_row_scale(s: S, d: str) -> DataFrame:
    v = vectors(s, d)
    return v.select("vec_id", *[F.round(codec.row_scale(F.col("v"), b), 6).alias(f"s{b}") for b in (1, 2, 3, 4)])


def N01_group_scale(s: S, d: str) -> DataFrame:
    """One scale per group of rows: mean of the rows' means, or the group's largest magnitude."""
    v = vectors(s, d).select("label", codec.row_scale(F.col("v"), 1).alias("a"), codec.row_scale(F.col("v"), 4).alias("b"))
    return v.groupBy("label").agg(F.round(F.avg("a"), 6).alias("s1"), F.round(F.max("b"), 6).alias("s4"))


def N02_quantize(s: S, d: str) -> DataFrame:
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x)
    return _all_bits(s, d).select("vec_id", "bits", (F.round(total, 4) + 0.0).alias("total"))


def N03_codes(s: S, d: str) -> DataFrame:
    return _all_bits(s, d).select("bits", F.explode("code").alias("code")).groupBy("bits", "code").agg(F.count("*").alias("n"))


def N04_bitplanes(s: S, d: str) -> DataFrame:
    planes = F.array(*[F.when(F.col("bits") > p, F.struct(F.lit(p).alias("plane"), codec.plane_words(F.col("code"), p).alias("words"))) for p in range(max(BITS))])
    each = _all_bits(s, d).select("vec_id", "bits", F.explode(F.array_compact(planes)).alias("p"))
    return each.select("vec_id", "bits", F.col("p.plane").alias("plane"), F.posexplode("p.words").alias("word", "value"))


def _scalar_codes(s: S, d: str, how: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, steps, worst = [], [], []
            for v in b.column("v").to_pylist():
                x = np.array([y if y is not None else 0.0 for y in v], np.float32)
                if how == "i8":
                    code, step = codec.int8_encode(x)
                    back = codec.decode_segments([("i8", len(x))], np.array([step]), code.view(np.uint8))
                else:
                    x = np.abs(x) + np.float32(1e-3)
                    code, lo, step = codec.log8_encode(x)
                    back = codec.decode_segments([("log8", len(x))], np.array([lo, step]), code)
                sums.append(int(code.astype(np.int64).sum()))
                steps.append(float(step))
                worst.append(float(np.abs(back - x).max(initial=0)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(sums, pa.int64()), pa.array(steps, pa.float64()), pa.array(worst, pa.float64())], names=["vec_id", "code_sum", "step", "worst"])

    return vectors(s, d).select("vec_id", "v").mapInArrow(work, "vec_id long, code_sum long, step double, worst double")


def N05_int8_codes(s: S, d: str) -> DataFrame:
    return _scalar_codes(s, d, "i8")


def N06_log8_codes(s: S, d: str) -> DataFrame:
    return _scalar_codes(s, d, "log8")


def N09_round_trip(s: S, d: str) -> DataFrame:
    """Largest error of each width against half a step."""
    worst = F.array_max(F.zip_with(codec.doubles(F.col("v")), "back", lambda a, b: F.abs(a - b)))
    rows = _all_bits(s, d).where("bits > 1").select("bits", (worst <= F.col("scale") * 0.5000001).alias("ok"))
    return rows.groupBy("bits").agg(F.count("*").alias("rows"), F.sum(F.col("ok").cast("long")).alias("exact"))


def N13_classify(s: S, d: str) -> DataFrame:
    """Token classes of the default seeded model over all files."""
    rows = Lexer().class_counts(files(s, d), "file_id", "text").groupBy("file_id", "cls").agg(F.max("n").alias("n"))
    return rows.groupBy("cls").agg(F.sum("n").alias("n"))


def N21_decay(s: S, d: str) -> DataFrame:
    c = Config()
    out = [(name, i, float(v)) for name, span in (("ahead", c.decay_ahead), ("back", c.decay_back)) for i, v in enumerate(decay_logits(c.dim, *span))]
    return s.createDataFrame(out, "name string, ix int, logit double").select("name", "ix", F.round("logit", 4).alias("logit"))


def N23_group_runs(s: S, d: str) -> DataFrame:
    """Run lengths of equal labels in the order of vectors."""
    v = table(s, d, "embeddings").groupBy("vec_id").agg(F.max("label").alias("label"))
    # as in W08_file_groups: cells of ids, each with the last label of the cell before and the runs begun before it
    v = v.withColumn("cell", F.floor(F.col("vec_id") / 100_000))
    inner, cells = Window.partitionBy("cell").orderBy(F.col("vec_id").asc_nulls_last()), Window.orderBy(F.col("cell").asc_nulls_last())
    edge = v.groupBy("cell").agg(F.max_by(F.struct("label"), "vec_id").alias("last")).select(F.col("cell").alias("at"), F.lag("last").over(cells).alias("before"))
    r = v.join(edge, F.col("cell").eqNullSafe(F.col("at"))).drop("at").withColumn("prev", F.coalesce(F.lag(F.struct("label")).over(inner), F.col("before")))
    r = r.withColumn("new", (F.col("prev").isNull() | ~F.col("prev.label").eqNullSafe(F.col("label"))).cast("long"))
    base = r.groupBy("cell").agg(F.sum("new").alias("s")).select(F.col("cell").alias("at"), F.coalesce(F.sum("s").over(cells.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    r = r.join(base, F.col("cell").eqNullSafe(F.col("at"))).withColumn("run", F.col("base") + F.sum("new").over(inner))
    runs = r.groupBy("run").agg(F.min("vec_id").alias("first"), F.max("label").alias("label"), F.count("*").alias("n"))
    return runs.select("first", "label", "n")


def N24_linear(s: S, d: str) -> DataFrame:
    """Dot products of quantised with plain rows."""
    dot = F.aggregate(F.zip_with(codec.doubles(F.col("v")), "back", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return _all_bits(s, d).select("vec_id", "bits", F.round(dot, 4).alias("dot"))


def _running(values: Column, each: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Sum over all places of (sum of the first part so far) / max(1, sum of the second so far)."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a, b = each(x)
        a, b = acc["a"] + a, acc["b"] + b
        return F.struct(a.alias("a"), b.alias("b"), (acc["out"] + a / F.greatest(b, F.lit(1.0))).alias("out"))

    return F.aggregate(values, start, step)["out"]


def W12_prefix_suffix(s: S, d: str) -> DataFrame:
    """Prefix and suffix means summed over a vector; masked (every eighth place is padding) and gated prefixes."""
    v = codec.doubles(F.col("v"))
    mean = lambda x: (x, F.lit(1.0))
    gate = lambda x: (x / (1 + F.exp(-x)), 1 / (1 + F.exp(-x)))
    masked = F.transform(v, lambda x, i: F.struct(x.alias("x"), F.when(i % 8 == 7, 0.0).otherwise(1.0).alias("m")))
    return vectors(s, d).select(
        "vec_id", F.round(_running(v, mean), 6).alias("prefix"), F.round(_running(F.reverse(v), mean), 6).alias("suffix"),
        F.round(_running(masked, lambda p: (p["x"] * p["m"], p["m"])), 6).alias("masked"), F.round(_running(v, gate), 6).alias("gated"),
    )


def W13_recurrence(s: S, d: str) -> DataFrame:
    """h = 0.9 h + x over a vector, both ways: the last value."""
    fold = lambda c: F.aggregate(c, F.lit(0.0), lambda h, x: h * DECAY + x)
    v = codec.doubles(F.col("v"))
    return vectors(s, d).select("vec_id", F.round(fold(v), 6).alias("ahead"), F.round(fold(F.reverse(v)), 6).alias("back"))


DILATIONS = (1, 2, 4)


def W14_conv(s: S, d: str) -> DataFrame:
    """A five-tap convolution at several dilations, zeros beyond the ends."""
    v = codec.doubles(F.col("v"))
    conv = lambda step: F.transform(v, lambda _, i: sum(F.coalesce(F.get(v, i + (j - 2) * step), F.lit(0.0)) * F.lit(tap) for j, tap in enumerate(TAPS)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dilation"), conv(k).alias("y")) for k in DILATIONS])).alias("c")
    return vectors(s, d).select("vec_id", each).select("vec_id", "c.dilation", F.round(F.aggregate("c.y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("c.y"), 6).alias("top"))


def W15_signature(s: S, d: str) -> DataFrame:
    v = codec.doubles(F.col("v"))
    return vectors(s, d).select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), 6).alias("mean"), F.round(F.array_max(v), 6).alias("top"))


def X01_spans(s: S, d: str) -> DataFrame:
    """Spans of the default seeded model: number and last end per file."""
    out = Lexer().spans(files(s, d), "file_id", "text").select("file_id", F.size("spans").alias("n"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"])), F.lit(0)).alias("last"))
    return out.groupBy("file_id").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def X03_empty_texts(s: S, d: str) -> DataFrame:
    """Files without tokens keep their row."""
    return file_values(s, d, F.coalesce(F.length(F.regexp_replace("text", r"[\t-\r ]", "")), F.lit(0)).alias("solid")).select("file_id", (F.col("solid") == 0).alias("empty"))


def X09_latest(s: S, d: str) -> DataFrame:
    """The latest delivery of each file counts."""
    f = files(s, d).groupBy("file_id").agg(F.max_by("ord", "ingested_at").alias("ord"), F.max("ingested_at").alias("at"), F.count("*").alias("deliveries"))
    return f.select("file_id", "ord", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "deliveries")


_V = "v AS (SELECT vec_id, any_value(embedding) AS v, max(label) AS label FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id), l AS (SELECT vec_id, label, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) - 1 AS t FROM v)"
_Q = """b AS (SELECT unnest([1, 2, 3, 4]) AS bits), sc AS (SELECT vec_id, any_value(label) AS label, bits, greatest(CASE WHEN bits = 1 THEN avg(abs(x)) ELSE max(abs(x)) / (pow(2, bits - 1) - 1) END, 1e-8) AS scale FROM l, b GROUP BY vec_id, bits),
 q AS (SELECT vec_id, bits, t, x, scale, CASE WHEN bits = 1 THEN (x >= 0)::INT ELSE (least(pow(2, bits - 1) - 1, greatest(-pow(2, bits - 1), round_even(x / scale, 0))) + pow(2, bits - 1))::INT END AS code FROM l JOIN sc USING (vec_id)),
 bk AS (SELECT *, CASE WHEN bits = 1 THEN (2 * code - 1) * scale ELSE (code - pow(2, bits - 1)) * scale END AS back FROM q)"""
SQL = {
    "N01_row_scale": f"WITH {_V}, {_Q} SELECT vec_id, round(max(scale) FILTER (bits = 1), 6) AS s1, round(max(scale) FILTER (bits = 2), 6) AS s2, round(max(scale) FILTER (bits = 3), 6) AS s3, round(max(scale) FILTER (bits = 4), 6) AS s4 FROM sc GROUP BY vec_id",
    "N01_group_scale": f"WITH {_V}, {_Q} SELECT label, round(avg(scale) FILTER (bits = 1), 6) AS s1, round(max(scale) FILTER (bits = 4), 6) AS s4 FROM sc GROUP BY label",
    "N02_quantize": f"WITH {_V}, {_Q} SELECT vec_id, bits, round(sum(back), 4) + 0.0::DOUBLE AS total FROM bk GROUP BY ALL",
    "N03_codes": f"WITH {_V}, {_Q} SELECT bits, code, count(*) AS n FROM q GROUP BY ALL",
    "N04_bitplanes": f"WITH {_V}, {_Q} SELECT vec_id, bits, p::INT AS plane, (t // 32)::INT AS word, sum(((code >> p::INT) & 1)::BIGINT << (t % 32))::BIGINT AS value FROM q, range(4) r(p) WHERE p < bits GROUP BY ALL",
    "N09_round_trip": f"WITH {_V}, {_Q}, o AS (SELECT vec_id, bits, max(abs(x - back)) <= any_value(scale) * 0.5000001 AS ok FROM bk WHERE bits > 1 GROUP BY ALL) SELECT bits, count(*) AS rows, count_if(ok)::BIGINT AS exact FROM o GROUP BY bits",
    "N21_decay": "WITH c AS (SELECT * FROM (VALUES ('ahead', 0.90::DOUBLE, 0.998::DOUBLE), ('back', 0.20::DOUBLE, 0.93::DOUBLE)) AS t(name, lo, hi)), g AS (SELECT name, i, 1 - exp(ln(1 - lo) + (ln(1 - hi) - ln(1 - lo)) * i / 15) AS g FROM c, range(16) r(i)), k AS (SELECT name, i, least(1 - 1e-4, greatest(1e-4, g)) AS g FROM g) SELECT name, i::INT AS ix, round(ln(g / (1 - g)), 4) AS logit FROM k",
    "N23_group_runs": "WITH v AS (SELECT vec_id, max(label) AS label FROM embeddings GROUP BY vec_id), r AS (SELECT *, (lag(label) OVER (ORDER BY vec_id) IS DISTINCT FROM label OR row_number() OVER (ORDER BY vec_id) = 1)::INT AS new FROM v), s AS (SELECT *, sum(new) OVER (ORDER BY vec_id) AS run FROM r) SELECT min(vec_id) AS first, max(label) AS label, count(*) AS n FROM s GROUP BY run",
    "N24_linear": f"WITH {_V}, {_Q} SELECT vec_id, bits, round(sum(x * back), 4) AS dot FROM bk GROUP BY ALL",
    "W12_prefix_suffix": f"""WITH {_V}, z AS (SELECT *, CASE WHEN t % 8 = 7 THEN 0 ELSE 1 END AS m, 1 / (1 + exp(-x)) AS g FROM l), r AS (SELECT vec_id, avg(x) OVER a AS p, avg(x) OVER b AS q, sum(x * m) OVER a / greatest(1, sum(m) OVER a) AS k, sum(x * g) OVER a / greatest(1, sum(g) OVER a) AS o FROM z
      WINDOW a AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT vec_id, round(sum(p), 6) AS prefix, round(sum(q), 6) AS suffix, round(sum(k), 6) AS masked, round(sum(o), 6) AS gated FROM r GROUP BY vec_id""",
    "W13_recurrence": f"WITH {_V}, n AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM l) SELECT vec_id, round(sum(x * pow({DECAY}::DOUBLE, n - 1 - t)), 6) AS ahead, round(sum(x * pow({DECAY}::DOUBLE, t)), 6) AS back FROM n GROUP BY vec_id",
    "W14_conv": f"WITH {_V}, " + ", ".join(f"r{k} AS (SELECT vec_id, coalesce(lag(x, {2 * k}) OVER w, 0) * {TAPS[0]} + coalesce(lag(x, {k}) OVER w, 0) * ({TAPS[1]}) + x * {TAPS[2]} + coalesce(lead(x, {k}) OVER w, 0) * {TAPS[3]} + coalesce(lead(x, {2 * k}) OVER w, 0) * {TAPS[4]} AS y FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY t))" for k in DILATIONS) + " UNION ALL ".join(f"{' ' if i == 0 else ''}SELECT vec_id, {k} AS dilation, round(sum(y), 6) AS total, round(max(y), 6) AS top FROM r{k} GROUP BY vec_id" for i, k in enumerate(DILATIONS)),
    "W15_signature": f"WITH {_V} SELECT vec_id, round(avg(x), 6) AS mean, round(max(x), 6) AS top FROM l GROUP BY vec_id",
    "X03_empty_texts": "SELECT file_id, max(coalesce(length(regexp_replace(text, '[\\t-\\r ]', '', 'g')), 0)) = 0 AS empty FROM files GROUP BY file_id",
    "X09_latest": "SELECT file_id, arg_max(ord, ingested_at) AS ord, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS deliveries FROM files GROUP BY file_id",
}
QUERIES = {k: v for k, v in globals().items() if k[:1] in "NWX" and k[1:3].isdigit()}
