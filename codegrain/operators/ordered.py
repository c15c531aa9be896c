"""Running sums and ranks over keys of any size.

A plain window gathers a whole key in one task.  Here the order column is cut into cells, each cell is
summed first (map-side combined), cells are summed up in order, and only rows of one cell meet in a
task.  The number of cells follows the table's size, so a key that holds a third of all rows is spread out
as evenly as the rest, and no join is on the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_cell(order_hash: Column, n_rows: Column, per_cell: int) -> Column:
    """Cell of a signed 64-bit hash when ``n_rows`` rows are to lie about ``per_cell`` to a cell.

    Cells are ranges of the hash, in its order; their number is a power of two up to 2^40.
    """
    bits = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n_rows, F.lit(1)) / F.lit(per_cell))))).cast("int")
    top = F.shiftright(order_hash, 24) + F.lit(1 << 39)  # 0 .. 2^40 - 1, order kept
    return F.floor(top / F.pow(F.lit(2.0), F.lit(40) - bits)).cast("long")


def running_sum(
    df: DataFrame, key: list[str], order_hash: str, ties: list[str], values: dict[str, str], per_cell: int = 20_000
) -> DataFrame:
    """``df`` with, for each ``values`` item {new column: summed column}, the sum over the rows before.

    Rows are ordered within ``key`` by the hash column ``order_hash`` and then ``ties``, which must make
    the order total.  Null summands count 0; null keys form a key of their own.  Helper columns begin
    with ``__rs_``.
    """
    k = [F.col(c) for c in key]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    # the cells are cut by the size of the whole table: a key's share of rows is its share of a full cell
    cells = df.withColumn("__rs_cell", hash_cell(F.col(order_hash), F.lit(df.count()), per_cell))
    per = cells.groupBy(*k, F.col("__rs_cell")).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"__rs_s_{n}") for n, v in values.items()])
    w = Window.partitionBy(*k).orderBy("__rs_cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*k, "__rs_cell", *[F.coalesce(F.sum(f"__rs_s_{n}").over(w), F.lit(0)).alias(f"__rs_b_{n}") for n in values])
    inner = Window.partitionBy(*k, F.col("__rs_cell")).orderBy(order_hash, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = cells.join(per, _all([*same(cells, per), cells["__rs_cell"] == per["__rs_cell"]])).drop(*[per[c] for c in [*key, "__rs_cell"]])
    for n, v in values.items():
        joined = joined.withColumn(n, F.col(f"__rs_b_{n}") + F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(inner), F.lit(0)))
    return joined.drop("__rs_cell", *[f"__rs_b_{n}" for n in values])


def salted_join(big: DataFrame, dim: DataFrame, key: str, weight: str, how: str = "inner", most: int = 1000, total: int | None = None) -> DataFrame:
    """``big`` joined with ``dim`` (one row per ``key``), keys that are frequent in ``big`` spread out.

    ``weight`` is the column of ``dim`` with the key's number of rows in ``big``, ``total`` their sum where it is
    known.  Keys with more than 1/``most`` of all rows are at most ``most``: only these are broadcast, as numbers of
    salts; ``dim`` is repeated per salt and ``big`` spread over the salts.  The weight column is dropped.
    """
    if total is None:
        total = dim.agg(F.sum(weight)).first()[0]
    return salted_by(big, dim.drop(weight), key, dim.select(key, weight), weight, total or 0, how, most)


def salted_by(big: DataFrame, dim: DataFrame, key: str, sizes: DataFrame, weight: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """As :func:`salted_join`, the numbers of rows standing in a light table ``sizes`` of ``key`` and ``weight``."""
    unit = max(total // most, 1)
    hot = sizes.where(F.col(weight) > unit).select(F.col(key).alias("__sj_key"), F.ceil(F.col(weight) / F.lit(unit)).cast("int").alias("__sj_parts"))
    keyed = lambda df: df.join(F.broadcast(hot), df[key] == F.col("__sj_key"), "left").drop("__sj_key")
    spread = keyed(big).withColumn("__sj_salt", F.pmod(F.xxhash64(*big.columns), F.coalesce("__sj_parts", F.lit(1))).cast("int")).drop("__sj_parts")
    each = keyed(dim).withColumn("__sj_salt", F.explode(F.sequence(F.lit(0), F.coalesce("__sj_parts", F.lit(1)) - 1))).drop("__sj_parts")
    return spread.join(each, [key, "__sj_salt"], how).drop("__sj_salt")


def self_pairs(df: DataFrame, key: str, id_col: str, condition: str = "true", per_block: int = 2_000) -> DataFrame:
    """Pairs of rows with one ``key``, as columns ``l`` and ``r`` of structs, the smaller id left.

    ``condition`` is SQL over ``l`` and ``r``.  Rows of a frequent key are cut into blocks; each two blocks
    meet in a place of their own, so a key of any size is spread over tasks.  Null keys pair with nothing.
    """
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__sp_n")).where("__sp_n > 1")
    n = n.withColumn("__sp_parts", F.ceil(F.col("__sp_n") / F.lit(per_block)).cast("int"))
    rows = salted_join(df, n, key, "__sp_n").withColumn("__sp_block", F.pmod(F.xxhash64(id_col), F.col("__sp_parts")).cast("int"))
    place = F.expr("explode(transform(sequence(0, __sp_parts - 1), j -> CAST(least(__sp_block, j) AS BIGINT) * __sp_parts + greatest(__sp_block, j)))")
    rows = rows.withColumn("__sp_meet", place).withColumn("__sp_alone", F.expr("__sp_meet DIV __sp_parts = __sp_meet % __sp_parts"))
    l, r = rows.alias("l"), rows.alias("r")
    met = l.join(r, F.expr(f"l.`{key}` = r.`{key}` AND l.__sp_meet = r.__sp_meet AND l.`{id_col}` < r.`{id_col}` AND (l.__sp_alone OR l.__sp_block <> r.__sp_block) AND ({condition})"))
    return met.select(*[F.struct(*[F.col(f"{x}.{c}") for c in df.columns]).alias(x) for x in ("l", "r")])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
