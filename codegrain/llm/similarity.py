"""Shared machinery of the exact set-similarity joins: text classes, document frequencies, prefixes.

Texts are sets of k-word shingles (48-bit hashes).  Equal texts form one class before any join, so a
group of copies costs one representative, whatever its size.  Shingles are ordered by an estimated
document frequency, then by hash; any order that is the same everywhere keeps the prefix filter exact,
so a sketch of the counts of *all* shingles of *all* texts serves: it decides speed only.  Its size follows the
input's, up to ``SKETCH_MOST``: beyond some 10 TB it tells heavy shingles from the rest, and the rest are in the
order of their hashes.  The bitmaps that leave rows out before a shuffle follow the number of rows they stand
for, up to ``BITMAP_MOST``; a full one leaves nothing out and loses nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.functions.shingles import HASH_BITS, shingle_sets
from codegrain.operators.durable import durable
from codegrain.operators.ordered import salted_by, salted_join

SKETCH_LEAST, SKETCH_MOST = 20, 24  # 1 to 16 Mi counters: at most 64 MiB on the driver and in each worker
BITMAP_LEAST, BITMAP_MOST = 20, 29  # 128 KiB to 64 MiB
POSTINGS_PER_TASK = 1_000_000
SEGMENT_BITS = 14
HOT = 4_000  # postings of one shingle that may meet in one task; more are salted
LEVELS = 6  # most extra shared prefix shingles that the adaptive scheme asks for
VERIFY_COST = 30.0  # cost of verifying a candidate, in postings scanned


def sketch_bits(df: DataFrame) -> int:
    """A counter per 64 bytes that the optimizer expects of ``df``, within the bounds."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max((size // 64).bit_length(), SKETCH_LEAST), SKETCH_MOST)


def fingerprint(text: str | None) -> bytes | None:
    return None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in column.to_pylist()], pa.binary())


def survey(df: DataFrame, id_col: str, text_col: str, version_col: str | None, k: int, name: str) -> tuple[DataFrame, bytes]:
    """One pass over the texts: a light durable table and the sketch of shingle counts.

    Returns ``(doc, rep, fp, n_words)``, one row per id with a text (the latest delivered by
    ``version_col``, then the greatest fingerprint), where ``rep`` is the least id with an equal text;
    and the sketch, little-endian uint32 counters.  Null ids and null texts give no row.
    """
    size = 1 << sketch_bits(df.select(text_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        waiting: list[np.ndarray] = []
        held = 0
        for b in batches:
            text = b.column("text")
            words = np.zeros(len(text), np.int64)
            for lo, n_words, _, h in shingle_sets(text, k):
                words[lo : lo + len(n_words)] = n_words
                waiting.append((h & np.uint64(size - 1)).astype(np.int64))
                held += len(h)
                if held > 4_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("version"), _fingerprints(text), pa.array(words), pa.nulls(len(text), pa.int32()), pa.nulls(len(text), pa.binary())],
                names=["doc", "version", "fp", "n_words", "segment", "counts"],
            )
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
        step = 1 << SEGMENT_BITS
        parts = [(s, counts[s * step : (s + 1) * step]) for s in range(size // step)]
        parts = [(s, zlib.compress(c.astype("<u4").tobytes(), 1)) for s, c in parts if c.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([s for s, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())],
            names=["doc", "version", "fp", "n_words", "segment", "counts"],
        )

    version = F.unix_micros(F.col(version_col).cast("timestamp")) if version_col else F.lit(0).cast("long")
    src = df.select(F.col(id_col).cast("long").alias("doc"), version.alias("version"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    both = durable(src.mapInArrow(work, "doc long, version long, fp binary, n_words long, segment int, counts binary"), name)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << SEGMENT_BITS, np.uint64)
        for c in rows.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), "<u4")
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed], pa.binary())})

    # in two steps, so that no task gathers one segment from every map task of a large input
    some = both.where("segment is not null").select("segment", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part"))
    merge = lambda keys, t: add((keys[0],), t)
    once = some.groupBy("segment", "part").applyInArrow(merge, "segment int, counts binary")
    total = once.groupBy("segment").applyInArrow(merge, "segment int, counts binary").collect()
    sketch = np.zeros(size, np.uint32)
    for row in total:
        at = row["segment"] << SEGMENT_BITS
        sketch[at : at + (1 << SEGMENT_BITS)] = np.frombuffer(zlib.decompress(bytes(row["counts"])), "<u4")

    docs = both.where("doc is not null").groupBy("doc").agg(F.max_by(F.struct("fp", "n_words"), F.struct("version", "fp")).alias("x"))
    docs = docs.select("doc", "x.fp", "x.n_words")
    reps = docs.groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    return durable(salted_join(docs, reps, "fp", "n").select("doc", "rep", "fp", "n_words"), f"{name}-texts"), sketch.tobytes()


def required(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap that a set of ``n`` needs with any set of Jaccard ``num/den`` or more."""
    return -(-(num * n) // den)


def prefixes(
    df: DataFrame, id_col: str, text_col: str, sketch: bytes, k: int, num: int, den: int, least_words: int, adaptive: bool
) -> DataFrame:
    """Rows ``(doc, fp, size, level, tokens, parts)``: the prefix of each text in the common order.

    With ``adaptive`` the prefix is lengthened by ``level - 1`` shingles where the estimated cost of
    scanning its postings and verifying what they bring is least; two similar texts then share at least
    ``min(level, level)`` shingles of their prefixes.  ``parts`` is the number of blocks of each shingle's postings.
    Texts of fewer than ``least_words`` words, or without a shingle, give no row.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(sketch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint32)
        noise = int(counts.sum(dtype=np.uint64)) // len(counts)
        mask = np.uint64(len(counts) - 1)
        for b in batches:
            text, ids = b.column("text"), b.column("doc")
            prints = _fingerprints(text)
            for lo, n_words, bounds, h in shingle_sets(text, k):
                n = np.diff(bounds)
                good = np.flatnonzero((n_words >= least_words) & (n > 0))
                if not len(good):
                    continue
                df_est = np.maximum(counts[(h & mask).astype(np.int64)].astype(np.int64) - noise, 1)
                row = np.repeat(np.arange(len(n)), n)
                rank = np.minimum((np.log2(df_est) * 8).astype(np.uint64), np.uint64(255))
                order = np.lexsort((h, (row.astype(np.uint64) << np.uint64(8)) | rank))
                tokens, est = h[order].astype(np.int64), df_est[order]
                need = required(n, num, den)
                base = n - need + 1
                level = np.ones(len(n), np.int64)
                if adaptive:
                    scan = np.concatenate(([0], np.cumsum(est)))
                    other = np.concatenate(([0], np.cumsum(est - 1)))
                    best = np.full(len(n), np.inf)
                    for lv in range(1, LEVELS + 1):
                        stop = bounds[:-1] + np.minimum(base + lv - 1, n)
                        cost = (scan[stop] - scan[bounds[:-1]]) + VERIFY_COST * (other[stop] - other[bounds[:-1]]) / lv
                        better = (lv <= need) & (cost < best)
                        best[better] = cost[better]
                        level[better] = lv
                length = np.minimum(base + level - 1, n)[good]
                start = bounds[:-1][good]
                ends = np.cumsum(length)
                at = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                parts = np.minimum(-(-est[at] // HOT), 1 << 20).astype(np.int32)
                take = pa.array(lo + good)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), prints.take(take), pa.array(n[good], pa.int32()), pa.array(level[good], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(tokens[at])), pa.ListArray.from_arrays(offsets, pa.array(parts))],
                    names=["doc", "fp", "size", "level", "tokens", "parts"],
                )

    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return src.mapInArrow(work, "doc long, fp binary, size int, level int, tokens array<long>, parts array<int>")


def representatives(pre: DataFrame, texts: DataFrame, *carry: str) -> DataFrame:
    """``pre`` reduced to one row per class of equal texts; ``carry`` are class columns of ``texts``."""
    reps = texts.where("doc = rep").select("doc", F.col("fp").alias("rep_fp"), *carry)
    joined = pre.join(reps, "doc").where("fp = rep_fp")
    cols = ["size", "level", "tokens", "parts", *carry]
    # rows delivered twice meet here; their contents are equal
    return joined.groupBy("doc").agg(F.first(F.struct(*cols)).alias("x")).select("doc", *[f"x.{c}" for c in cols])


def postings(docs: DataFrame, *carry: str, positions: bool = False) -> DataFrame:
    """``doc, info, place`` (and ``pos``): one row per prefix shingle and meeting place.

    ``info`` packs size, level, whether all postings met here may pair, and the block.  A frequent
    shingle's postings are cut into blocks; each block meets every other in a place of its own, so no task
    gets them all.  ``place`` is the shingle, or a hash of a frequent one and the two blocks: should two places
    have one hash, some pairs more are verified.
    """
    arrays = ["tokens", "parts", *(["places"] if "places" in docs.columns else [])]
    flat = docs.select("doc", "size", "level", *carry, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "t"))
    if "places" in docs.columns:  # of prefixes that some shingles were taken out of
        flat = flat.withColumn("pos", F.col("t.places"))
    flat = flat.select("doc", "size", "level", *carry, *(["pos"] if positions else []), F.col("t.tokens").alias("token"), F.col("t.parts").alias("parts"))
    flat = flat.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    flat = flat.withColumn("meet", F.expr("explode(transform(sequence(0, parts - 1), j -> CAST(least(block, j) AS BIGINT) * parts + greatest(block, j)))"))
    info = F.expr("(CAST(size AS BIGINT) * 16 + level) * 2097152 + IF(parts = 1 OR meet DIV parts = meet % parts, 1048576, 0) + block")
    place = F.expr("IF(parts = 1, token, xxhash64(token, meet) | shiftleft(1L, 63))")
    return flat.select("doc", info.alias("info"), *carry, *(["pos"] if positions else []), place.alias("place"))


def spread_postings(post: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """``post`` in as many partitions as its expected size asks for: the prefixes of ``texts`` (their ``n_words``)."""
    words = texts.where("doc = rep").agg(F.sum("n_words")).first()[0] or 0
    least = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return post.repartition(max(least, -(-words * (den - num) // (den * POSTINGS_PER_TASK))), "place")


def meetings(left: DataFrame, right: DataFrame, num: int, den: int, order: str) -> DataFrame:
    """Pairs ``(a, b)`` of documents that pass the prefix, length and (with positions) position filters.

    Shingles that both have but that were not seen to be shared lie behind the prefix of the one whose
    prefix ends first, and behind the last shared one in both documents; so the overlap is bounded by the
    shared ones and what lies there.  Pairs whose bound is under the overlap they need are dropped.
    """
    positions = "pos" in left.columns
    size = lambda x: F.shiftright(F.col(f"{x}.info"), 25)
    level = lambda x: F.shiftright(F.col(f"{x}.info"), 21).bitwiseAND(15)
    rest = lambda x: F.greatest(F.ceil(size(x) * num / F.lit(den)) - level(x), F.lit(0))
    met = left.alias("l").join(right.alias("r"), F.expr(f"l.place = r.place AND {order} AND ((l.info & 1048576) <> 0 OR (l.info & 1048575) <> (r.info & 1048575))"))
    met = met.where(F.least(size("l"), size("r")) * F.lit(den) >= F.greatest(size("l"), size("r")) * F.lit(num))
    counts = [F.count("*").alias("shared"), F.first(size("l")).alias("size_a"), F.first(size("r")).alias("size_b"), F.first(F.greatest(rest("l"), rest("r"))).alias("rest")]
    if positions:
        counts += [F.max("l.pos").alias("pos_a"), F.max("r.pos").alias("pos_b")]
    pairs = met.groupBy(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).agg(*counts)
    behind = F.col("rest").cast("long")
    if positions:
        behind = F.least(behind, F.col("size_a") - F.col("pos_a") - F.lit(1), F.col("size_b") - F.col("pos_b") - F.lit(1))
    return pairs.where((F.col("shared") + behind) * F.lit(num + den) >= (F.col("size_a") + F.col("size_b")) * F.lit(num)).select("a", "b")


def bitmap(keys: DataFrame, key: str, bits: int | None = None) -> tuple[bytes, int]:
    """A bitmap of hashed ``key`` values, to leave out most other rows before an exact join, and its bits.

    Sixteen bits a value, within the bounds; it is put together on the executors, in words of 64 bits.
    """
    if bits is None:
        bits = min(max((16 * keys.count()).bit_length(), BITMAP_LEAST), BITMAP_MOST)
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = keys.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS b")
    # whole stretches leave the executors: at most 2^13 rows
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).groupBy(F.shiftright("w", 10).alias("s")).applyInArrow(_stretch, "s long, bits binary").toLocalIterator()
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        part = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.int64)
        out[r["s"] << 10 :][: len(part)] = part[: len(out) - (r["s"] << 10)]
    return out.tobytes(), bits


def _stretch(key: tuple, rows: pa.Table) -> pa.Table:
    out = np.zeros(1 << 10, np.int64)
    out[rows.column("w").to_numpy() & 1023] = rows.column("b").to_numpy()
    return pa.table({"s": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})


def with_slot(df: DataFrame, bits: int, key: str = "doc") -> DataFrame:
    return df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(1 << bits)))


def shingle_table(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, k: int) -> DataFrame:
    """``(doc, fp, shingles)`` of the texts whose ids are in ``wanted`` (``doc``): packed 6-byte hashes."""
    spark = df.sparkSession
    found, bits = bitmap(wanted, "doc")
    shared = spark.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.int64)
        for b in batches:
            slot = b.column("slot").to_numpy()
            hit = (marks[slot >> 6] >> (slot & 63)) & 1
            take = pa.array(np.flatnonzero(hit))
            if not len(take):
                continue
            ids, text = b.column("doc").take(take), b.column("text").take(take)
            prints = _fingerprints(text)
            for lo, n_words, bounds, h in shingle_sets(text, k):
                width = HASH_BITS // 8
                data = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
                offsets = pa.array(bounds * width, pa.int32())
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(n_words), [None, offsets.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(n_words)), prints.slice(lo, len(n_words)), packed], names=["doc", "fp", "shingles"])

    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return with_slot(src, bits).mapInArrow(work, "doc long, fp binary, shingles binary")


def unpack(packed: bytes) -> np.ndarray:
    width = HASH_BITS // 8
    raw = np.zeros((len(packed) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def verify(pairs: DataFrame, df: DataFrame, texts: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """``pairs (a, b)`` of representatives with ``n_a, n_b, n_both``, kept where Jaccard is num/den or more."""
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    sets = shingle_table(df, id_col, text_col, ends, k)
    reps = texts.where("doc = rep").select("doc", F.col("fp").alias("rep_fp")).join(ends, "doc", "left_semi")
    sets = sets.join(reps, "doc").where("fp = rep_fp").groupBy("doc").agg(F.first("shingles").alias("s"))
    # a text with many candidates is spread: its set is repeated once per salt, its pairs are dealt out
    n = pairs.count()
    one = pairs.select("a", "b")
    for end in ("a", "b"):
        sizes = pairs.groupBy(end).agg(F.count("*").alias("w"))
        one = salted_by(one, sets.select(F.col("doc").alias(end), F.col("s").alias(f"s{end}")), end, sizes, "w", n)
    two = one

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, na, nb, both = [], [], [], []
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                x, y = unpack(x), unpack(y)
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                common = int(np.count_nonzero(z[1:] == z[:-1]))
                if common * den >= num * (len(x) + len(y) - common):
                    keep.append(i), na.append(len(x)), nb.append(len(y)), both.append(common)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(take), batch.column("b").take(take), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(both, pa.int32())],
                names=["a", "b", "n_a", "n_b", "n_both"],
            )

    return two.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, n_a int, n_b int, n_both int")
