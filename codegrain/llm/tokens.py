"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file (never trained here)."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: folder of the vocabulary files; a parameter of every query
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to this public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    """Path of a vocabulary file, in ``folder`` or in the installed package of public tokenizers."""
    path = os.path.join(folder, name)
    if os.path.exists(path):
        return path
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    raise FileNotFoundError(path)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, *carry: str, version_col: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """``doc, n_tokens`` and the carried columns: one row per id with a text, the latest delivered.

    Null ids and null texts give no row; an empty text has 0 tokens.  Whole texts are counted.
    """
    path = vocabulary or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) for t in b.column("text").to_pylist()]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(sizes, pa.int64())], names=[*rest, "n_tokens"])

    version = F.unix_micros(F.col(version_col).cast("timestamp")) if version_col else F.lit(0).cast("long")
    named = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    src = df.select(F.col(id_col).cast("long").alias("doc"), version.alias("version"), *named, F.col(text_col).alias("text")).where("doc is not null and text is not null")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in src.drop("text").schema]
    counted = src.mapInArrow(work, ", ".join([*kinds, "n_tokens long"]))
    cols = ["n_tokens", *[f"carry_{i}" for i in range(len(carry))]]
    one = counted.groupBy("doc").agg(F.max_by(F.struct(*cols), F.struct("version", *cols)).alias("x"))
    return one.select("doc", "x.n_tokens", *[F.col(f"x.carry_{i}").alias(c) for i, c in enumerate(carry)])
