"""The lexer in SQL: ``SELECT * FROM tokenize(text)`` and scalar helpers, registered in a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codegrain.functions.featurize import features
from codegrain.functions.shingles import text_buffers


@udtf(returnType="tok_ix int, kind int, start int, end int, token string")
class Tokenize:
    """Raw tokens of one text; a null text has none."""

    def eval(self, text: str):  # noqa: ANN201
        if text:
            f = features(*text_buffers(pa.array([text])), "compact_v1")
            for i, (k, s, e) in enumerate(zip(f["kind"].tolist(), f["start"].tolist(), f["end"].tolist(), strict=True)):
                yield i, k, s, e, text[s:e]


def register(spark: SparkSession) -> None:
    """Make ``tokenize`` known to SQL of this session."""
    spark.udtf.register("tokenize", Tokenize)
