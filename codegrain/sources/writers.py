"""Writers of the engine's external formats, and the ledger of finished stages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = 1


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines ``path<TAB>rle``; rows without either are left out."""
    df.where("path IS NOT NULL AND rle IS NOT NULL AND rle <> ''").select(F.concat_ws("\t", "path", "rle").alias("value")).write.text(path)


def write_split_cache(df: DataFrame, path: str) -> None:
    """Windows by split; an empty split leaves no folder."""
    df.write.partitionBy("split").option("compression", "zstd").parquet(path)


def write_denylist(df: DataFrame, text_col: str, path: str) -> None:
    """Sorted distinct digests of texts, one per line."""
    df.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("value")).distinct().orderBy("value").write.text(path)


def write_meta(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.coalesce(1).write.json(path)


def publish_gate(version: int, languages: int, tokens: int, requested: int, least_languages: int = 185) -> None:
    """Raises unless the version is 2, all languages are covered and 95 % of the tokens are there."""
    if version != 2:
        raise ValueError(f"feature version {version} is not 2")
    if languages < least_languages:
        raise ValueError(f"{languages} of {least_languages} languages are covered")
    if tokens * 100 < requested * 95:
        raise ValueError(f"{tokens} of {requested} tokens are there")


class Ledger:
    """Stages done, kept as a JSON file on the driver.

    A stage that ran is skipped the next time; when one runs again, those after it are forgotten.  A ledger of
    another format starts anew.
    """

    def __init__(self, path: str | Path, stages: list[str]):
        self.path, self.stages = Path(path), stages
        data = json.loads(self.path.read_text()) if self.path.exists() else {}
        self.done: dict[str, str] = data.get("completed", {}) if data.get("format") == FORMAT else {}

    def run(self, stage: str, work: Callable[[], object]) -> bool:
        """Run a stage unless it is done; tells whether it ran."""
        if stage in self.done:
            return False
        for later in self.stages[self.stages.index(stage) + 1 :]:
            self.done.pop(later, None)
        work()
        self.done[stage] = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"format": FORMAT, "completed": self.done}, indent=1))
        part.replace(self.path)
        return True
