"""The latest record per key, kept up to date as records arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(stream: DataFrame, key: Sequence[str], time: str, tie: str) -> DataFrame:
    """Per key the record with the latest time, then the greatest tie column; for output mode update or complete. The
    state is one record per key."""
    rest = [c for c in stream.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(time), F.col(tie)))
    return stream.groupBy(*key).agg(newest.alias("_latest")).select(*key, "_latest.*")
