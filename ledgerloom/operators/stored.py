"""Indexes that an application keeps for a table: found again only while the table's content is what they were built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT: dict[tuple, tuple[tuple, object]] = {}


def content(df: DataFrame, *columns: str) -> tuple:
    """Number of rows and two sums of their hashes, in one scan of the columns; no order of rows changes it, any other row does."""
    sums = [F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k in (0, 1)]
    return tuple(df.agg(F.count("*").alias("n"), *sums).first())


def kept(df: DataFrame, kind: str, columns: tuple[str, ...], build: Callable[[], object]):
    """The index (with a drop()) of these columns of df. The columns are read and hashed in every call; other content in the same place replaces the index and removes the old one."""
    places = {re.sub(r"/part-[^/]*$", "", f) for f in df.inputFiles()}  # a table written anew has other files in the same folder
    at = (df.sparkSession.sparkContext.applicationId, kind, columns, *sorted(places))
    now = content(df, *columns)
    held = _KEPT.get(at)
    if held and held[0] == now:
        return held[1]
    if held:
        held[1].drop()
    _KEPT[at] = (now, build())
    return _KEPT[at][1]


def forget() -> None:
    """Removes all kept indexes."""
    while _KEPT:
        _KEPT.popitem()[1][1].drop()
