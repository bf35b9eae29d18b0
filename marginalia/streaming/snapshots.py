"""Weekly snapshots of disclosed files: merged by content hash, as batches of a file stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.changes import upsert_seen
from marginalia.sources.store import Versions

SCHEMA = "file_sha256 string, first_seen date, last_seen date"


def snapshot_date(path: Column, default: Column) -> Column:
    """The first date (YYYY-MM-DD) that is a part of the path, else the default."""
    return F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(path, r"(?:^|/)[^/]*?(\d{4}-\d{2}-\d{2})[^/]*(?=/|$)", 1), F.lit("")), "yyyy-MM-dd"), default)


def dump_dates(spark: SparkSession, last: str, weeks: int = 8) -> DataFrame:
    """``day``: every day of the weeks that end with ``last``, for probing dumps by date."""
    end = F.to_date(F.lit(last))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, 7 * weeks), end, F.expr("interval 1 day"))).alias("day"))


def hashed_files(files: DataFrame) -> DataFrame:
    """``path, name, file_sha256, bytes`` of a binaryFile frame."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("file_sha256"), F.octet_length("content").cast("long").alias("bytes"))


class SnapshotTable:
    """The merged table as committed versions; the same batch merged twice gives the same table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.versions = Versions(spark, path, SCHEMA)

    def read(self) -> DataFrame:
        return self.versions.read()

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """For ``foreachBatch``: batch has file_sha256 and seen."""
        self.versions.commit(upsert_seen(self.read(), batch))


def found_dumps(days: DataFrame, address: str, probe: Callable[[str], int]) -> DataFrame:
    """``day, url, found`` of the days of ``dump_dates``: whether ``probe``, a request that returns a status, finds that day's dump.

    ``address`` has ``{day}`` where the date stands; a probe that fails finds nothing.  Probes run on executors.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            urls = [address.replace("{day}", str(d)) for d in pdf.day]
            yield pd.DataFrame({"day": pdf.day, "url": urls, "found": [_status(probe, u) == 200 for u in urls]})

    return days.select("day").mapInPandas(run, "day date, url string, found boolean")


def _status(probe: Callable[[str], int], url: str) -> int:
    try:
        return probe(url)
    except Exception:  # by contract
        return 0


def event_windows(events: DataFrame, ts_col: str = "ts", width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark, over a batch or a stream: an extra that the source application lacks."""
    rows = events.withColumn("ts", F.col(ts_col).cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")
