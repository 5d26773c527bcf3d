"""The page warehouse: freshness, the queue of URLs to fetch, upserts, snapshots."""

from __future__ import annotations

import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.urls import domain_key_column
from quarry.sources.storage import Folder

PAGES = "url string, html string, status int, fetched_at timestamp"
QUEUE = "url string, seen timestamp"
GONE = (404, 410)


class WarehouseMissing(FileNotFoundError):
    """There is no snapshot at this place."""


def is_fresh(now: Column, status: str = "status", fetched_at: str = "fetched_at") -> Column:
    """Within 30 days for a success, 15 for anything else; a refusal for too many requests never is."""
    days = F.when(F.col(status).between(200, 299), 30).otherwise(15)
    return (F.col(status) != 429) & (F.col(fetched_at) >= now - F.make_dt_interval(days))


def upsert(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per URL, the one fetched last; what was refused for too many requests isn't stored."""
    both = pages.withColumn("_new", F.lit(0)).unionByName(fetched.where("status <> 429").withColumn("_new", F.lit(1)))
    last = Window.partitionBy("url").orderBy(F.col("fetched_at").desc(), F.col("_new").desc(), F.col("status"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")


def remember(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue with new URLs; one that is known keeps its first date."""
    return queue.unionByName(found).groupBy("url").agg(F.min("seen").alias("seen"))


def unfinished(pages: DataFrame, queue: DataFrame, now: Column, limit: int = 1000, servers: DataFrame | None = None) -> DataFrame:
    """URLs to fetch, oldest first: stored but stale, or seen and never fetched; servers (column server) restricts them."""
    stale = pages.where(~is_fresh(now)).select("url", F.col("fetched_at").alias("at"))
    waiting = queue.join(pages.select("url"), "url", "left_anti").select("url", F.col("seen").alias("at"))
    due = stale.union(waiting).groupBy("url").agg(F.min("at").alias("at"))
    if servers is not None:
        due = due.withColumn("server", domain_key_column(F.col("url"))).join(servers, "server", "left_semi").drop("server")
    return due.orderBy("at", "url").limit(limit).select("url")


def oldest(pages: DataFrame, limit: int = 2000) -> DataFrame:
    return pages.where("html IS NOT NULL").orderBy("fetched_at", "url").limit(limit).select("url", "html")


def recheck(docs: DataFrame, pages: DataFrame, mark: Column | None) -> DataFrame:
    """What to do about documents whose page was fetched again: delete, replace or keep."""
    noindex = F.coalesce(F.col("noindex"), F.lit(False))
    if mark is None:
        action = F.when(F.col("html").isNotNull() & noindex, "delete").otherwise("keep")
        return docs.join(pages, "url").select("url", action.alias("action"))
    action = F.when(F.col("status").isin(*GONE), "delete").when(F.col("html").isNull(), "keep").when(noindex, "delete").otherwise("replace")
    return docs.join(pages.where(F.col("fetched_at") >= mark), "url").select("url", action.alias("action"))


def host_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.expr("count(DISTINCT substr(url, 1, instr(substr(url, 9), '/') + 7))").alias("n_hosts"))


class Snapshots:
    """Tables as immutable folders, and a pointer file that names the folders of each table and is replaced in one step:
    a failed run leaves the old state. append() adds a folder to a table, so a small change costs no rewriting."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Snapshots:
        """An existing warehouse; nothing is created."""
        found = cls(spark, path)
        found.current()
        return found

    def current(self) -> dict[str, list[str]]:
        if not self.folder.path or not self.folder.exists("_CURRENT"):
            raise WarehouseMissing(self.folder.path)
        return json.loads(self.folder.read("_CURRENT"))

    def has(self, table: str) -> bool:
        return self.folder.exists("_CURRENT") and table in self.current()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder.path}/{f}" for f in self.current()[table]])

    def _put(self, before: dict[str, list[str]], tables: dict[str, DataFrame]) -> None:
        name = f"v-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.folder.path}/{name}/{table}")
        self.folder.replace("_CURRENT", json.dumps(before | {t: [*before.get(t, []), f"{name}/{t}"] for t in tables}))

    def write(self, **tables: DataFrame) -> None:
        """The given tables get new contents, together; the folders before stay until sweep()."""
        before = self.current() if self.folder.exists("_CURRENT") else {}
        self._put({t: f for t, f in before.items() if t not in tables}, tables)

    def append(self, **tables: DataFrame) -> None:
        """The given rows are added to their tables, together."""
        self._put(self.current(), tables)

    def sweep(self) -> int:
        """Removes the folders that no table names, when no reader is left; how many they were."""
        live = {f.split("/")[0] for folders in self.current().values() for f in folders}
        old = [n for n in self.folder.names() if n.startswith("v-") and n not in live]
        for n in old:
            self.folder.delete(n)
        return len(old)


def latest(fetched: DataFrame) -> DataFrame:
    """One row per URL of appended fetches, the last one."""
    last = Window.partitionBy("url").orderBy(F.col("fetched_at").desc(), F.col("status"))
    return fetched.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def create(spark: SparkSession, path: str) -> Snapshots:
    """The warehouse at a place, with empty tables pages and queue if there is none yet."""
    found = Snapshots(spark, path)
    if not found.folder.exists("_CURRENT"):
        found.write(pages=spark.createDataFrame([], PAGES), queue=spark.createDataFrame([], QUEUE))
    return found


def get_html(pages: DataFrame, url: str) -> str | None:
    """The stored page of a URL, or None."""
    row = pages.where(F.col("url") == url).select("html").first()
    return row["html"] if row else None


def known(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows of urls that have a page, fresh or not."""
    return urls.join(pages.select("url"), "url", "left_semi")


@F.pandas_udf(T.StringType())
def _inflated_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else (zlib.decompress(b) if b[:1] == b"\x78" else bytes(b)).decode("utf-8", "replace"))


def inflated(stored: DataFrame, column: str = "html") -> DataFrame:
    """Pages of a store that mixes plain UTF-8 and zlib streams in one binary column, as text."""
    return stored.withColumn(column, _inflated_udf(column))
