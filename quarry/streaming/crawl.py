"""The crawl as rounds: a URL of each server that is ready, fetched, stored, and its links queued; and the index as a stream.

A round is one plan over the tables pages, queue and servers (server, last, declared, delay, dropped), whatever their
size. Results are appended, so a round costs what it fetched.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.html import links_udf
from quarry.functions.robots import base_column, gated
from quarry.functions.urls import domain_key_column, normalize_udf
from quarry.operators.index import SearchIndex
from quarry.sources import warehouse
from quarry.sources.warehouse import Snapshots, is_fresh, latest
from quarry.streaming.frontier import LEAST, MOST

SERVERS = "server string, last double, declared double, delay double, dropped boolean"


def moment(seconds: float) -> Column:
    return F.timestamp_seconds(F.lit(int(seconds)))


def succeeded() -> Column:
    return F.col("html").isNotNull() & F.col("status").between(200, 299)


def to_store(results: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """The rows of results (FETCHED) that become pages. A refusal for too many requests isn't one, nor is an interrupted
    request (status null); a redirect counts as its target, unless that is known and fresh."""
    got = results.where("status IS NOT NULL AND status <> 429").withColumn("target", F.coalesce(normalize_udf(F.coalesce("final_url", "url")), "url"))
    fresh = pages.where(is_fresh(now)).select(F.col("url").alias("target"), F.lit(True).alias("fresh"))
    kept = got.join(fresh, "target", "left").where((F.col("target") == F.col("url")) | F.col("fresh").isNull())
    once = kept.groupBy("target").agg(F.max_by(F.struct("html", "status"), F.struct(F.col("html").isNotNull(), "url")).alias("x"))
    return once.select(F.col("target").alias("url"), "x.html", "x.status", now.alias("fetched_at"))


def links_of(pages: DataFrame) -> DataFrame:
    """url and server of all links on successful pages, each once."""
    found = pages.where(succeeded()).select(F.explode(links_udf("url", "html")).alias("url")).distinct()
    return found.withColumn("server", domain_key_column(F.col("url")))


def accepted(links: DataFrame, servers: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Links to servers in scope that aren't dropped."""
    kept = links.join(servers.where("dropped").select("server"), "server", "left_anti")
    return kept if scope is None else kept.join(scope, "server", "left_semi")


def relinked(pages: DataFrame, limit: int = 2000) -> DataFrame:
    """The links of the pages fetched longest ago, when there is nothing else to do: no request is made."""
    return links_of(warehouse.oldest(pages, limit).withColumn("status", F.lit(200)))


def after(servers: DataFrame, results: DataFrame) -> DataFrame:
    """The servers after their answers; results: server, sent, status, asked (the delay that robots.txt wants)."""
    s = servers.join(results, "server", "full").select("server", "last", "declared", F.coalesce("delay", F.lit(0.0)).alias("delay"), F.coalesce("dropped", F.lit(False)).alias("dropped"), "sent", "status", "asked")
    refused, answered = F.coalesce(F.col("status") == 429, F.lit(False)), F.col("status").isNotNull()
    half = F.col("delay") / 2
    delay = F.when(refused, F.greatest(F.lit(2.0), F.col("delay") * 2)).when(answered, F.when(half >= 2, half).otherwise(0.0)).otherwise(F.col("delay"))
    s = s.withColumn("new", delay)
    too_long = F.coalesce(F.col("asked") > MOST, F.lit(False))
    return s.select(
        "server", F.greatest("last", "sent").alias("last"), F.greatest(F.coalesce("declared", F.lit(LEAST)), F.when(too_long, None).otherwise(F.col("asked"))).alias("declared"),
        "new", (F.col("dropped") | too_long | (F.col("new") > MOST)).alias("dropped"),
    ).withColumnRenamed("new", "delay")


def due(store: Snapshots, now: float, limit: int, scope: DataFrame | None) -> DataFrame:
    """server, url and interval: the URL to ask each server that is ready, oldest first; fresh pages aren't asked for."""
    pages = latest(store.read("pages").select("url", "status", "fetched_at"))
    servers = store.read("servers")
    urls = warehouse.unfinished(pages, store.read("queue"), moment(now), 2**31 - 1, scope)
    at = pages.select("url", "fetched_at").join(store.read("queue"), "url", "full").select("url", F.coalesce("fetched_at", "seen").alias("at"))
    known = urls.join(at, "url").withColumn("server", domain_key_column(F.col("url"))).join(servers, "server", "left")
    interval = F.greatest(F.coalesce("declared", F.lit(LEAST)), F.coalesce("delay", F.lit(0.0)))
    known = known.where(~F.coalesce("dropped", F.lit(False))).withColumn("interval", interval)
    ready = known.where(F.col("last").isNull() | (F.lit(now) - F.col("last") >= F.col("interval")))
    first = Window.partitionBy("server").orderBy("at", "url")
    return ready.withColumn("_r", F.row_number().over(first)).where("_r = 1").orderBy("at", "url").limit(limit).select("server", "url", "interval")


def crawl(
    store: Snapshots, seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots: Callable[[DataFrame], DataFrame], max_pages: int, *, same_site: bool = False,
    clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, deadline: float | None = None, stopped: Callable[[], bool] = lambda: False,
) -> dict[str, int]:
    """Fetches up to max_pages pages, and says how many were saved, refused and forbidden.

    seeds: url. fetch: FETCHED rows for (url, interval). robots: base, status and body for bases. Ends at the deadline,
    when stopped, or when nothing waits; the round under way is stored first.
    """
    spark = seeds.sparkSession
    counts = {"saved": 0, "refused": 0, "forbidden": 0}
    if not store.has("servers"):
        store.write(servers=spark.createDataFrame([], SERVERS), robots=spark.createDataFrame([], "base string, status int, body string"))
    scope = seeds.select(domain_key_column(F.col("url")).alias("server")).distinct() if same_site else None
    store.write(queue=warehouse.remember(store.read("queue"), seeds.select("url", moment(clock()).alias("seen"))))
    now = moment(clock())
    if warehouse.unfinished(latest(store.read("pages").select("url", "status", "fetched_at")), store.read("queue"), now, 1).isEmpty():
        again = accepted(relinked(latest(store.read("pages"))), store.read("servers"), scope)
        store.write(queue=warehouse.remember(store.read("queue"), again.select("url", now.alias("seen"))))
    while counts["saved"] < max_pages and not stopped() and (deadline is None or clock() < deadline):
        at = clock()
        todo = due(store, at, max_pages - counts["saved"], scope)
        if todo.isEmpty():
            pause = waiting(store, at, scope)
            if pause is None or deadline is not None and at + pause >= deadline:
                break
            sleep(pause)
            continue
        bases = todo.select(base_column(F.col("url")).alias("base")).distinct().join(store.read("robots"), "base", "left_anti")
        store.append(robots=robots(bases))
        checked = gated(todo, store.read("robots").dropDuplicates(["base"]))
        checked = checked.withColumn("interval", F.greatest("interval", F.coalesce("delay", F.lit(0.0))))
        ok = F.col("allowed") & (F.coalesce("delay", F.lit(0.0)) <= MOST)
        got = fetch(checked.where(ok).select("url", "interval"))
        results = checked.select("server", "url", F.col("delay").alias("asked"), ok.alias("asked_for")).join(got, "url", "left")
        store.write(round=results)  # each URL is fetched once
        results = store.read("round")
        rows = results.agg(
            F.count_if(F.col("status") == 429).alias("refused"), F.count_if(~F.col("asked_for")).alias("forbidden"), F.count_if(succeeded()).alias("saved")
        ).first()
        for k in counts:
            counts[k] += rows[k]
        then = moment(at)
        fresh = to_store(results.where("asked_for"), latest(store.read("pages").select("url", "status", "fetched_at")), then)
        servers = after(store.read("servers"), results.groupBy("server").agg(F.max("sent").alias("sent"), F.max("status").alias("status"), F.max("asked").alias("asked")))
        links = accepted(links_of(fresh), servers, scope).select("url", then.alias("seen"))
        # Forbidden ones leave the queue, and so do answered ones: a page is known by its own row, a redirect by its target's.
        passed = results.where("NOT asked_for OR (status IS NOT NULL AND status <> 429)").select("url")
        queue = warehouse.remember(store.read("queue").join(passed, "url", "left_anti"), links)
        store.append(pages=fresh)
        store.write(servers=servers, queue=queue)
        store.sweep()
    return counts


def waiting(store: Snapshots, now: float, scope: DataFrame | None) -> float | None:
    """Seconds until a server with something to fetch is ready; None if nothing waits."""
    pages = latest(store.read("pages").select("url", "status", "fetched_at"))
    urls = warehouse.unfinished(pages, store.read("queue"), moment(now), 2**31 - 1, scope)
    s = urls.withColumn("server", domain_key_column(F.col("url"))).join(store.read("servers"), "server", "left").where(~F.coalesce("dropped", F.lit(False)))
    left = F.greatest(F.coalesce("declared", F.lit(LEAST)), F.coalesce("delay", F.lit(0.0))) - (F.lit(now) - F.col("last"))
    row = s.agg(F.min(F.greatest(F.lit(0.0), F.coalesce(left, F.lit(0.0)))).alias("w")).first()
    return row["w"]


def index_stream(spark: SparkSession, pages_path: str, index: SearchIndex, checkpoint: str, clock: Callable[[], float] = time.time):
    """A query that brings the index up to date with each batch of page files that arrives, then ends (availableNow)."""
    from datetime import datetime, timezone

    def run(batch: DataFrame, _: int) -> None:
        index.build(latest(batch), datetime.fromtimestamp(clock(), timezone.utc))

    stream = spark.readStream.schema(warehouse.PAGES).parquet(pages_path)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
