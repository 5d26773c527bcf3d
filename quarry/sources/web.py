"""Pages and robots.txt files from the network, seeds and fixtures from files; all of them as DataFrames."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.robots import AGENT, UNREACHABLE
from quarry.functions.urls import normalize_udf

TIMEOUT, RETRIES = 10, 2
PAGE_BYTES, ROBOTS_BYTES = 2_000_000, 512_000
FETCHED = "url string, status int, html string, final_url string, sent double"


class Fetched(NamedTuple):
    """status 0: no answer, or not a URL. html: None unless the answer is HTML."""

    status: int
    html: str | None
    url: str | None


class Interrupted(Exception):
    """The crawl is to stop, so a request isn't sent."""


def _request(url: str) -> urllib.request.Request:
    return urllib.request.Request(url, headers={"User-Agent": AGENT})


def fetch(url: str, before_send: Callable[[], None] | None = None, retries: int = RETRIES) -> Fetched:
    """One page. An answer of any status is final; silence is asked again, `retries` times. before_send runs before each."""
    try:
        request = _request(url)
    except ValueError:
        return Fetched(0, None, None)
    for _ in range(retries + 1):
        if before_send:
            before_send()
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                html = None
                if answer.headers.get("Content-Type", "").startswith("text/html"):
                    raw = answer.read(PAGE_BYTES)
                    try:
                        html = raw.decode(answer.headers.get_content_charset("utf-8"), "replace")
                    except LookupError:
                        html = raw.decode("utf-8", "replace")
                return Fetched(answer.status, html, answer.geturl())
        except urllib.error.HTTPError as e:
            return Fetched(e.code, None, url)
        except (http.client.InvalidURL, UnicodeError):
            break
        except (OSError, http.client.HTTPException):
            continue
    return Fetched(0, None, None)


def fetch_robots(base: str) -> tuple[int, str]:
    """(status, body) of a server's robots.txt; what exceeds the limit ends at a whole line."""
    try:
        with urllib.request.urlopen(_request(base + "/robots.txt"), timeout=TIMEOUT) as answer:
            raw = answer.read(ROBOTS_BYTES + 1)
            if len(raw) > ROBOTS_BYTES:
                raw = raw[: raw.rfind(b"\n", 0, ROBOTS_BYTES) + 1]
            return answer.status, raw.decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except (OSError, ValueError, http.client.HTTPException):
        return UNREACHABLE, ""


def paced(url: str, interval: float, stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, most: float = 30.0) -> tuple[float | None, Fetched | None]:
    """(when the last request left, the page): repeated requests keep the interval, and a server that asks for more than
    `most` isn't asked again. None as the page: interrupted before an answer."""
    sent: list[float] = []

    def before() -> None:
        if sent and (rest := interval - (clock() - sent[-1])) > 0:
            sleep(rest)
        if stopped():
            raise Interrupted
        sent.append(clock())

    try:
        got = fetch(url, before, RETRIES if interval <= most else 0)
    except Interrupted:
        got = None
    return (sent[-1] if sent else None), got


def fetch_pages(urls: DataFrame) -> DataFrame:
    """FETCHED rows for urls (url, interval), each server by one task, one request at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for url, interval in part[["url", "interval"]].itertuples(index=False):
            if last is not None and (rest := interval - (time.time() - last)) > 0:
                time.sleep(rest)
            sent, got = paced(url, interval)
            last = sent or last
            out.append((url, got.status, got.html, got.url, sent))
        return pd.DataFrame(out, columns=["url", "status", "html", "final_url", "sent"])

    from quarry.functions.urls import domain_key_column

    return urls.withColumn("server", domain_key_column(F.col("url"))).groupBy("server").applyInPandas(run, FETCHED)


def robots_files(bases: DataFrame) -> DataFrame:
    """base, status and body for each base."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(x, *fetch_robots(x)) for x in b["base"]], columns=["base", "status", "body"])

    return bases.select("base").distinct().mapInPandas(run, "base string, status int, body string")


def replayed(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """FETCHED rows from stored pages (url, html, status) instead of the network; 404 for what isn't there."""
    found = urls.join(pages.select("url", "html", "status"), "url", "left")
    return found.select("url", F.coalesce("status", F.lit(404)).cast("int").alias("status"), "html", F.col("url").alias("final_url"), F.lit(0.0).alias("sent"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a seed list: one a line, comments from #, http and https only, canonical, each once."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(^|\s)#.*$", "")).alias("url"))
    return lines.where(F.col("url").rlike(r"(?i)^https?://")).select(normalize_udf("url").alias("url")).where("url IS NOT NULL").distinct()


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """url, lang, title, body from a JSON array; what isn't one fails with its path."""
    return spark.read.schema("url string, lang string, title string, body string").option("multiLine", True).option("mode", "FAILFAST").json(path)


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """q, lang, answer from a JSON array."""
    return spark.read.schema("q string, lang string, answer string").option("multiLine", True).option("mode", "FAILFAST").json(path)


SHAPES = T.StructType([T.StructField("url", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHAPES).json(path)


def write_shapes(shapes: DataFrame, path: str) -> None:
    """JSON lines, ordered by URL, keys in alphabetical order."""
    shapes.select("positions", "sha", "url").orderBy("url").write.mode("overwrite").json(path)
