"""robots.txt: what may be fetched, and how long to wait between two requests."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.urls import domain_key, domain_key_column, parts

AGENT = "quarry/1.0"
#: What a failed request for robots.txt counts as; like all of 5xx it forbids everything.
UNREACHABLE = 599
_LEADING = re.compile(r"\d*\.?\d+")


def base(url: str) -> str:
    """The place whose robots.txt governs a URL: each scheme has its own."""
    return f"{parts(url)[0]}://{domain_key(url)}"


def base_column(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), F.lit("://"), domain_key_column(url))


def seconds(value: str) -> float | None:
    """A delay as written; what can't be read in full counts by its leading number, and a negative one not at all."""
    try:
        n = float(value)
    except ValueError:
        m = _LEADING.match(value)
        if m is None:
            return None
        n = float(m[0])
    return n if n >= 0 else None


def _groups(body: str) -> Iterable[tuple[list[str], str, str]]:
    """(agents, key, value) of each rule; a line that names an agent after a rule opens a new group."""
    agents: list[str] = []
    ruled = False
    for line in body.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key != "user-agent":
            ruled = True
            yield agents, key, value
        else:
            if ruled:
                agents, ruled = [], False
            agents = [*agents, value.lower()]


def crawl_delay(body: str, agent: str = AGENT) -> float | None:
    """The longest delay asked of this agent by name, else of all agents; None if nobody asks."""
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    if (whole := parser.crawl_delay(agent)) is not None:
        return float(whole)
    name = agent.split("/")[0].lower()
    asked: dict[bool, list[float]] = {True: [], False: []}
    for agents, key, value in _groups(body):
        if key == "crawl-delay" and (n := seconds(value)) is not None:
            if any(a not in ("", "*") and a in name for a in agents):
                asked[True].append(n)
            elif "*" in agents:
                asked[False].append(n)
    return max(asked[True] or asked[False], default=None)


def allowed(url: str, status: int, body: str | None, agent: str = AGENT) -> bool:
    """Whether a URL may be fetched: by the rules after 200, always after 4xx, never otherwise or if it can't be read."""
    if 400 <= status < 500:
        return True
    if status != 200:
        return False
    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    try:
        return parser.can_fetch(agent, url)
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def allowed_udf(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([allowed(u, int(s), b) if u is not None and s == s else False for u, s, b in zip(url, status, body)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def crawl_delay_udf(status: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([crawl_delay(b) if s == 200 and b is not None else None for s, b in zip(status, body)], dtype="float64")


def gated(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """urls (column url) with `allowed` and `delay`; robots: base, status and body. A server without a row is unreachable."""
    rules = robots.withColumn("delay", crawl_delay_udf("status", "body"))
    found = urls.withColumn("base", base_column(F.col("url"))).join(rules, "base", "left")
    status = F.coalesce("status", F.lit(UNREACHABLE))
    return found.withColumn("allowed", allowed_udf("url", status, "body")).drop("base", "status", "body")
