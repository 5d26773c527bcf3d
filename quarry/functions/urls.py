"""URL algebra: canonical form, server key, dot segments, ASCII form. Column expressions where SQL can say it."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PORT = {"http": "80", "https": "443"}


def parts(url: str) -> tuple[str, str, str]:
    """(scheme, authority, rest), never raising; scheme and authority are empty for a URL without `://`."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)", url, re.S)
    return (m[1].lower(), m[2], m[3]) if m else ("", "", url)


def _authority(scheme: str, authority: str) -> tuple[str, str]:
    """(userinfo with @, host and port in canonical form)."""
    user, at, host = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*)(?::(.*))?", host, re.S)
    if not m:
        return user + at, host.lower()
    name, port = m[1].lower(), m[2]
    if port is not None and re.fullmatch(r"[0-9]+", port):
        port = port.lstrip("0") or "0"
    keep = port not in (None, "", _PORT.get(scheme))
    return user + at, f"{name}:{port}" if keep else name


def domain_key(url: str) -> str:
    """The server a URL names: host, and the port unless it is the scheme's own."""
    scheme, authority, _ = parts(url)
    return _authority(scheme, authority)[1]


def fold_dots(path: str) -> str:
    """A path without `.` and `..`; empty segments stay, and nothing climbs above the root."""
    out: list[str] = []
    pieces = path.split("/")
    for i, s in enumerate(pieces):
        if s in (".", ".."):
            if s == ".." and len(out) > 1:
                out.pop()
            if i == len(pieces) - 1:
                out.append("")
        else:
            out.append(s)
    return "/".join(out) or "/"


def to_ascii(url: str) -> str | None:
    """The URL in ASCII: IDNA host, percent-encoded rest; None if the host can't be converted."""
    if url.isascii():
        return url
    url = re.sub(r"[\t\r\n]", "", url)
    scheme, authority, rest = parts(url)
    user, at, host = authority.rpartition("@")
    name, colon, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    try:
        name = name if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return None
    head = f"{scheme}://" if authority or scheme else ""
    encode = lambda s: "".join(c if c.isascii() else quote(c, safe="") for c in s)
    return head + encode(user) + at + name + colon + port + encode(rest)


def normalize(url: str | None) -> str | None:
    """One spelling per resource: no fragment, lower-case scheme and host, no default port, folded path, upper-case hex."""
    if url is None:
        return None
    url = to_ascii(re.sub(r"[\t\r\n]", "", url))
    if url is None:
        return None
    scheme, authority, rest = parts(url)
    if not scheme:
        return url
    rest = rest.partition("#")[0]
    path, mark, query = rest.partition("?")
    user, host = _authority(scheme, authority)
    if host.startswith("..") or ".." in host and not host.isascii():
        return None
    whole = f"{scheme}://{user}{host}{fold_dots(path or '/')}{mark}{query}"
    return re.sub(r"%[0-9a-fA-F]{2}", lambda m: m[0].upper(), whole)


@F.pandas_udf(T.StringType())
def normalize_udf(url: pd.Series) -> pd.Series:
    return url.map(normalize)


def domain_key_column(url: Column) -> Column:
    """domain_key as an expression, for URLs with a scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#@]*)", 1))
    host = F.regexp_replace(host, r":0+([0-9]+)$", ":$1")
    own = ((scheme == "http") & host.endswith(":80")) | ((scheme == "https") & host.endswith(":443"))
    return F.regexp_replace(F.when(own, F.regexp_replace(host, r":[0-9]+$", "")).otherwise(host), ":$", "")


def fold_dots_column(path: Column) -> Column:
    """fold_dots as an expression."""
    s = F.split(path, "/")
    step = lambda out, g: F.when(g == ".", out).when(g == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(g)))
    folded = F.aggregate(s, F.expr("cast(array() as array<string>)"), step)
    folded = F.when(F.element_at(s, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    out = F.array_join(folded, "/")
    return F.when(out == "", "/").otherwise(out)
