"""Answers over HTTP: /search and /passages as JSON, / as a page. Service.respond is the whole contract, without a socket."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, quote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import NoCrawlDataError, SearchIndex, StaleIndexError
from quarry.sources.warehouse import WarehouseMissing
from quarry.streaming.state import Limiters

#: Grows when a field goes or changes its meaning; new fields leave it alone.
VERSION = 1
PAGE_SIZE, LAST_PAGE, QUERY_CHARS = 10, 100, 200
PASSAGE_CHARS, SNIPPET_CHARS = 2000, 200
PER_MINUTE = 60
POLICY = "default-src 'none'; style-src 'unsafe-inline'; form-action 'self'"


class InvalidQuery(ValueError):
    """The request is at fault, and says how."""


def validated(params: Mapping[str, list[str]]) -> tuple[str, int]:
    """(query, page) of a request."""
    query = (params.get("q") or [""])[0].strip()
    page = (params.get("page") or ["1"])[0]
    if not query:
        raise InvalidQuery("q must hold a query")
    if len(query) > QUERY_CHARS:
        raise InvalidQuery(f"q takes {QUERY_CHARS} characters at most")
    if not page.isdecimal() or not 0 < int(page) <= LAST_PAGE:
        raise InvalidQuery(f"page is a number from 1 to {LAST_PAGE}")
    return query, int(page)


def safe_href(url: str) -> str | None:
    """The URL, if a link may have it: http and https only, with the colon."""
    head, colon, _ = url.partition(":")
    return url if colon and head.lower() in {"http", "https"} else None


def is_safe_href(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([^:]*):", 1)).isin("http", "https")


class Service:
    """index: the stored index; pages: gives the table of pages, or None where there is none."""

    def __init__(self, index: SearchIndex, pages: Callable[[], DataFrame | None], limit: int = PER_MINUTE, clock: Callable[[], float] = time.monotonic):
        self.index, self.pages, self.limiter = index, pages, Limiters(limit, 60.0, clock)

    def _page(self, query: str, page: int) -> tuple[list, bool]:
        """One page of hits, and whether another follows: an eleventh hit tells."""
        hits = self.index.search(query, PAGE_SIZE + 1, (page - 1) * PAGE_SIZE).collect()
        return hits[:PAGE_SIZE], len(hits) > PAGE_SIZE and page < LAST_PAGE

    def respond(self, path: str, params: Mapping[str, list[str]], client: str) -> tuple[int, dict[str, str], Any]:
        """(status, headers, payload): a dict for JSON, a string for HTML. The state of the index decides before the query."""
        if path not in ("/", "/search", "/passages"):
            return 404, {}, self._error("no such path")
        if path != "/" and not self.limiter.allow(client):
            return 429, {"Retry-After": "60"}, self._error(f"more than {self.limiter.limit} requests a minute")
        try:
            if path == "/" and "q" not in params:
                return 200, {}, _document("quarry", _form(""))
            query, page = validated(params)
            if path == "/passages":
                if page != 1:
                    raise InvalidQuery("passages have one page")
                found = self.index.passages(self.pages(), query, PAGE_SIZE).collect()
                rows = [{"url": r.url, "title": r.title, "position": r.position, "text": r.text[:PASSAGE_CHARS]} for r in found]
                return 200, {}, {"version": VERSION, "query": query, "passages": rows}
            hits, more = self._page(query, page)
            if path == "/":
                return 200, {}, _results(query, page, hits, more)
            rows = [{"url": r.url, "title": r.title, "snippet": r.snippet} for r in hits]
            return 200, {}, {"version": VERSION, "query": query, "page": page, "has_next": more, "results": rows}
        except InvalidQuery as e:
            return 400, {}, self._error(str(e))
        except (WarehouseMissing, StaleIndexError, NoCrawlDataError) as e:
            return 503, {}, self._error(f"{type(e).__name__}: not ready")
        except Exception:  # noqa: BLE001 - the caller gets an answer, never a trace
            return 500, {}, self._error("broken")

    @staticmethod
    def _error(what: str) -> dict[str, Any]:
        return {"version": VERSION, "error": what}


def _document(title: str, body: str) -> str:
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><body>{body}</body></html>'


def _form(query: str) -> str:
    return f'<form action="/" role="search"><input name="q" value="{html.escape(query)}" aria-label="query"><button>Search</button></form>'


def _results(query: str, page: int, hits: list, more: bool) -> str:
    items = []
    for r in hits:
        title, href = html.escape(r.title or r.url), safe_href(r.url)
        link = f'<a href="{html.escape(href)}">{title}</a>' if href else title
        items.append(f"<li><h2>{link}</h2><cite>{html.escape(r.url)}</cite><p>{html.escape(r.snippet[:SNIPPET_CHARS])}</p></li>")
    turn = lambda n, what: f'<a href="/?q={quote(query)}&amp;page={n}">{what}</a>'
    pager = turn(page - 1, "previous") * (page > 1) + " " + turn(page + 1, "next") * more
    return _document(query, _form(query) + (f"<ol>{''.join(items)}</ol>" if items else "<p>No results</p>") + f"<nav>{pager}</nav>")


def server(service: Service, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        timeout = 10

        def do_GET(self) -> None:  # noqa: N802
            parts = urlsplit(self.path)
            status, headers, payload = service.respond(parts.path, parse_qs(parts.query), self.client_address[0])
            as_json = not isinstance(payload, str)
            body = (json.dumps(payload, ensure_ascii=False) if as_json else payload).encode()
            self.send_response(status)
            kind = "application/json" if as_json else "text/html"
            for k, v in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(body)), "X-Content-Type-Options": "nosniff", "Content-Security-Policy": POLICY, **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
