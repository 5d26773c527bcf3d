"""python -m quarry index STORE [--query Q] | crawl STORE SEEDS [--max-pages N] [--seconds N] [--same-site] | serve STORE [--port N]

A store is a folder with the warehouse and the index. Exit codes: 0 done, 1 something is missing, 2 wrong usage, 130 stopped.
"""

from __future__ import annotations

import sys
import time

from quarry.operators.index import NoCrawlDataError, SearchIndex, StaleIndexError
from quarry.session import local_session
from quarry.sources import warehouse, web
from quarry.sources.warehouse import Snapshots, WarehouseMissing


class Usage(ValueError):
    """The command line is wrong."""


def taken(args: list[str], name: str) -> str | None:
    """The value of --name V or --name=V, taken out of args."""
    for i, a in enumerate(args):
        if a == f"--{name}":
            if i + 1 >= len(args):
                raise Usage(f"--{name} needs a value")
            value = args[i + 1]
            del args[i : i + 2]
            return value
        if a.startswith(f"--{name}="):
            del args[i]
            return a.partition("=")[2]
    return None


def number(args: list[str], name: str, default: int | None = None) -> int | None:
    """A flag with a number above 0: ASCII digits only."""
    value = taken(args, name)
    if value is None:
        return default
    if not (value.isascii() and value.isdigit() and int(value)):
        raise Usage(f"--{name} takes a number above 0")
    return int(value)


def shown(hits: list) -> str:
    return "\n".join(f"{r.title or '(no title)'}\n  {r.url}\n  {r.snippet}" for r in hits) or "No results"


def indexed(store: str, query: str | None) -> None:
    spark = local_session()
    index = SearchIndex(spark, f"{store}/index")
    pages = Snapshots.opened(spark, f"{store}/pages")
    if query is not None:
        print(shown(index.search(query).collect()))
        return
    before = index.count()
    new = index.build(warehouse.latest(pages.read("pages")))
    print(f"{new} documents indexed")
    if gone := before + new - index.count():
        print(f"{gone} documents taken out: gone, or not to be indexed")


def main(argv: list[str]) -> int:
    args = list(argv)
    try:
        command = args.pop(0) if args else ""
        if command == "index":
            query = taken(args, "query")
            (store,) = _exactly(args, 1)
            indexed(store, query)
        elif command == "crawl":
            most, seconds = number(args, "max-pages", 100), number(args, "seconds")
            same = "--same-site" in args
            store, seeds = _exactly([a for a in args if a != "--same-site"], 2)
            from quarry.streaming.crawl import crawl

            spark = local_session()
            got = crawl(
                warehouse.create(spark, f"{store}/pages"), web.seeds(spark, seeds), web.fetch_pages, web.robots_files, most, same_site=same, deadline=time.time() + seconds if seconds else None
            )
            print(", ".join(f"{n} {what}" for what, n in got.items()))
        elif command == "serve":
            port = number(args, "port", 8080)
            (store,) = _exactly(args, 1)
            from quarry.serve import Service, server

            spark = local_session()
            pages = Snapshots(spark, f"{store}/pages")
            service = Service(SearchIndex(spark, f"{store}/index"), lambda: warehouse.latest(pages.read("pages")) if pages.has("pages") else None)
            server(service, port).serve_forever()
        else:
            raise Usage(__doc__.strip())
    except Usage as e:
        print(e, file=sys.stderr)
        return 2
    except (WarehouseMissing, StaleIndexError, NoCrawlDataError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("Stopped; the index is as it was", file=sys.stderr)
        return 130
    return 0


def _exactly(args: list[str], n: int) -> list[str]:
    if len(args) != n or any(a.startswith("--") for a in args):
        raise Usage(__doc__.strip())
    return args


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
