"""The serving contract and the command line."""

import json
import urllib.error
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry import serve
from quarry.operators.index import SearchIndex, StaleIndexError
from quarry.sources import warehouse

PAGES = [(f"http://s.test/{i:02}", f"<title>t{i}</title><p>owl number {i}</p>" + "<p>owl " + "x" * 3000 + "</p>" * (i == 0), 200) for i in range(12)]


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('s')}/index"
    pages = spark.createDataFrame(PAGES, "url string, html string, status int").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp"))
    index = SearchIndex(spark, path)
    index.build(pages)
    return serve.Service(index, lambda: pages, 1000)


def q(**params):
    return {k: [v] for k, v in params.items()}


def test_answers(service):
    status, _, first = service.respond("/search", q(q="owl"), "c")
    assert status == 200 and set(first) == {"version", "query", "page", "has_next", "results"} and len(first["results"]) == 10 and first["has_next"]
    assert set(first["results"][0]) == {"url", "title", "snippet"}
    second = service.respond("/search", q(q="owl", page="2"), "c")[2]
    assert len(second["results"]) == 2 and not second["has_next"] and not {r["url"] for r in first["results"]} & {r["url"] for r in second["results"]}
    page = service.respond("/", q(q="owl"), "c")[2]
    places = [page.index(r["url"]) for r in first["results"]]
    assert places == sorted(places) and "page=2" in page and "<script" not in page
    status, _, found = service.respond("/passages", q(q="owl"), "c")
    assert status == 200 and set(found) == {"version", "query", "passages"} and all(len(p["text"]) <= 2000 for p in found["passages"])
    assert [p["url"] for p in found["passages"]] == [r["url"] for r in first["results"]]
    assert service.respond("/search", q(q="nothere"), "c")[2]["results"] == [] and "<form" in service.respond("/", {}, "c")[2]


@pytest.mark.parametrize("params", [{}, q(q="  "), q(q="x" * 201), q(q="a", page="0"), q(q="a", page="101"), q(q="a", page="-1"), q(q="a", page="x"), q(q="a", page="²")])
def test_wrong_requests(service, params):
    assert service.respond("/search", params, "c")[0] == 400


def test_states(service, monkeypatch):
    assert service.respond("/nowhere", {}, "c")[0] == 404 and service.respond("/passages", q(q="owl", page="2"), "c")[0] == 400
    for error, code in ((StaleIndexError("x"), 503), (warehouse.WarehouseMissing("x"), 503), (RuntimeError("secret"), 500)):
        def broken(*_, e=error):
            raise e

        monkeypatch.setattr(service.index, "search", broken)
        for text in ("owl", "\x01", "no such word"):
            status, _, body = service.respond("/search", q(q=text), "c")
            assert status == code and "secret" not in body["error"]


def test_limit_is_shared_and_spares_the_rest(service):
    small = serve.Service(service.index, service.pages, 2, lambda: 0.0)
    assert [small.respond(p, {}, "c")[0] for p in ("/", "/x", "/search", "/passages", "/search", "/", "/x")] == [200, 404, 400, 400, 429, 200, 404]
    assert small.respond("/search", {}, "c")[1] == {"Retry-After": "60"} and small.respond("/search", {}, "d")[0] == 400


def test_over_http(service):
    at = serve.server(service, 0)
    Thread(target=at.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{at.server_port}/search?q=owl") as r:
        assert r.headers["X-Content-Type-Options"] == "nosniff" and len(json.loads(r.read())["results"]) == 10
    with pytest.raises(urllib.error.HTTPError, match="400"):
        urllib.request.urlopen(f"http://127.0.0.1:{at.server_port}/search")
    at.shutdown()


def test_links(spark):
    rows = [("https://a/", True), ("HTTP://a/", True), ("//a/x", False), ("javascript:alert(1)", False), ("http", False), ("data:x", False)]
    assert [serve.safe_href(u) is not None for u, _ in rows] == [x for _, x in rows]
    assert [r[0] for r in spark.createDataFrame(rows, "u string, x boolean").select(serve.is_safe_href(F.col("u"))).collect()] == [x for _, x in rows]


def test_command_line(spark, tmp_path, capsys):
    store = f"file://{tmp_path}/s"
    assert cli.main([]) == cli.main(["index"]) == cli.main(["index", store, "--query"]) == cli.main(["serve", store, "--port", "x"]) == cli.main(["serve", store, "--port=²"]) == 2
    assert cli.main(["index", store]) == 1
    w = warehouse.create(spark, f"{store}/pages")
    w.append(pages=spark.createDataFrame([(u, h, s, None) for u, h, s in PAGES[:2]], warehouse.PAGES).withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp")))
    capsys.readouterr()
    assert cli.main(["index", store]) == 0 and cli.main(["index", store, "--query=nothing"]) == 0 and cli.main(["index", "--query", "owl", store]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["2 documents indexed", "No results"] and out[2:4] == ["t0", "  http://s.test/00"]
    args = ["--n", "3", "x"]
    assert cli.number(args, "n") == 3 and args == ["x"] and cli.number(["--n=4"], "n") == 4 and cli.number([], "n", 7) == 7
