"""The scheduler, the limiter, the crawl in rounds, and the index as a stream."""

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import robots
from quarry.operators.index import SearchIndex
from quarry.sources import warehouse, web
from quarry.streaming import crawl as cr
from quarry.streaming import frontier as fr
from quarry.streaming import state


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_turns_and_intervals():
    clock = Clock()
    f = fr.Frontier(clock)
    assert f.add(["http://a.test/1", "http://a.test/2", "http://b.test/1", "http://a.test/1"]) == ["http://a.test/1", "http://a.test/2", "http://b.test/1"]
    assert [f.next(), f.next(), f.next()] == ["http://a.test/1", "http://b.test/1", "http://a.test/2"]  # taking starts no clock
    f.add(["http://a.test/3", "http://b.test/2"])
    f.server("a.test").sent(100.0)
    f.server("a.test").sent(90.0)  # never goes back
    assert f.next(busy={"b.test"}) is None and f.wait(busy={"b.test"}) == 1.0 and f.wait() == 0.0
    clock.now = 101.0
    assert f.next(busy={"b.test"}) == "http://a.test/3"
    assert fr.Frontier(clock, scope={"a.test"}).add(["http://c.test/", "http://a.test/"]) == ["http://a.test/"] and fr.Frontier(clock).wait() == 0.0


def test_declared_intervals_and_penalties():
    f = fr.Frontier(Clock())
    f.add(["http://a.test/1", "http://b.test/1"])
    assert f.declare("a.test", 5.0) and f.declare("a.test", 2.0) and f.declare("a.test", None) and f.server("a.test").interval == 5.0
    assert f.declare("a.test", 30.0) and not f.declare("a.test", 30.1) and f.add(["http://a.test/2"]) == [] and list(f.waiting) == ["b.test"]
    b = f.server("b.test")
    assert [(f.answered("b.test", True), b.interval) for _ in range(4)] == [(True, 2.0), (True, 4.0), (True, 8.0), (True, 16.0)]
    assert f.answered("b.test", False) and b.interval == 8.0
    assert [f.answered("b.test", False) for _ in range(4)] and b.interval == 1.0
    assert [f.answered("b.test", True) for _ in range(5)] == [True] * 4 + [False] and not f.waiting


def test_scheduler_stream(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame(rows, fr.EVENTS).coalesce(1).write.json(f"file://{tmp_path}/in/{n}")

    add = lambda s, u: (s, "add", u, None, None, None)
    arrive(0, [add("a", "http://a/1"), add("a", "http://a/2"), add("a", "http://a/1"), add("b", "http://b/1")])
    stream = spark.readStream.schema(fr.EVENTS).option("recursiveFileLookup", True).json(f"file://{tmp_path}/in")
    query = fr.schedule(stream).writeStream.format("memory").queryName("requests").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    got = lambda: sorted(r.url for r in spark.table("requests").collect())

    def until(n):  # a query with timers is never done
        for _ in range(80):
            if len(got()) >= n:
                break
            time.sleep(0.5)

    try:
        until(2)
        assert got() == ["http://a/1", "http://b/1"]  # one under way each
        now = time.time()
        arrive(1, [("a", "answer", "http://a/1", now, 200, None), ("b", "answer", "http://b/1", now, 200, 31.0), add("b", "http://b/2")])
        until(3)
        rows = {r.url: r.at for r in spark.table("requests").collect()}
        assert got() == ["http://a/1", "http://a/2", "http://b/1"] and rows["http://a/2"] >= now + 1.0  # b asked for too long a pause
    finally:
        query.stop()


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(i, "u" if i % 3 else "v", float(i * 7 % 60 + 60 * (i // 20))) for i in range(60)]
    rows.sort(key=lambda r: (r[2], r[0]))
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], "event_id long, k string, t double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        time.sleep(0.01)
    events = spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = fr.limited(stream, "k", 3, 60.0).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {r.event_id: r.allowed for r in state.rate_limit(events, "k", ["event_id"], 3, 60.0).collect()}
    assert {r.event_id: r.allowed for r in spark.table("limits").collect()} == batch and 0 < sum(batch.values()) < 60


def test_limiters():
    clock = Clock()
    x = state.Limiters(2, 60, clock)
    assert [x.allow("a"), x.allow("a"), x.allow("a"), x.allow("b")] == [True, True, False, True]
    clock.now += 60
    assert x.allow("a") and x.sweep() == 1


SITE = {
    "http://a.test/": ('<a href="/1">x</a><a href="http://b.test/">y</a><a href="/secret">z</a>', 200), "http://a.test/1": ('<a href="/old">x</a>', 200),
    "http://a.test/old": (None, 301), "http://b.test/": ("<p>b</p>", 200), "http://a.test/secret": ("<p>s</p>", 200), "http://c.test/": (None, 429),
}
RULES = {"http://a.test": (200, "User-agent: *\nDisallow: /secret\nCrawl-delay: 2"), "http://b.test": (404, ""), "http://c.test": (404, "")}


def test_crawl_in_rounds(spark, tmp_path):
    clock, sent = Clock(), []

    def fetch(urls):
        rows = []
        for r in urls.collect():
            html, status = SITE[r.url]
            target = "http://a.test/1" if status == 301 else r.url
            html, status = SITE["http://a.test/1"] if status == 301 else (html, status)
            sent.append((clock.now, r.url))
            rows.append((r.url, status, html, target, clock.now))
        return spark.createDataFrame(rows, web.FETCHED)

    def files(bases):
        return spark.createDataFrame([(r.base, *RULES[r.base]) for r in bases.collect()], "base string, status int, body string")

    store = warehouse.create(spark, f"file://{tmp_path}/w")
    seeds = spark.createDataFrame([("http://a.test/",), ("http://c.test/",)], "url string")
    counts = cr.crawl(store, seeds, fetch, files, 10, clock=clock, sleep=clock.sleep, deadline=140.0)
    assert counts["saved"] == 3 + 1 and counts["forbidden"] == 1 and counts["refused"] == 5
    pages = {r.url: r.status for r in warehouse.latest(store.read("pages")).collect()}
    assert pages == {"http://a.test/": 200, "http://a.test/1": 200, "http://b.test/": 200}  # no 429, no forbidden page, the redirect's target once
    times = [t for t, u in sent if u.startswith("http://a.test")]
    assert all(b - a >= 2 for a, b in zip(times, times[1:])) and "http://a.test/secret" not in [u for _, u in sent]
    gaps = [t for t, u in sent if u.startswith("http://c.test")]
    assert [b - a for a, b in zip(gaps, gaps[1:])][:3] == [2.0, 4.0, 8.0]
    # Nothing to fetch but the refusing server: stored pages give their links again, without a request.
    store.write(queue=store.read("queue").limit(0))
    before = len(sent)
    cr.crawl(store, spark.createDataFrame([("http://a.test/",)], "url string"), fetch, files, 0, clock=clock, sleep=clock.sleep)
    assert len(sent) == before and {r.url for r in store.read("queue").collect()} >= {"http://a.test/1", "http://b.test/"}


def test_index_stream_equals_batch(spark, tmp_path):
    pages = lambda rows: spark.createDataFrame(rows, warehouse.PAGES)
    from datetime import datetime

    day = lambda n: datetime(2024, 3, n)
    a = pages([("http://a/", "<p>cat</p>", 200, day(1)), ("http://b/", "<p>dog</p>", 200, day(1))])
    b = pages([("http://a/", "<p>cow</p>", 200, day(4)), ("http://c/", "<p>cat cat</p>", 200, day(4))])
    clock = Clock()
    stream, batch = SearchIndex(spark, f"file://{tmp_path}/s"), SearchIndex(spark, f"file://{tmp_path}/b")
    for n, (part, t) in enumerate(((a, day(2)), (b, day(5)))):
        part.write.mode("append").parquet(f"file://{tmp_path}/pages")
        clock.now = t.timestamp()
        cr.index_stream(spark, f"file://{tmp_path}/pages", stream, f"file://{tmp_path}/check", clock).awaitTermination(180)
        batch.build(part, t.astimezone())
    for q in ("cat", "cow", "dog"):
        assert stream.search(q).collect() == batch.search(q).collect() and batch.search(q).count() == 1


@pytest.fixture
def site():
    hits = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            hits.append(self.path)
            if self.path == "/broken" and hits.count("/broken") < 3:
                self.connection.close()
                return
            code = {"/gone": 410}.get(self.path, 200)
            kind = "image/png" if self.path == "/image" else "text/html; charset=" + ("latin-1" if self.path == "/latin" else "utf-8" if self.path != "/odd" else "no-such")
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(b"User-agent: *\n" * 60_000 if self.path == "/robots.txt" else "é".encode("latin-1" if self.path == "/latin" else "utf-8"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", hits
    server.shutdown()


def test_fetching(spark, site):
    base, hits = site
    assert web.fetch(base + "/a") == (200, "é", base + "/a") and web.fetch(base + "/latin").html == "é" and web.fetch(base + "/odd").html == "é"
    assert web.fetch(base + "/image") == (200, None, base + "/image") and web.fetch(base + "/gone") == (410, None, base + "/gone") and hits.count("/gone") == 1
    assert web.fetch("no url") == (0, None, None) and web.fetch("http://a b/") == (0, None, None)
    slept = []
    sent, got = web.paced(base + "/broken", 7.0, sleep=slept.append)
    assert got.status == 200 and hits.count("/broken") == 3 and len(slept) == 2 and all(6 < s <= 7 for s in slept)
    assert web.paced(base + "/a", 1.0, stopped=lambda: True) == (None, None)
    status, body = web.fetch_robots(base)
    assert status == 200 and len(body) <= web.ROBOTS_BYTES and set(body.splitlines()) == {"User-agent: *"}
    assert web.fetch_robots("http://127.0.0.1:1")[0] == robots.UNREACHABLE
    urls = spark.createDataFrame([(base + "/a", 0.0), (base + "/gone", 0.0)], "url string, interval double")
    assert {(r.url[len(base) :], r.status) for r in web.fetch_pages(urls).collect()} == {("/a", 200), ("/gone", 410)}
    assert web.robots_files(spark.createDataFrame([(base,)], "base string")).first().status == 200


def test_files(spark, tmp_path):
    (tmp_path / "seeds").write_text("# seeds\nhttp://A.test  # a comment\n\nftp://b.test/\nhttp://a.test/\nhttps://c.test/x#y\n")
    assert sorted(r.url for r in web.seeds(spark, f"file://{tmp_path}/seeds").collect()) == ["http://a.test/", "https://c.test/x"]
    (tmp_path / "c.json").write_text('[{"url": "u", "lang": "en", "title": "t", "body": "b"}]')
    assert web.corpus(spark, f"file://{tmp_path}/c.json").count() == 1
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception, match="bad.json"):
        web.corpus(spark, f"file://{tmp_path}/bad.json").collect()
    shapes = spark.createDataFrame([("b", "2", [1]), ("a", "1", [0, 3])], web.SHAPES)
    web.write_shapes(shapes, f"file://{tmp_path}/shapes")
    assert web.read_shapes(spark, f"file://{tmp_path}/shapes").orderBy("url").collect() == shapes.orderBy("url").collect()


@pytest.mark.parametrize(
    "body, expected",
    [
        ("User-agent: *\nCrawl-delay: 4", 4.0), ("User-agent: *\nDisallow: /", None), ("User-agent: *\nCrawl-delay: 1.25", 1.25), ("User-agent: *\nCrawl-delay: 2e2", 200.0),
        ("User-agent: *\nCrawl-delay: 7s", 7.0), ("User-agent: *\nCrawl-delay: -1", None), ("User-agent: *\nCrawl-delay: soon", None), ("User-agent: *\nCrawl-delay: 2 # why", 2.0),
        ("User-agent: elsewhere\nCrawl-delay: 60.5\nUser-agent: *\nCrawl-delay: 1.5\n\nUser-agent: *\nCrawl-delay: 6.5", 6.5),
        ("User-agent: quarry\nCrawl-delay: 3.5\nUser-agent: *\nCrawl-delay: 0.5", 3.5), ("User-agent: other\nUser-agent: *\nCrawl-delay: 2.5", 2.5),
    ],
)
def test_crawl_delay(body, expected):
    assert robots.crawl_delay(body) == expected


def test_gate(spark):
    urls = [("http://A.test:80/x/1",), ("http://a.test/y",), ("https://a.test/x",), ("http://n.test/",), ("http://e.test/",), ("http://u.test/",)]
    files = [("http://a.test", 200, "User-agent: *\nDisallow: /x\nCrawl-delay: 1.5"), ("https://a.test", 404, None), ("http://n.test", 503, None), ("http://e.test", 200, "")]
    got = {r.url: (r.allowed, r.delay) for r in robots.gated(spark.createDataFrame(urls, "url string"), spark.createDataFrame(files, "base string, status int, body string")).collect()}
    assert [got[u[0]] for u in urls] == [(False, 1.5), (True, 1.5), (True, None), (False, None), (True, None), (False, None)]
    for u in urls:
        assert spark.createDataFrame([u], "u string").select(robots.base_column(F.col("u"))).first()[0] == robots.base(u[0])
    assert not robots.allowed("http://[::1/x", 200, "User-agent: *\nDisallow: /y")
