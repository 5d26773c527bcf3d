"""The stored index: incremental runs, states, queries, snippets and passages."""

from datetime import datetime, timezone

import pyarrow as pa
import pytest

from quarry.operators import index as ix
from quarry.operators.index import SearchIndex
from quarry.sources import warehouse

PAGE = "<title>{}</title><body><p>{}</p></body>"


def at(day, second=0):
    return datetime(2024, 3, day, 0, 0, second, tzinfo=timezone.utc)


def table(spark, rows):
    return spark.createDataFrame([(u, h, s, t) for u, h, s, t in rows], warehouse.PAGES)


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/index"


FIRST = [
    ("http://a.test/1", PAGE.format("Red foxes", "A fox runs. The fox sleeps."), 200, at(1)),
    ("http://a.test/2", PAGE.format("Notes", "Running water and a fox far away in the long valley of many rivers and hills"), 200, at(1)),
    ("http://a.test/3", "<meta name=robots content=noindex>" + PAGE.format("Hidden", "fox"), 200, at(1)),
    ("http://a.test/4", None, 500, at(1)),
    ("http://a.test/5", PAGE.format("김치찌개보관법 냉장", "김치 찌개를 끓인다"), 200, at(1)),
]


def urls(hits):
    return [r.url for r in hits.collect()]


def test_a_first_and_a_second_run(spark, place):
    index = SearchIndex(spark, place)
    assert urls(index.search("fox")) == [] and index.count() == 0  # before the first run
    assert index.build(table(spark, FIRST), at(2)) == 3 and index.count() == 3
    assert urls(index.search("fox")) == ["http://a.test/1", "http://a.test/2"]
    before = index.manifest()
    later = [
        FIRST[0][:1] + (None, 404, at(3)),  # gone: leaves the index
        FIRST[1][:1] + (PAGE.format("Notes", "Nothing but bears"), 200, at(3)),  # replaced
        FIRST[2], FIRST[3],
        FIRST[4][:1] + (None, 500, at(3)),  # no content: stays
        ("http://a.test/6", PAGE.format("New", "fox bear"), 200, at(3)),
    ]
    assert index.build(table(spark, later), at(4)) == 1 and index.count() == 3
    assert urls(index.search("fox")) == ["http://a.test/6"] and urls(index.search("bear")) == ["http://a.test/2", "http://a.test/6"]
    assert urls(index.search("보관법")) == ["http://a.test/5"]
    seqs = {r.url: r.doc_seq for r in index.docs().collect()}
    assert seqs["http://a.test/2"] >= before["next"] and seqs["http://a.test/6"] > seqs["http://a.test/2"]  # replaced ones come first
    size = (index.count(), index.manifest()["tokens"])
    assert size[1] == sum(r.len for r in index.docs().collect())
    same = index.search("bear").collect()
    index.compact()
    assert index.search("bear").collect() == same and (index.count(), index.manifest()["tokens"]) == size and not index.manifest()["gone"]
    assert index.build(table(spark, later), at(5)) == 0 and index.count() == 3  # nothing new, nothing fetched again


def test_pages_that_share_a_url(spark, place):
    """Each is a document, whichever run it came in; a URL fetched again gives its documents anew."""
    index = SearchIndex(spark, place)
    page = lambda u, body, day=1, status=200: (f"http://a.test/{u}", PAGE.format("T", body), status, at(day))
    both = [page(1, "fox"), page(1, "owl"), page(1, "fox"), page(2, "bear"), page(2, "bear"), page(3, "elk"), ("http://a.test/3", "<meta name=robots content=noindex>", 200, at(1))]
    bodies = lambda: sorted((r.url[-1], r.body) for r in index.docs().collect())
    assert index.build(table(spark, [both[1], both[3], both[5]]), at(2)) == 3
    assert index.build(table(spark, both), at(3)) == 3 and index.manifest()["next"] == 6
    assert bodies() == [("1", "fox"), ("1", "fox"), ("1", "owl"), ("2", "bear"), ("2", "bear"), ("3", "elk")] and index.count() == 6
    assert index.build(table(spark, both), at(4)) == 0 and index.manifest()["next"] == 6
    later = [both[0], page(1, "hare", 5), page(1, "gone", 5, 404), *both[3:]]
    index.build(table(spark, later), at(6))
    assert bodies() == [("1", "fox"), ("1", "hare"), ("2", "bear"), ("2", "bear"), ("3", "elk")] and index.count() == 5


def test_postings_leave_in_small_batches(monkeypatch):
    """A task holds few positions at once, however many documents its batch has."""
    monkeypatch.setattr(ix, "HELD", 10)

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    texts = ["a b a", "", None, "b " * 12, "c a", "d e f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(["t"] * 6), pa.array(texts), pa.array([""] * 6), pa.array([None] * 6, pa.string())], names=["doc_seq", *ix.COLUMNS])
    out = list(ix.postings_of(Docs())(iter([batch])))
    got = sorted((r["doc_seq"], r["term"], r["positions"]) for b in out for r in b.to_pylist() if r["col"] == 1)
    assert got == [(0, "a", [0, 2]), (0, "b", [1]), (3, "b", list(range(12))), (4, "a", [1]), (4, "c", [0]), (5, "d", [0]), (5, "e", [1]), (5, "f", [2])]
    assert len(out) > 1 and sum(r["col"] == 0 for b in out for r in b.to_pylist()) == 6


def test_the_second_of_the_start_is_looked_at_again(spark, place):
    index = SearchIndex(spark, place)
    index.build(table(spark, FIRST[:1]), at(2, 7))
    index.build(table(spark, [FIRST[0][:1] + (PAGE.format("Owls", "owl"), 200, at(2, 7))]), at(3))
    assert urls(index.search("owl")) == ["http://a.test/1"] and urls(index.search("fox")) == []


def test_states_come_before_the_query(spark, place, monkeypatch):
    index = SearchIndex(spark, place)
    with pytest.raises(ix.NoCrawlDataError):
        index.build(spark.createDataFrame([("u",)], "url string"))
    index.build(table(spark, FIRST), at(2))
    with pytest.raises(ix.NoCrawlDataError):
        index.passages(None, "fox")
    for query in ("fox", "\x01", "nowhere"):
        with pytest.raises(Exception, match="html"):
            index.passages(spark.createDataFrame([("u",)], "url string"), query)
    monkeypatch.setattr(ix, "FINGERPRINT", "another")
    for query in ("fox", "\x01", ""):
        with pytest.raises(ix.StaleIndexError):
            index.search(query)
    assert index.count() == 0 and index.build(table(spark, FIRST), at(3)) == 3 and urls(index.search("fox"))


def test_a_broken_run_leaves_the_old_index(spark, place, monkeypatch):
    index = SearchIndex(spark, place)
    index.build(table(spark, FIRST), at(2))
    monkeypatch.setattr(SearchIndex, "_lay", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.build(table(spark, [("http://b.test/", PAGE.format("Bats", "bat"), 200, at(3))]), at(4))
    assert index.count() == 3 and urls(index.search("fox")) == ["http://a.test/1", "http://a.test/2"] and urls(index.search("bat")) == []


def test_query_language(spark, place):
    rows = [
        ("http://k.test/1", PAGE.format("올레 길 안내", "걷는 길"), 200, at(1)), ("http://k.test/2", PAGE.format("올레길 지도", "바다"), 200, at(1)),
        ("http://k.test/3", PAGE.format("김치", "배추를 절인다 python"), 200, at(1)), ("http://k.test/4", PAGE.format("", "foo bar foobar-baz qux"), 200, at(1)),
    ]
    index = SearchIndex(spark, place)
    index.build(table(spark, rows), at(2))
    assert sorted(urls(index.search("올레길"))) == sorted(urls(index.search("올레 길"))) == ["http://k.test/1", "http://k.test/2"]
    assert urls(index.search("김치 python")) == urls(index.search("python 김치")) == ["http://k.test/3"]
    assert urls(index.search("foobar-ba")) == ["http://k.test/4"] and urls(index.search("qux-foo")) == []
    assert urls(index.search("fo ba")) == ["http://k.test/4"] and urls(index.search("foo bear")) == []
    for odd in ('"', "a OR b", "NEAR(a b)", "-", "\x00", "foo(bar", "*", ""):
        assert isinstance(urls(index.search(odd)), list)
    many = index.search_many({"x": "foo", "y": "올레길", "z": "!!"}, 1).collect()
    assert sorted(r.q for r in many) == ["x", "y"]
    index.warm()
    assert index.search_many({"x": "foo", "y": "올레길", "z": "!!"}, 1).collect() == many
    index.build(table(spark, [("http://k.test/9", PAGE.format("", "foo foo"), 200, at(3))]), at(4))
    assert urls(index.search("foo"))[0] == "http://k.test/9" or len(urls(index.search("foo"))) == 2  # what is kept is of the old state
    index.cool()
    assert [r.rank for r in index.search("올레길", 1, 1).collect()] == [2] and index.search("올레길", 5, 2).count() == 0
    assert "titles_ng" not in index.search("foo").columns and "title_ng" not in index.search("foo").columns


def test_scores_by_hand(spark, place):
    from math import log

    index = SearchIndex(spark, place)
    words = ["cat", "cat cat dog", "dog owl", "owl elk", "elk ant"]
    index.build(table(spark, [(f"http://s.test/{i}", f"<p>{w}</p>", 200, at(1)) for i, w in enumerate(words)]), at(2))
    mean = sum(len(w.split()) for w in words) / 5
    idf = log((5 - 2 + 0.5) / (2 + 0.5))
    score = lambda f, n: round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)), 6)
    assert [(r.url[-1], r.score) for r in index.search("cat").collect()] == sorted([("0", score(1, 1)), ("1", score(2, 3))], key=lambda x: -x[1])


def test_snippets(spark, place):
    body = " ".join(f"w{i}" for i in range(60)) + " needle " + " ".join(f"v{i}" for i in range(60))
    index = SearchIndex(spark, place)
    index.build(table(spark, [("http://n.test/1", PAGE.format("A heading", body), 200, at(1)), ("http://n.test/2", PAGE.format("Needles", "x needle"), 200, at(1))]), at(2))
    got = {r.url[-1]: r.snippet for r in index.search("needle").collect()}
    assert got["2"] == "Needles" and got["1"].startswith("…") and got["1"].endswith("…") and " needle " in got["1"]
    assert len(got["1"].strip("…").split()) == 20
    assert ix.snippet("one two", [(["three"], True)]) == ("one two", False) and ix.snippet("", []) == ("", False)


def test_passages(spark, place):
    pages = table(spark, [
        ("http://p.test/1", "<title>fox</title><p>no match here</p>", 200, at(1)),
        ("http://p.test/2", "<p hidden>fox fox fox</p><p></p><p>one fox</p><p>another fox and more text</p>", 200, at(1)),
        ("http://p.test/3", "<i></i>" * 3000 + "<p>a fox too far down</p>", 200, at(1)),
    ])
    index = SearchIndex(spark, place)
    index.build(pages, at(2))
    got = [(r.url[-1], r.position, r.text) for r in index.passages(pages, "fox").collect()]
    assert got == [("2", 1, "another fox and more text")] and len(urls(index.search("fox"))) == 3
    assert index.passages(pages, "\x01").count() == 0


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    with pytest.raises(warehouse.WarehouseMissing):
        warehouse.Snapshots.opened(spark, path)
    assert not (tmp_path / "w").exists()
    store = warehouse.create(spark, path)
    assert store.read("pages").count() == 0 and warehouse.create(spark, path).current() == store.current()
    store.write(pages=table(spark, FIRST), queue=store.read("queue"))
    assert store.has("pages") and not store.has("other") and store.sweep() == 1
    pages = store.read("pages")
    assert warehouse.get_html(pages, "http://a.test/1") == FIRST[0][1] and warehouse.get_html(pages, "http://x/") is None
    assert warehouse.known(pages, spark.createDataFrame([("http://a.test/4",), ("http://x/",)], "url string")).count() == 1


def test_mixed_storage(spark):
    import zlib

    rows = [(zlib.compress("<p>é</p>".encode(), 6),), ("<p>plain</p>".encode(),), (None,)]
    assert [r.html for r in warehouse.inflated(spark.createDataFrame(rows, "html binary")).collect()] == ["<p>é</p>", "<p>plain</p>", None]
