"""The stored inverted index: incremental build, queries in batches, hits with snippets, passages.

Layout under one folder: segments, each with docs and postings, and gone, the sequence numbers that a later run took
out; and one manifest, which is replaced in a single step at the end of a run. A run costs what changed, not what is
stored; compact() folds the segments together. Postings are sorted by term and number, so a term or prefix reads the
row groups that may hold it, and a term of very many documents lies in several files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.html import clip, extract_blocks, extract_text, is_noindex, noindex_udf, pieces
from quarry.functions.text import bigrams, bigrams_column, cleaned, query_terms, snippet, tokens
from quarry.operators.search import best_passage, bm25, needles
from quarry.sources.storage import Folder
from quarry.sources.warehouse import GONE

COLUMNS = ("title", "body", "title_ng", "body_ng")
DOCS = "doc_seq long, url string, title string, body string, title_ng string, body_ng string, len long"
POSTINGS = "term string, col int, doc_seq long, positions array<int>"
HIT = "rank int, doc_seq long, url string, title string, snippet string, score double"
PASSAGE = "rank int, url string, title string, position int, text string"
#: Changes with anything that decides what a term is or where it is stored.
FINGERPRINT = hashlib.sha256(f"{DOCS}|{POSTINGS}|{COLUMNS}|folded, stemmed, Hangul 2-grams".encode()).hexdigest()


class StaleIndexError(RuntimeError):
    """The index was built under another definition; building it again mends that."""


class NoCrawlDataError(RuntimeError):
    """There is no table of pages."""


_PAGE = pa.struct([("noindex", pa.bool_()), ("title", pa.string()), ("body", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("noindex", T.BooleanType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def page_udf(html: pa.Array) -> pa.Array:
    """All that a page gives the index, in one pass through Python."""
    one = lambda h: dict(zip(("noindex", "title", "body"), (True, None, None) if is_noindex(h) else (False, *extract_text(h))))
    return pa.concat_arrays([pa.array(map(one, part), _PAGE) for (part,) in pieces(html)])


#: Positions of the postings that a task holds at once, beyond those of one document.
HELD = 100_000


def postings_of(docs: DataFrame) -> DataFrame:
    """term, col, doc_seq and positions: made document by document, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[str] = []
        cols, seqs, ends, flat = array("i"), array("q"), array("i", [0]), array("i")

        def taken() -> pa.RecordBatch:
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            done = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(cols, pa.int32()), pa.array(seqs, pa.int64()), positions], names=["term", "col", "doc_seq", "positions"])
            terms.clear()
            del cols[:], seqs[:], ends[1:], flat[:]
            return done

        for batch in batches:
            for group in pieces(batch["body"], batch["doc_seq"], batch["title"], batch["title_ng"], batch["body_ng"]):
                for body, seq, title, title_ng, body_ng in zip(*group):
                    for col, text in enumerate((title, body, title_ng, body_ng)):
                        places: dict[str, list[int]] = {}
                        for i, t in enumerate(tokens(text or "")):
                            places.setdefault(t, []).append(i)
                        for t, p in places.items():
                            terms.append(t), cols.append(col), seqs.append(seq), flat.extend(p), ends.append(len(flat))
                    if len(flat) > HELD:
                        yield taken()
        yield taken()

    return docs.select("doc_seq", *COLUMNS).mapInArrow(run, POSTINGS)


def _local(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows as part of the plan itself: no job is needed to broadcast them."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns.items())}))


def compiled(query: str) -> list[tuple[int, list[str], bool, list[int] | None]]:
    """The phrases of a query: (term number, tokens, whether the last is a prefix, columns or None for all).

    A term matches by its own tokens or, for Hangul, by its 2-grams in the title or the body; the 2-gram columns are two
    phrases, not one, since each has a weight of its own.
    """
    out = []
    for i, word in enumerate(w for w in cleaned(query).split() if query_terms(w)):
        out.append((i, query_terms(word)[0], True, None))
        if grams := bigrams(word).split():
            out += [(i, grams, False, [c]) for c in (2, 3)]
    return out


def matched(postings: DataFrame, queries: dict[str, str], key: str = "doc_seq") -> DataFrame:
    """q, t, p, key and f for every phrase p of every query's term t: all queries in one pass over the postings.

    queries: text by name. What is broadcast is made of these texts, never of the data.
    """
    elements = []
    p = 0
    for q, text in queries.items():
        for t, terms, prefix, cols in compiled(text):
            for k, token in enumerate(terms):
                elements.append((q, t, p, k, len(terms), token, prefix and k == len(terms) - 1, -1 if cols is None else cols[0]))
            p += 1
    spark = postings.sparkSession
    n = pa.int32()
    kinds = {"q": pa.string(), "t": n, "p": n, "k": n, "n": n, "token": pa.string(), "prefix": pa.bool_(), "only": n}
    each = []
    for width in (0, 1, 2):  # exact tokens, and prefixes by their first one or two characters
        mine = [e for e in elements if (min(2, len(e[5])) if e[6] else 0) == width]
        if not mine:
            continue
        few = F.broadcast(_local(spark, mine, **kinds))
        found = postings
        if len(mine) <= 64:  # the scan skips the row groups that hold none of them
            found = found.where(reduce(lambda a, b: a | b, [F.col("term").startswith(e[5]) if width else F.col("term") == e[5] for e in mine]))
        on = F.col("term") == F.col("token") if not width else (F.substring("term", 1, width) == F.substring("token", 1, width)) & F.col("term").startswith(F.col("token"))
        each.append(found.join(few, on & ((F.col("only") < 0) | (F.col("only") == F.col("col")))))
    if not each:
        return spark.createDataFrame([], f"q string, t int, p int, {key} long, f long")
    hits = reduce(DataFrame.union, each)
    single = hits.where("n = 1").groupBy("q", "t", "p", key).agg(F.sum(F.size("positions")).cast("long").alias("f"))
    if all(e[4] == 1 for e in elements):
        return single
    starts = hits.where("n > 1").select("q", "t", "p", "k", "n", key, "col", F.explode("positions").alias("pos"))
    whole = starts.groupBy("q", "t", "p", "n", key, "col", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("c")).where("c = n")
    return single.union(whole.groupBy("q", "t", "p", key).agg(F.count("*").alias("f")))


def ranked(hits: DataFrame, lengths: DataFrame, n_docs: int, mean: float, n_terms: dict[str, int], limit: int, offset: int = 0, key: str = "doc_seq") -> DataFrame:
    """q, rank, key and score: documents in which all terms match, best first, then the smaller key."""
    spark = hits.sparkSession
    df = hits.groupBy("p").agg(F.count("*").alias("df"))  # a row for each phrase of the queries
    wanted = _local(spark, list(n_terms.items()), q=pa.string(), terms=pa.int32())
    scored = hits.join(F.broadcast(df), "p").join(lengths, key)
    scored = scored.withColumn("s", bm25(F.col("f"), F.lit(n_docs), F.col("df"), F.col("len"), F.lit(mean)))
    each = scored.groupBy("q", key).agg(F.round(F.sum("s"), 6).alias("score"), F.count_distinct("t").alias("n"))
    each = each.join(F.broadcast(wanted), "q").where(F.col("n") == F.col("terms"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), key))
    return each.withColumn("rank", place).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).select("q", "rank", key, "score")


class SearchIndex:
    """An index in a folder. Opening creates nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self._held: tuple | None = None

    # -- state ------------------------------------------------------------------------------------------------------

    def manifest(self) -> dict | None:
        return json.loads(self.folder.read("_MANIFEST")) if self.folder.exists("_MANIFEST") else None

    def _table(self, manifest: dict, table: str, schema: str) -> DataFrame:
        names = [f"{self.folder.path}/{s}/{table}" for s in manifest["segments"]]
        if not names:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).parquet(*names)
        if not manifest["gone"]:
            return found
        gone = self.spark.read.schema("doc_seq long").parquet(*[f"{self.folder.path}/{s}/gone" for s in manifest["gone"]])
        return found.join(gone, "doc_seq", "left_anti").select(*found.columns)

    def _ready(self) -> dict | None:
        """The manifest; None before the first build. Comes before any look at a query: a state is a state for all."""
        found = self.manifest()
        if found and found["fingerprint"] != FINGERPRINT:
            raise StaleIndexError(self.folder.path)
        return found

    def docs(self) -> DataFrame:
        found = self._ready()
        return self._table(found, "docs", DOCS) if found else self.spark.createDataFrame([], DOCS)

    def postings(self) -> DataFrame:
        found = self._ready()
        return self._table(found, "postings", POSTINGS) if found else self.spark.createDataFrame([], POSTINGS)

    def count(self) -> int:
        """Documents of a usable index; 0 where there is none or a stale one."""
        found = self.manifest()
        return found["n_docs"] if found and found["fingerprint"] == FINGERPRINT else 0

    # -- build ------------------------------------------------------------------------------------------------------

    def build(self, pages: DataFrame, now: datetime | None = None) -> int:
        """Brings the index up to date with pages (url, html, status, fetched_at); the number of new documents.

        A document whose page was fetched since the last run's start is taken out if the page is gone or refuses to be
        indexed, kept if the page has no content, and replaced otherwise. Nothing is visible before the manifest is.
        Fetching times count in seconds, and the second of the start is looked at twice rather than never.
        """
        if not {"url", "html", "status", "fetched_at"} <= set(pages.columns):
            raise NoCrawlDataError(f"no url, html, status and fetched_at in {pages.columns}")
        started = (now or datetime.now(timezone.utc)).astimezone(timezone.utc).replace(microsecond=0)
        old = self.manifest()
        if old is None or old["fingerprint"] != FINGERPRINT:
            old = {"segments": [], "gone": [], "mark": None, "n_docs": 0, "tokens": 0, "next": 0}
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.folder.path}/{name}"
        have = self._table(old, "docs", DOCS).select("doc_seq", "url", "len")
        columns = [F.col("fetched_at"), F.col("url"), F.col("html")]
        full = pages.where("html IS NOT NULL")
        work = full.join(have, "url", "left_anti").select(F.lit(1).alias("kind"), *columns)
        gone = None
        if old["segments"]:
            since = pages if old["mark"] is None else pages.where(F.col("fetched_at") >= F.lit(old["mark"]).cast("timestamp"))
            if old["mark"] is None:
                touched = since.where("html IS NOT NULL").where(noindex_udf("html")).select("url").distinct()
            else:
                dead = F.col("status").isin(*GONE)
                touched = since.where(dead | F.col("html").isNotNull()).select("url").distinct()
                late = F.coalesce(F.col("fetched_at") >= F.lit(old["mark"]).cast("timestamp"), F.lit(False))
                again = full.where(~(dead & late)).join(touched, "url", "left_semi").join(have, "url", "left_semi")
                work = work.union(again.select(F.lit(0).alias("kind"), *columns))
            work = work.union(self._beside(old, full.join(touched, "url", "left_anti"), have).select(F.lit(1).alias("kind"), *columns))
            gone = have.join(touched, "url", "left_semi")
            gone.select("doc_seq", "len").write.parquet(f"{at}/gone")
        read = work.withColumn("x", page_udf("html")).where("NOT x.noindex").select("kind", "fetched_at", "url", "x.title", "x.body")
        sorted_ = read.orderBy("kind", "fetched_at", "url").withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id())
        sorted_.write.parquet(f"{at}/staged")
        staged = self.spark.read.parquet(f"{at}/staged")
        # A number for each partition: as many rows as the sort has partitions.
        sizes = staged.groupBy("part").agg(F.count("*").alias("n"), F.min("local").alias("first"), F.count_if(F.col("kind") == 1).alias("new")).orderBy("part").collect()
        base, at_seq = [], old["next"]
        for r in sizes:
            base.append((r["part"], at_seq - r["first"]))
            at_seq += r["n"]
        shift = F.broadcast(self.spark.createDataFrame(base or [(0, 0)], "part int, shift long"))
        docs = staged.join(shift, "part").withColumn("doc_seq", F.col("local") + F.col("shift"))
        docs = docs.withColumn("title_ng", bigrams_column(F.col("title"))).withColumn("body_ng", bigrams_column(F.col("body")))
        size = sum((F.size(F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))) for c in COLUMNS[1:]), F.size(F.regexp_extract_all(F.col("title"), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))))
        docs = docs.select("doc_seq", "url", *COLUMNS, size.cast("long").alias("len"))
        docs.write.parquet(f"{at}/docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{at}/docs")
        self._lay(postings_of(docs), f"{at}/postings")
        self.folder.delete(f"{name}/staged")
        added = docs.agg(F.count("*").alias("n"), F.sum("len").alias("len")).first()
        out = self.spark.read.parquet(f"{at}/gone").agg(F.count("*").alias("n"), F.sum("len").alias("len")).first() if gone is not None else None
        lost = (out["n"], out["len"] or 0) if out else (0, 0)
        fresh = {
            "fingerprint": FINGERPRINT, "mark": started.strftime("%Y-%m-%d %H:%M:%S"), "segments": [*old["segments"], *[name] * bool(added["n"])],
            "gone": [*old["gone"], *[name] * bool(lost[0])], "n_docs": old["n_docs"] + added["n"] - lost[0], "tokens": old["tokens"] + (added["len"] or 0) - lost[1], "next": at_seq,
        }
        self.folder.replace("_MANIFEST", json.dumps(fresh))
        return sum(r["new"] for r in sizes)

    def _beside(self, old: dict, pages: DataFrame, have: DataFrame) -> DataFrame:
        """The pages that share their URL with documents of the index and aren't among those: of a URL with n pages and k
        documents n - k, those of other contents first. Only URLs of several pages are looked at."""
        n = pages.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")
        more = have.join(n, "url", "left_semi").groupBy("url").agg(F.count("*").alias("k")).join(n, "url").where("n > k").select("url", "k")
        text = F.sha2(F.concat_ws("\n", "title", "body"), 256)
        known = self._table(old, "docs", DOCS).join(more, "url", "left_semi").groupBy("url", text.alias("text")).agg(F.count("*").alias("c"))
        read = pages.select("url", "html", "fetched_at").join(more, "url").withColumn("x", page_udf("html")).where("NOT x.noindex").select("*", "x.title", "x.body").withColumn("text", text)
        same = read.withColumn("i", F.row_number().over(Window.partitionBy("url", "text").orderBy("fetched_at", F.md5("html")))).join(known, ["url", "text"], "left")
        other = (F.col("i") > F.coalesce("c", F.lit(0))).cast("int")
        place = F.row_number().over(Window.partitionBy("url").orderBy(other, "fetched_at", F.md5("html")))
        return same.withColumn("place", place).where("place > k")

    @staticmethod
    def _lay(postings: DataFrame, path: str) -> None:
        postings.repartitionByRange("term", "doc_seq").sortWithinPartitions("term", "col", "doc_seq").write.parquet(path)

    def compact(self) -> None:
        """One segment instead of many, without what is gone; the folders of old segments are removed afterwards."""
        old = self._ready()
        if not old:
            return
        name = f"s-{uuid.uuid4().hex}"
        self._table(old, "docs", DOCS).write.parquet(f"{self.folder.path}/{name}/docs")
        self._lay(self._table(old, "postings", POSTINGS), f"{self.folder.path}/{name}/postings")
        self.folder.replace("_MANIFEST", json.dumps(old | {"segments": [name], "gone": []}))
        for s in {*old["segments"], *old["gone"]}:
            self.folder.delete(s)

    # -- queries ----------------------------------------------------------------------------------------------------

    def warm(self) -> None:
        """Keeps the postings and the lengths of the present index on the executors, for many single queries; what
        doesn't fit in memory stays on their disks."""
        self.cool()
        if found := self._ready():
            tables = self.postings().persist(), self.docs().select("doc_seq", "len").persist()
            for t in tables:
                t.count()
            self._held = (found["segments"], found["gone"], *tables)

    def cool(self) -> None:
        if self._held:
            for t in self._held[2:]:
                t.unpersist()
            self._held = None

    def _read(self, found: dict) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths: the kept ones, if the index is still the one they are of."""
        if self._held and self._held[:2] == (found["segments"], found["gone"]):
            return self._held[2:]
        return self._table(found, "postings", POSTINGS), self._table(found, "docs", DOCS).select("doc_seq", "len")

    def search_many(self, queries: dict[str, str], limit: int = 10, offset: int = 0) -> DataFrame:
        """q, rank, doc_seq and score for all queries in one job."""
        found = self._ready()
        n_terms = {q: n for q, text in queries.items() if (n := len({t for t, *_ in compiled(text)}))}
        if not found or not n_terms or not found["n_docs"]:
            return self.spark.createDataFrame([], "q string, rank int, doc_seq long, score double")
        postings, lengths = self._read(found)
        hits = matched(postings, {q: queries[q] for q in n_terms})
        return ranked(hits, lengths, found["n_docs"], found["tokens"] / found["n_docs"], n_terms, limit, offset)

    def search(self, query: str, limit: int = 10, offset: int = 0) -> DataFrame:
        """rank, doc_seq, url, title, snippet and score: one page of hits. The snippet comes from the title where that
        matches, else from the body; it is made for the rows of the page only."""
        top = self.search_many({"q": query}, limit, offset).drop("q")
        wanted = [(terms, prefix) for _, terms, prefix, only in compiled(query) if only is None]

        @F.pandas_udf("string")
        def shown(title: pd.Series, body: pd.Series) -> pd.Series:
            def one(t: str, b: str) -> str:
                head, hit = snippet(t or "", wanted)
                return head if hit else snippet(b or "", wanted)[0] or head

            return pd.Series([one(t, b) for t, b in zip(title, body)], dtype=object)

        hits = F.broadcast(top).join(self.docs(), "doc_seq")  # a page of hits at most
        return hits.select("rank", "doc_seq", "url", "title", shown("title", "body").alias("snippet"), "score").orderBy("rank")

    def passages(self, pages: DataFrame | None, query: str, limit: int = 10) -> DataFrame:
        """rank, url, title, position and text: the best block of each of the first `limit` hits that has one."""
        hits = self.search(query, limit).select("rank", "url", "title")
        if pages is None:
            raise NoCrawlDataError(self.folder.path)
        pages = pages.select("url", "html")  # fails here, for every query alike, if a column is missing

        @F.pandas_udf("array<struct<position:int,text:string>>")
        def clipped_blocks(html: pd.Series) -> pd.Series:
            return html.map(lambda h: [{"position": i, "text": x} for i, (_, x) in enumerate(extract_blocks(clip(h)))])

        found = F.broadcast(hits).join(pages.where("html IS NOT NULL AND html <> ''"), "url")
        blocks = found.select("rank", "url", "title", F.explode(clipped_blocks("html")).alias("b")).select("rank", "url", "title", "b.*")
        wanted = needles(query)
        if not wanted:
            return self.spark.createDataFrame([], PASSAGE)
        return best_passage(blocks, wanted, "rank").select("rank", "url", "title", "position", "text").orderBy("rank")
