"""Removal of line chunks that occur elsewhere, in SQL expressions.

A text's lines are hashed; a rolling hash r(i) covers lines i and i + 1. A chunk begins at line 0 and at each line
whose r is smaller than both neighbours, so a boundary depends on four lines only and an insertion moves no boundary
further on. Chunks of two or more lines with a word, and of min_words words, that occur twice or more are removed from
all places but the first in the order of (doc_id, line).

Occurrences are counted by grouping on the chunk's bytes themselves, after partial aggregation in each input
partition: a chunk that a third of all documents share costs one row per partition. What goes back to the documents is
the 128-bit hash, and only where all chunks under it proved byte-equal: should two byte sequences ever share a hash,
both stay, so nothing is removed unless its bytes were compared. On the way back a hot chunk is split over SALTS tasks.

That rule, which ORACLE states, sees a short passage only where its foreign neighbours happen to cut it off. passages()
looks at every place instead: from each line with a word on, and back from it, the shortest stretch of two or more
such lines and min_words words. Each passage of that size is covered by stretches inside it, whatever surrounds it.
Stretches are counted and compared in the same way; all places but the first go, except for lines that lie in the
first place of another repeated stretch, so whatever goes is still whole somewhere. cleaned() works by passages().

Null and empty texts have one empty line, which is never a chunk. A null doc_id counts as the smallest. Rows that
repeat both doc_id and text are one document and get one result. Other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import computed, text_hash, written
from quarry.llm.model_text import texts

_WORD = r"[^\x20\x09-\x0D]"
#: A chunk with more than one in HOT of all occurrences is split over SALTS tasks where it goes back to its documents.
HOT, SALTS = 10_000, 64


def chunk_starts(lines: Column, rolling: Column) -> Column:
    """0 and each i with r(i) below r(i - 1) and r(i + 1)."""
    n = F.size(lines)
    inner = F.when(
        n >= 4,
        F.filter(
            F.sequence(F.lit(1), n - 3),
            lambda i: (F.get(rolling, i) < F.get(rolling, i - 1)) & (F.get(rolling, i) < F.get(rolling, i + 1)),
        ),
    ).otherwise(F.expr("cast(array() as array<int>)"))
    return F.concat(F.array(F.lit(0)), inner)


def chunks(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, and pieces: an array of (start, n_lines, text, ok)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.split(text, "\n", -1).alias("lines"))
    step = step.withColumn("h", F.transform("lines", lambda x: F.md5(x.cast("binary"))))
    h = F.col("h")
    step = step.withColumn(
        "r",
        F.when(
            F.size(h) >= 2,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - 2),
                lambda i: F.md5(F.concat(F.get(h, i), F.get(h, i + 1)).cast("binary")),
            ),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    )
    step = step.select("doc_id", "th", "lines", chunk_starts(F.col("lines"), F.col("r")).alias("s"))
    s, lines = F.col("s"), F.col("lines")

    def piece(i: Column, j: Column) -> Column:
        n = F.coalesce(F.get(s, j + 1), F.size(lines)) - i
        own = F.slice(lines, i + 1, n)
        return F.struct(
            i.alias("start"),
            n.alias("n_lines"),
            F.array_join(own, "\n").alias("text"),
            F.size(F.filter(own, lambda x: x.rlike(_WORD))).alias("solid"),
        )

    pieces = F.transform(s, piece)
    return step.select("doc_id", "th", F.size(lines).alias("n_lines"), pieces.alias("pieces"), F.lit(min_words).alias("m"))


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each chunk that may go: doc_id, th, start, n_lines, chunk and its hash.

    explode_outer, since for explode the optimiser adds a filter on size(pieces), and unfolds all of pieces in it.
    """
    each = chunks(docs, min_words).select("doc_id", "th", F.explode_outer("pieces").alias("p")).where("p.solid >= 2")
    each = each.where(F.regexp_count("p.text", F.lit(_WORD + "+")) >= min_words)
    return each.select(
        "doc_id", "th", "p.start", "p.n_lines", F.col("p.text").alias("chunk"), F.unhex(F.md5(F.col("p.text").cast("binary"))).alias("h")
    )


def known_firsts(found: DataFrame) -> DataFrame:
    """h, first and n of the chunks that occur twice or more, written; found: h, chunk, doc_id, th, start.

    Only hashes whose chunks are all equal byte by byte are known.
    """
    by_bytes = found.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("first"))
    by_hash = by_bytes.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return written(by_hash.where((F.col("texts") == 1) & (F.col("n") > 1)).select("h", "first", "n"), "chunks")


def with_firsts(found: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """found with `first`, where its h is known. A hash with over 1/hot of all occurrences goes to SALTS tasks."""
    total = known.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > total // hot
    # Each holds more than 1/hot of all occurrences, so there are fewer than hot of them: a proven bound.
    marks = F.broadcast(known.where(many).select("h", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    spread = known.select("h", "first", F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    return found.join(marks, "h", "left").withColumn("salt", salt).drop("hot").join(spread, ["h", "salt"]).drop("salt")


def repeats(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, th, and gone: the (start, n_lines) of a document's chunks that are removed."""
    found = occurrences(docs, min_words)
    mine = F.struct("doc_id", "th", "start")
    gone = with_firsts(found.drop("chunk"), known_firsts(found)).where(~mine.eqNullSafe(F.col("first")))
    cols = ["doc_id", "th", "start", "n_lines"]
    return gone.select(*cols).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n_lines")).alias("gone"))


def stretches(lines: list[bytes], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest stretches of two or more lines with a word and of min_words words, from and to each line."""
    words = [len(x.split()) for x in lines]  # bytes are split at exactly what _WORD leaves out
    solid = [i for i, n in enumerate(words) if n]
    upto = [0, *accumulate(words[i] for i in solid)]
    found: dict[tuple[int, int], None] = {}
    for k in range(len(solid)):
        m = k + 1
        while m < len(solid) and upto[m + 1] - upto[k] < min_words:
            m += 1
        if m < len(solid):
            found[solid[k], solid[m]] = None
        m = k - 1
        while m >= 0 and upto[k + 1] - upto[m] < min_words:
            m -= 1
        if m >= 0:
            found[solid[m], solid[k]] = None
    return list(found)


def _places(docs: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """One row for each stretch: doc_id, th, start, n_lines, h, and with whole its bytes (chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())[: 5 + whole]
        for batch, own in texts(batches, 2 << 20):
            cols: list[list] = [[] for _ in kinds]
            for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), own):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                for a, b in stretches(lines, min_words):
                    chunk = b"\n".join(lines[a : b + 1])
                    for c, v in zip(cols, (doc, th, a, b + 1 - a, hashlib.md5(chunk).digest(), chunk)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "th", "start", "n_lines", "h", "chunk"][: len(kinds)])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(F.col("text")).cast("long").alias("th"))
    return narrow.mapInArrow(run, "doc_id long, th long, start int, n_lines int, h binary" + ", chunk binary" * whole)


def passages(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, th, gone: the (start, n_lines) of a document's stretches that came before, and kept: those that are the first."""
    mine = F.struct("doc_id", "th", "start")
    each = with_firsts(_places(docs, min_words, False), known_firsts(_places(docs, min_words, True))).select("doc_id", "th", mine.eqNullSafe(F.col("first")).alias("is_first"), F.struct("start", "n_lines").alias("p"))
    each = each.groupBy("doc_id", "th").agg(  # bounded by the document's lines
        F.collect_set(F.when(~F.col("is_first"), F.col("p"))).alias("gone"), F.collect_set(F.when(F.col("is_first"), F.col("p"))).alias("kept")
    )
    return each.where(F.size("gone") > 0)


def _lines_of(pieces: Column) -> Column:
    return F.flatten(F.transform(pieces, lambda g: F.sequence(g["start"], g["start"] + g["n_lines"] - 1)))


def apply(docs: DataFrame, min_words: int = 8, everywhere: bool = False) -> DataFrame:
    """Per input row: row (all its columns), clean_text, n_lines, n_removed_chunks and n_removed_lines. everywhere: by
    passages() instead of repeats()."""
    gone = passages(docs, min_words) if everywhere else repeats(docs, min_words)
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"),
        text_hash(F.col("text")).alias("th"),
    )
    joined = left.join(gone, left["doc_id"].eqNullSafe(gone["doc_id"]) & (left["th"] == gone["th"]), "left").select("row", "gone", *["kept"] * everywhere)
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)
    joined = joined.select("row", "gone", *["kept"] * everywhere, lines.alias("lines"))
    cut = F.array_except(_lines_of(F.col("gone")), _lines_of(F.col("kept"))) if everywhere else _lines_of(F.col("gone"))
    joined = joined.select("row", "gone", "lines", cut.alias("cut"))
    left_over = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    clean = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(left_over, lambda i: F.get("lines", i)), "\n")
    )
    return joined.select(
        "row",
        clean.alias("clean_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )


def digests(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """doc_id, the counts, and the SHA-256 of what remains, for every row of documents."""
    return apply(docs, min_words).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed_chunks", "n_removed_lines",
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The documents without their repeated passages; one that had text and has none left is gone as well."""
    new = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed_lines") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    out = computed(apply(docs, min_words, everywhere=True)).where((F.col("n_removed_lines") == 0) | F.col("clean_text").rlike(_WORD))
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT rid, doc_id, ls, list_transform(ls, lambda x: md5(x)) AS h FROM d),
r AS (SELECT rid, doc_id, ls, len(ls) AS n, list_transform(range(1, len(h)), lambda i: md5(h[i] || h[i+1])) AS r FROM h),
s AS (SELECT rid, doc_id, ls, n, list_concat([0], list_filter(range(1, n - 2), lambda i: r[i+1] < r[i] AND r[i+1] < r[i+2])) AS s FROM r),
p AS (SELECT rid, doc_id, ls, a AS start, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), n) AS stop
      FROM (SELECT rid, doc_id, ls, n, unnest(s) AS a FROM s)),
c AS (SELECT rid, doc_id, start, stop, array_to_string(ls[start+1:stop], chr(10)) AS chunk,
        len(list_filter(ls[start+1:stop], lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS solid FROM p),
e AS (SELECT *, solid >= 2 AND len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) >= 8 AS ok FROM c),
g AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok, chunk ORDER BY doc_id, start) > 1 AS gone FROM e)
SELECT doc_id, max(stop)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_removed_chunks,
  coalesce(sum(stop - start) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY rid, doc_id
"""
