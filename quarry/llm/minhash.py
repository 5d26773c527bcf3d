"""Near-duplicates: MinHash signatures, banding, verification on full sets, and connected components.

A document's set holds its distinct word shingles (ASCII letters lower-cased; words split at white space; a shorter
text is one shingle; a text without words has the empty set and links with nothing). Documents link when the Jaccard
similarity of their full sets reaches the threshold.

1. Signatures: HASHES minima under universal hash functions, in bands of ROWS minima. At 0.8 a pair shares no bucket
   with a probability of 5e-6, above it less. Documents with equal sets become one class at once, by grouping on a
   128-bit digest of the set, so copies never meet in pairs.
2. Star pass: in each bucket every class is paired with the smallest one only. Pairs whose sizes or signatures are too
   far apart are left out (six standard deviations below the threshold), the rest are compared on full sets, and
   components are formed.
3. Rest pass: buckets that still hold several components are swept; pairs of different components whose signatures are
   near enough are compared on full sets as well. So every link between two texts that share a bucket either is verified
   or joins a component that already holds both ends: none is lost. A bucket is swept by size: partners lie in the same
   range of set sizes or the next. A range of over SWEPT classes is dealt out to parts, and each pair of parts is a
   group of its own, so no task holds more than two parts, however hot a bucket is. A bitmap of each set bounds a
   pair's similarity from above: a bit that one has and the other has not is a shingle that they don't share. Pairs
   whose bound is below the threshold aren't compared; else a family of texts that nearly reach it, each at places of
   its own, would bring a number of texts that is quadratic in its size.
4. Components: alternating large-star and small-star steps until the edges no longer change.

A class that is compared with many gets its comparisons split over tasks, with a copy of its text in each. Null doc_id:
the row keeps its counts, is never linked, and stays (component_id null). Rows with the same doc_id and different texts
belong to the component of each. Ties don't arise: the smallest doc_id names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_hash, written
from quarry.llm.model_text import texts

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Comparisons of one class that a task takes before they are split.
PER_TASK = 512
#: Bits of a set's bitmap for each of its shingles, before rounding up to a power of two, and the most bytes of a bitmap.
BITS, WIDEST = 8, 1 << 14
#: Classes of one bucket and size range that a task of the rest pass compares with as many others.
SWEPT = 2048
_rng = np.random.default_rng(20240201)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_W = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_P = np.cumprod(np.full(1024, 0x5851F42D4C957F2D, dtype=np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * _MIX


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters lower-cased."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    b = np.where((b >= 65) & (b <= 90), b | 32, b)
    solid = np.flatnonzero(~((b == 32) | ((b >= 9) & (b <= 13))))
    if not len(solid):
        return np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.flatnonzero(np.diff(solid) > 1) + 1))
    size = np.diff(np.append(at, len(solid)))
    place = np.arange(len(solid)) - np.repeat(at, size)
    if size.max() > len(_P):  # a very long word: blocks, so that no place is used twice
        block = _P[place % len(_P)] ^ _mixed((place // len(_P)).astype(np.uint64))
    else:
        block = _P[place]
    return _mixed(np.add.reduceat((b[solid].astype(np.uint64) + np.uint64(1)) * block, at) + size.astype(np.uint64))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - width + 1 + k]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        out = np.minimum(out, (_A[:, None] * x[None, k : k + 2048] + _B[:, None]).min(axis=1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed((sig.reshape(BANDS, ROWS).astype(np.uint64) * _W).sum(axis=1) + _BAND).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, at the low bits of its hash; a larger bitmap, folded, is the smaller one of the same set."""
    size = min(WIDEST, 1 << (max(8, len(s) * BITS // 8) - 1).bit_length())
    bits = np.zeros(size * 8, np.uint8)
    bits[(s & np.uint64(size * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(b: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th, n_shingles, node (digest of the set, null if empty), keys of the bands and the sketch: 8 bits a minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches):
            n, node, keys, sketch = [], [], [], []
            for t in own:
                s = shingles(t, width)
                n.append(len(s))
                if not len(s):
                    node.append(None), keys.append(None), sketch.append(None)
                    continue
                sig = signature(s)
                node.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(bands(sig))
                sketch.append((sig >> np.uint32(3)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["th"], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "th", "n_shingles", "node", "keys", "sketch"],
            )

    narrow = docs.select("doc_id", "text", text_hash(F.col("text")).cast("long").alias("th"))
    return narrow.mapInArrow(run, "doc_id long, th long, n_shingles long, node binary, keys array<long>, sketch binary")


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for all nodes of links (a, b): alternating large-star and small-star."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def verified(pairs: DataFrame, node_texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are near and whose full sets are similar enough. node_texts: node, sketch, text."""
    least = _least_agreement(percent)
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("deg")), "a")
    salted = sized.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / PER_TASK)).alias("salt"))
    heads = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("binary").alias("b"), F.col("a").alias("node"))
    wanted = salted.select("a", "salt", "b", F.col("b").alias("node")).union(heads)
    laid = wanted.join(node_texts, "node").select("a", "salt", "b", "sketch", "text")
    laid = laid.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, near, mine = None, None, None
        for batch, own in texts(batches):
            a_out, b_out = [], []
            for a, b, sketch, text in zip(*(batch[c].to_pylist() for c in ("a", "b", "sketch")), own):
                sketch = np.frombuffer(sketch, np.uint8)
                if b is None:
                    head, near, mine = a, sketch, shingles(text, width)
                    continue
                assert a == head
                if (near == sketch).sum() < least:
                    continue
                s = shingles(text, width)
                common = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * common >= percent * (len(mine) + len(s) - common):
                    a_out.append(a), b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])

    return laid.mapInArrow(run, "a binary, b binary")


def _least_agreement(percent: int) -> int:
    """Six standard deviations below what sets at the threshold agree in."""
    p = percent / 100
    return int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)


def bitmaps(nodes: DataFrame, node_texts: DataFrame, width: int) -> DataFrame:
    """node and bits, its bitmap, for each of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches):
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([bitmap(shingles(t, width)) for t in own], pa.binary())], names=["node", "bits"])

    return node_texts.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(run, "node binary, bits binary")


def sweep(members: DataFrame, percent: int, part: int = SWEPT) -> DataFrame:
    """Pairs (a, b) of one bucket in different components with near signatures whose bitmaps don't rule the pair out.
    members: key, node, root, n, sketch, bits."""
    least = _least_agreement(percent)
    # A partner of a set in one range of sizes is in the same range or, smaller, in the one below ("low"); ranges are a
    # little wider than the threshold asks for, so rounding does no harm.
    own = members.withColumn("range", F.floor(F.log("n") / F.log(F.lit(100 / percent + 0.01)))).withColumn("low", F.lit(False))
    laid = own.union(own.withColumn("range", F.col("range") + 1).withColumn("low", F.lit(True)))
    hashed = F.xxhash64("node")
    # Hot groups alone have a row here, under 32 salts, so that the join doesn't bring them together again.
    hot = laid.groupBy("key", "range").agg(F.count("*").alias("m")).where(F.col("m") > part)
    hot = hot.select("key", "range", F.ceil(F.col("m") / part).alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("salt"))
    few = laid.withColumn("salt", F.pmod(hashed, F.lit(32))).join(hot, ["key", "range", "salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    few = few.withColumn("i", F.pmod(hashed, F.col("parts"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    few = few.select("key", "range", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "low", "node", "root", "n", "sketch", "bits")
    few = few.repartition("key", "range", "x", "y").sortWithinPartitions("key", "range", "x", "y", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(rows: list[tuple]) -> pa.RecordBatch:
            i_of, low, node, root, n, sketch, bits = zip(*(r[4:] for r in rows))
            size = min(map(len, bits))
            bits = np.stack([folded(x, size) for x in bits])
            k = np.stack([np.frombuffer(x, np.uint8) for x in sketch])
            names = {r: i for i, r in enumerate(set(root))}
            root, n, low, i_of = np.array([names[r] for r in root]), np.array(n), np.array(low), np.array(i_of)
            across = rows[0][2] != rows[0][3]  # two parts: only pairs between them
            a_out, b_out = [], []
            for i in range(len(rows) - 1):  # by size: partners come before the first that is too large
                stop = int(np.searchsorted(n, n[i] * 100 / percent, side="right"))
                ok = (root[i + 1 : stop] != root[i]) & ~(low[i + 1 : stop] & low[i])
                if across:
                    ok &= i_of[i + 1 : stop] != i_of[i]
                at = np.flatnonzero(ok) + i + 1
                if len(at):
                    at = at[(k[at] == k[i]).sum(axis=1) >= least]
                if len(at):
                    only_i, only_j = np.bitwise_count(bits[i] & ~bits[at]).sum(axis=1), np.bitwise_count(bits[at] & ~bits[i]).sum(axis=1)
                    most = np.minimum(n[i] - only_i.astype(np.int64), n[at] - only_j.astype(np.int64))
                    at = at[100 * most >= percent * (n[i] + n[at] - most)]
                for j in at:
                    a, b = sorted((node[i], node[j]))
                    a_out.append(a), b_out.append(b)
            return pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "range", "x", "y", "i", "low", "node", "root", "n", "sketch", "bits"))):
                if rows and row[:4] != rows[0][:4]:
                    yield near(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield near(rows)

    return few.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept for every row of docs."""
    feats = written(features(docs, width), "minhash")
    named = feats.where("doc_id IS NOT NULL AND node IS NOT NULL")
    classes = named.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")

    keyed = classes.select("node", F.explode("keys").alias("key"))
    live = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("a")).where("m > 1").drop("m")
    buckets = written(keyed.join(live, "key"), "buckets")
    involved = buckets.select("node").distinct().join(classes.select("node", "rep", "sketch"), "node").select("node", "sketch", "rep.doc_id", "rep.th")
    source = docs.select("doc_id", text_hash(F.col("text")).cast("long").alias("th"), "text").where("doc_id IS NOT NULL")
    node_texts = written(source.join(involved, ["doc_id", "th"]).select("node", "sketch", "text").dropDuplicates(["node"]), "texts")

    stars = buckets.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = written(verified(stars, node_texts, width, percent), "links")
    roots = written(components(links), "roots")
    rooted = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    swept = written(rooted.join(open_, "key", "left_semi"), "swept")
    members = swept.join(classes.select("node", "n", "sketch"), "node").join(bitmaps(swept, node_texts, width), "node")
    rest = written(sweep(members, percent).join(stars, ["a", "b"], "left_anti"), "rest")
    more = written(verified(rest, node_texts, width, percent), "links")
    if not more.isEmpty():
        roots = written(components(links.union(more)), "roots")

    labels = classes.select("node", "rep.doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(names, "root").select("node", "component_id")
    out = feats.select("doc_id", "th", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, once."""
    found = near_duplicates(docs, width, percent).where("kept").select("doc_id", "th").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"), text_hash(F.col("text")).cast("long").alias("t"))
    kept = own.join(found, own["d"].eqNullSafe(found["doc_id"]) & (own["t"] == found["th"]), "left_semi")
    unique = kept.where("d IS NOT NULL").dropDuplicates(["d"]).union(kept.where("d IS NULL"))
    return unique.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM p),
c(a, b) AS (WITH RECURSIVE c(a, b) AS (SELECT a, b FROM r UNION SELECT c.a, r.b FROM c JOIN r ON c.b = r.a) SELECT a, b FROM c)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM c GROUP BY a) ON a = doc_id
"""
