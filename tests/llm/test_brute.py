"""What SQL can't say, against brute force; and rows that are awkward."""

import math
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, language_id, line_dedup, minhash, mixing, packing, resampling, suffix_dedup, token_counts, topk_search

D = "/root/testdata/sf0.001"
#: Names that the operators use themselves, as columns of the input.
ODD = "doc_id long, text string, lang string, `a.b` string, row string, th long, rank int, score double, key string, kept boolean, n_tokens long, copy int"


def odd_rows(n=4):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    some = [(1, None), (2, ""), (3, "x"), (None, "a null id of some words"), (5, long), (6, long + " more"), (7, "same text here"), (7, "same text here"), (8, "\n\n \t"), (9, "日本語" * 2000)]
    return [(d, t, "en" if (d or 0) % 2 else None, "c", "r", 1, 1, 1.0, "k", True, 1, 1) for d, t in some]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


RUNS = {
    "op1": lambda d, lab: suffix_dedup.deduplicate(d), "op2": lambda d, lab: minhash.near_duplicates(d), "op2 stage": lambda d, lab: minhash.deduplicated(d), "op4": lambda d, lab: line_dedup.digests(d),
    "op4 stage": lambda d, lab: line_dedup.cleaned(d), "op5": mixing.weights, "op6": lambda d, lab: language_id.identify(d), "op7": lambda d, lab: topk_search.search(d, "doc_id % 2 = 1", 3), "op8": lambda d, lab: packing.pack(d),
    "op9": lambda d, lab: token_counts.counts(d), "op10": resampling.resample,
}


@pytest.mark.filterwarnings("ignore:mixing")
@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_empty_tables(odd, labels, name):
    out = RUNS[name](odd, labels).collect()
    if name in ("op1", "op2", "op4", "op5", "op6", "op9", "op10"):
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows())
    assert RUNS[name](odd.limit(0), labels).count() == 0
    if name in ("op5", "op10"):
        assert RUNS[name](odd, labels.limit(0)).count() == len(odd_rows())


def brute_scores(rows, k, asked):
    terms = {i: Counter((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()) for i, (_, t) in enumerate(rows)}
    n, mean = len(rows), sum(sum(c.values()) for c in terms.values()) / len(rows)
    df = Counter(t for c in terms.values() for t in c)
    out = {}
    for q, (d, _) in enumerate(rows):
        if not asked(d) or not terms[q]:
            continue
        scored = []
        for i, (e, _) in enumerate(rows):
            size = sum(terms[i].values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * terms[i][t] * 2.2 / (terms[i][t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in terms[q] if t in terms[i])
            if s > 0:
                scored.append((-round(s, 6), e))
        out[d] = [(e, -s) for s, e in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("kind", ["common words", "rare words", "ties"])
def test_search(spark, kind):
    rng = np.random.default_rng(len(kind))
    words = [f"w{i}" for i in range({"common words": 12, "rare words": 900, "ties": 3}[kind])]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 2 if kind == "ties" else 30)), p=weight / weight.sum()))) for i in range(700)]
    expected = brute_scores(rows, 5, lambda d: d % 10 == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for postings, terms in ((1 << 20, 1 << 20), (400, 90)):
        got = defaultdict(list)
        for r in topk_search.search(docs, "doc_id % 10 = 0", 5, postings, terms).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in expected.items() if v}
        assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], expected[q]))


def test_a_shard_takes_its_rows_over():
    """Nothing holds a group's rows once they are read, and places take four bytes."""
    rows = [(i, 3, np.array([i, i + 1, i + 2], "<i8"), np.array([1, 1, 1], "<u4")) for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([3] * 10), pa.array([3] * 10), pa.array([r[2].tobytes() for r in rows]), pa.array([r[3].tobytes() for r in rows])], names=["doc_id", "n", "m", "terms", "tfs"])
    groups = topk_search._shards(iter([batch]), 12)
    first = [weakref.ref(r[2]) for r in next(groups)]
    assert len(first) == 4 and not any(r() is not None for r in first)
    assert [[r[0] for r in g] for g in groups] == [[4, 5, 6, 7], [8, 9]]
    shard = topk_search.Shard(iter(rows), 3.0, np.arange(12), np.ones(12))
    assert shard.place.itemsize == 4 and shard.search_many([np.array([5])], 2)[0][0].tolist() == [3, 4]


def test_search_skips_lists():
    rng = np.random.default_rng(2)
    common_, docs = np.arange(40), []
    for i in range(4000):
        t = np.unique(np.append(rng.choice(common_, 12), rng.integers(100, 4000, 6)))
        docs.append((i, float(rng.integers(10, 60)), t, rng.integers(1, 4, len(t)).astype(np.uint32)))
    df = Counter(int(x) for d in docs for x in d[2])
    asked = np.array(sorted(df))
    shard = topk_search.Shard(docs, 30.0, asked, np.array([math.log(1 + (4000 - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in asked]))
    for d in docs[:50]:
        ids, scores = shard.search(shard.numbers(d[2]), 5)
        assert list(scores) == sorted(scores, reverse=True) and d[0] in ids
    assert shard.skipped > shard.read / 4


@pytest.mark.parametrize("cells", [topk_search.CELLS, 50_000])
def test_search_of_many_queries_reads_few_postings(monkeypatch, cells):
    monkeypatch.setattr(topk_search, "CELLS", cells)
    rng, docs = np.random.default_rng(5), []
    for i in range(3000):
        t = np.unique(np.append(rng.choice(60, 15), rng.integers(100, 5000, 8)))
        docs.append((i, float(rng.integers(10, 60)), t, rng.integers(1, 4, len(t)).astype(np.uint32)))
    df = Counter(int(x) for d in docs for x in d[2])
    asked = np.array(sorted(df))
    shard = topk_search.Shard(docs, 30.0, asked, np.array([math.log(1 + (3000 - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in asked]))
    queries = [shard.numbers(d[2]) for d in docs[:80]] + [np.zeros(0, np.int64), shard.numbers(np.array([3])), shard.numbers(np.array([int(docs[0][2][-1])]))]
    got = shard.search_many(queries, 5)
    read, shard.read = shard.read, 0
    for q, (ids, scores) in zip(queries, got):
        alone = shard.search(q, 5) if len(q) else (np.zeros(0), np.zeros(0))
        assert list(ids) == list(alone[0]) and np.allclose(scores, alone[1], atol=2e-6)
    assert cells < 1 << 20 or read < shard.read / 4


def exact_components(texts, width, percent):
    """Smallest index reachable, by comparing all pairs of full sets."""
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[i : i + min(width, len(w))]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= percent * (len(a) + len(b) - c):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("part", [minhash.SWEPT, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, part):
    """As the pipeline has it: five words. With chains, copies, and a bucket that many different groups share."""
    monkeypatch.setattr(minhash, "sweep", lambda m, p, f=minhash.sweep: f(m, p, part))
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        w = list(rng.choice(vocabulary, 120))
        for _ in range(9):
            texts.append(" ".join(w))
            w = list(w)
            for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[k] = str(rng.choice(vocabulary))
    order = rng.permutation(len(texts))
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert [got[i] for i in range(len(rows))] == exact_components([t for _, t in rows], 5, 80)


def test_a_family_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    """Texts at a similarity of about 0.72, each with four words of its own: all share buckets, a few are similar enough."""
    rng, asked, verified = np.random.default_rng(7), [], minhash.verified

    def watched(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", watched)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(60):
        w = list(base)
        for place in rng.choice(48, 4 if k % 12 else 2, replace=False) * 4 + rng.integers(0, 4):
            w[place] = f"own{k}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 80).collect()}
    assert [got[i] for i in range(60)] == exact_components(texts, 4, 80)
    assert len(asked) == 2 and asked[1] < 200, asked


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 900, 1024, 1025, 40_000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.append(x[: n - n // 10], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64))
        a, b = minhash.bitmap(x), minhash.bitmap(y)
        size = min(len(a), len(b))
        a, b = minhash.folded(a, size), minhash.folded(b, size)
        assert np.bitwise_count(a & ~b).sum() <= len(np.setdiff1d(x, y)) and np.bitwise_count(b & ~a).sum() <= len(np.setdiff1d(y, x))
        assert size <= minhash.WIDEST and not (a & ~minhash.folded(minhash.bitmap(x), size)).any()


def test_near_duplicate_stage_recall(spark, small):
    """The stage's own setting on what line dedup leaves: no component of the exact join is missed."""
    left = line_dedup.cleaned(small).select("doc_id", "text").orderBy("doc_id").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in left], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 5, 80).collect()}
    exact = exact_components([r.text for r in left], 5, 80)
    assert [got[r.doc_id] for r in left] == [left[k].doc_id for k in exact]
    assert {r.doc_id for r in minhash.deduplicated(docs, 5, 80).collect()} == {left[k].doc_id for k in exact}


def dense_rates(n, p, aim, rounds=200_000):
    """Projected gradient on the documents' own rates, from 1, one small step after the other."""
    a = (n[:, None] * p).T / n.sum()
    x, step = np.ones(len(n)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        x = np.maximum(0, x - step * (a.T @ (a @ x - aim)))
        if np.abs(a @ x - aim).max() < 1e-4:
            break
    return a @ x


@pytest.mark.parametrize("most", [None, 3.0])
def test_mixing_against_dense_least_squares(spark, most):
    rng = np.random.default_rng(12)
    n, p = rng.integers(1, 400, 300), rng.dirichlet([2.0, 0.4, 0.3], 300)
    docs = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>").cache()
    aim = np.array([mixing.TARGETS[k] for k in mixing.DOMAINS])
    rate, share = mixing.rates(docs, tolerance=1e-4, most=most)
    got = docs.withColumn("x", rate).toPandas()
    reached = (got.n_tokens * got.x).to_numpy() @ np.array(got.p.tolist()) / got.n_tokens.sum()
    assert np.abs(reached - dense_rates(n.astype(float), p, aim)).max() < 3e-4 and np.abs(reached - share).max() < 1e-9
    assert got.x.min() >= 0 and (most is None or got.x.max() <= most)


@pytest.mark.filterwarnings("ignore:mixing")
def test_mixing_without_a_way(spark, labels):
    few = spark.createDataFrame([(i, "some words that all rows share") for i in range(4)], "doc_id long, text string")
    for lab in (labels, labels.limit(0)):
        out = mixing.mixed(few, lab, most=4.0, near=1e-4)
        assert out.columns == few.columns and out.count() <= 16


def test_counts_after_edits(small):
    slow, fast = packing.encoders(*packing.default_paths())
    count = lambda t: len(slow.encode(t, add_special_tokens=False).ids)
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    got = token_counts.counts(small).collect()
    assert len(got) == len(texts) and sum(r.n_edits for r in got) > 0
    for r in got:
        text = texts[r.doc_id]
        assert r.n_tokens == count(text)
        for a, b, new in token_counts.masks(text):
            text = text[:a] + new + text[b:]
        assert r.n_tokens_edited == count(text), r.doc_id


def test_masks_take_addresses_first():
    assert token_counts.masks("john12345@x.org 1234567 a") == [(16, 23, "00000"), (0, 15, "EMAIL")] and token_counts.masks("") == []


def test_short_leaves_in_every_script():
    slow, fast = packing.encoders(*packing.default_paths())
    count = lambda t: len(packing.encode(t, slow, fast))
    for text in ("日本語。" * 3000, '{"k":123,"v":[1,2]},' * 600, "QUJD3" * 2400):
        tree, rng = token_counts.TokenTree(text, count), np.random.default_rng(1)
        for _ in range(60):
            a = int(rng.integers(0, len(text)))
            new = str(rng.choice(["x", "7 ", "あ", "<|", "", "\n"]))
            tree.edit(a, a + 1, new)
            text = text[:a] + new + text[a + 1 :]
        assert tree.total == count(text) and "".join(tree.leaf) == text and tree.encoded < 60 * 3 * token_counts.LEAF


def test_grouping_packs_as_well_as_best_fit():
    rng = np.random.default_rng(4)
    for draw in (rng.integers(20, 2049, 4000), np.minimum(2048, rng.lognormal(6, 0.8, 6000).astype(int) + 5), rng.choice([700, 1024, 683, 30], 3000)):
        histogram = {int(k): int(v) for k, v in Counter(draw.tolist()).items()}
        plan = packing.plan(histogram)
        held = Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 2048 and n > 0
            for size in pattern:
                held[size] += n
        assert held == histogram
        alone = sum(packing._best_fit(dict(histogram), 2048, {}).values())
        assert sum(n for _, n in plan) <= alone * 1.005 + 1


def test_pieces_by_hand(spark):
    slow, fast = packing.encoders(*packing.default_paths())
    text = " ".join(f"number {i}" for i in range(3000))
    ids = [*slow.encode(text, add_special_tokens=False).ids, 0]
    got = sorted(packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect(), key=lambda r: r.piece)
    assert [r.start for r in got][:2] == [0, len(ids) % 2048 or 2048] and sum(r.length for r in got) == len(ids)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_resampling_weights_and_draw(spark, small, labels):
    got = {r.doc_id: r for r in resampling.resample(small, labels).collect()}
    good, one = set(), labels.collect()
    for r in one:
        if r.toxic == 0 and r.quality == 1:
            good.add(r.doc_id)
    raw, target = np.zeros(1 << resampling.BITS), np.zeros(1 << resampling.BITS)
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for d, t in texts.items():
        f = resampling.ngrams(t)
        np.add.at(raw, f, 1)
        if d in good:
            np.add.at(target, f, 1)
    overall = target.sum() / raw.sum()
    ratio = np.log((target + resampling.PRIOR * overall) / ((raw + resampling.PRIOR) * overall))
    for d, t in texts.items():
        assert abs(got[d].log_weight - ratio[resampling.ngrams(t)].sum()) < 1e-3 * (1 + abs(got[d].log_weight))
    k = round(len(texts) * len(good) / len(one))
    best = sorted(got.values(), key=lambda r: -r.key)[:k]
    assert {r.doc_id for r in best} == {r.doc_id for r in got.values() if r.kept} and len(best) == k


def test_gumbel_draws_in_proportion(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    ratio = np.zeros(1 << resampling.BITS, np.float32)
    keys = resampling.weighed(rows, ratio).withColumn("key", F.col("key") + F.when(F.col("doc_id") % 4 == 0, math.log(3.0)).otherwise(0.0))
    edge = resampling.boundary(keys.cache(), 400)
    top = keys.where(F.col("key") >= edge).collect()
    share = sum(r.doc_id % 4 == 0 for r in top) / len(top)
    assert len(top) == 400 and abs(share - 0.5) < 0.1  # a quarter of the rows with three times the weight


def test_hot_chunk_is_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.with_firsts, "__defaults__", (3,))
    hot = "\n".join(f"shared line {i} of some words in it" for i in range(12))
    rows = [(i, f"{hot}\nown {i} alpha beta gamma delta\nown {i} epsilon zeta eta theta") for i in range(90)]
    got = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text == rows[0][1] and all(r.text == "\n".join(rows[r.doc_id][1].split("\n")[12:]) for r in got[1:])


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)
    assert common.local_path("hdfs://n/x") is None and common.local_path("file:///x") == common.local_path("file:/x") == "/x"
