"""The operators against brute force and SQL, and on awkward rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id, line_dedup, minhash, mixing, packing, quality_rules, queries, resampling, suffix_dedup, token_counts, topk_search

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gone int"
LINE = "one two three four five six seven eight nine ten eleven twelve."
ROWS = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "x", 1), (3, "a\n\nb", "en", "s", 4, "x", None), (None, LINE * 40, "en", "s", 9, "x", 1),
    (4, LINE * 40, "en", None, 9, "x", 1), (4, LINE * 40, "en", None, 9, "x", 1), (5, "aaaa" * 400, "de", "s", 1600, None, 2), (6, "é" * 900 + " <|endoftext|> x", "fr", "s", 1, "x", 1),
    (7, " ".join(f"w{i}" for i in range(9000)), "en", "s", 1, "x", 1), (8, "|".join("x" * 50), "en", "s", 1, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got, expected = queries.queries()[name](spark, D).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def brute_removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, odd):
    for docs in (odd, spark.read.parquet(f"{D}/documents.parquet")):
        got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect())
        assert got == brute_removed([r.text for r in docs.select("text").collect()])


def test_suffix_dedup_of_a_string_in_a_third_of_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(map(str, rng.integers(10**6, 10**7, n)))
    shared, near = words(13)[:100], words(30)
    texts = [f"{words(60)} {shared if k % 3 == 0 else words(12)} {near[: 40 * (k % 5)]} {words(60)}" for k in range(240)]
    texts += [f"{words(40)}{texts[0][300:900]}{words(30)}", texts[3], f"{words(20)}{shared * 9}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    most, rows_of = [], suffix_dedup._bytes_of_runs

    def watched(wanted, length):
        rows = rows_of(wanted, length)
        most.append(rows.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return rows

    monkeypatch.setattr(suffix_dedup, "_bytes_of_runs", watched)
    for hot in (0, 20_000):
        got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicate(docs, hot=hot).collect())
        assert got == brute_removed(texts) and most.pop() <= hot
    suffix_dedup.deduplicate(docs, hot=1 << 40)
    assert most.pop() > 20_000


def test_suffix_sort():
    rng = np.random.default_rng(3)
    for trial in range(120):
        t = np.append(rng.integers(2, 3 + trial % 4, rng.integers(1, 90)), 0).astype(np.uint16)
        depth = int(rng.integers(2, 30))
        order, lcp = suffix_dedup.suffix_sort(t, depth, None, 0 if trial % 2 else 1 << 20)  # 0: all blocks on disk
        cut = [tuple(t[i : i + depth]) for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(len(t)))
        for x, y, n in zip(cut, cut[1:], lcp[1:]):
            assert n == next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_only_what_may_repeat_is_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    own = lambda n: rng.integers(0, 256, n, np.uint8).tobytes()
    shared, sort, sizes = own(90), suffix_dedup.suffix_sort, []
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda text, *rest: (sizes.append(len(text)), sort(text, *rest))[1])
    for length in (1, 5, 50):
        for tail in (b"", own(40), shared[20:80], b"a" * 120):
            parts = [own(300) + shared[k % 3 :] + tail[: 30 * k] + own(300) for k in range(9)] + [b"", shared[:30], tail]
            strings = [p[i : i + length] if i + length <= len(p) else None for p in parts for i in range(len(p) + 1)] + [None]
            count = Counter(strings)
            expected = [s is not None and count[s] > 1 for s in strings]
            assert suffix_dedup.repeated_starts(parts, length).tolist() == expected
    sizes.clear()
    parts = [own(2000) + bytes([k]) + shared + bytes([k]) + own(2000) for k in range(20)] + [own(500) + b"\xff" + shared[:70]]
    assert suffix_dedup.repeated_starts(parts, 50).sum() == 20 * 41 + 21 and sum(sizes) < 400
    monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda b, length: np.zeros(len(b) - length + 1, np.uint64))  # all hashes alike
    assert suffix_dedup.repeated_starts(parts, 50).sum() == 20 * 41 + 21


def test_near_duplicates(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 4).collect()}
    assert got[4] == (13, 4, True) and got[1] == (0, 1, True) and got[None] == (13, None, True)
    assert minhash.deduplicated(odd).where("doc_id = 4").count() == 1 and minhash.deduplicated(odd).columns == odd.columns


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 20), (20, 21), (5, 5)]
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in minhash.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 7, 21: 7}


def test_rules_and_lines(odd):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.verdicts(odd).collect()}
    assert not got[1, 0].kept and not got[2, 0].kept and got[7, 9000].n_repeat_words == 0
    assert quality_rules.cleaned(odd).columns == odd.columns
    same = odd.select("doc_id", "text").limit(0)
    assert line_dedup.digests(same).count() == 0 and quality_rules.verdicts(same).count() == 0
    assert line_dedup.cleaned(odd).columns == odd.columns and line_dedup.digests(odd).count() == len(ROWS)


def test_rules_read_a_line_no_more_than_they_must(spark):
    words = lambda n, x="w": " ".join([x] * n)
    cases = {
        words(59): False, words(60): True, words(60, "ab"): True, words(59) + " w.": False, words(60, "\u2026"): False, "x" * 300: False,
        words(27) + " lorem ipsum": True, words(29) + " Lorem Ipsum": False, words(28) + " Lorem Ipsum": True, words(28, "long") + " lorem ipsum": True,
        words(29, "long") + " lorem ipsum": False, "lorem ipsum": True, "": False, "## ** $$ w": True, "## ** w": False, "a/b/c|d": False,
        **{f"a {m} b {m} c": True for m in "|>»›•·/\\"}, "a · b": False, f"· · {words(7)}": False, f"· · {words(6)}": True,
    }
    rows = spark.createDataFrame([(k, line) for k, line in enumerate(cases)], "doc_id long, text string")
    got = {r.text: r.bad for r in rows.select("text", F.element_at(F.transform(F.array("text"), quality_rules.line_fails), 1).alias("bad")).collect()}
    assert got == cases
    rule = str(quality_rules.line_fails(F.col("text")))  # what is cheap stands first
    assert 0 <= rule.find("length(") < rule.find("rlike(") < rule.find(", 60)") and 0 <= rule.find("contains(") < rule.find("»›")
    assert str(quality_rules.base_metrics(F.col("text"))).count("translate(") == 1


def test_lines_after_a_shift(spark):
    own = [f"line {i} " + LINE for i in range(30)]
    docs = [(1, "\n".join(own)), (2, "\n".join(["an insertion", *own]))]
    got = {r.doc_id: r for r in line_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed_lines == 0 and got[2].n_removed_lines >= 20


def test_short_passages_in_differing_contexts(spark):
    line = lambda *k: " ".join(f"{x}" for x in (*k, "alpha beta gamma delta epsilon zeta eta"))
    planted = {n: [line("planted", n, i) for i in range(n)] for n in range(2, 7)}
    planted[7] = ["few words", *[line("planted", 7, i) for i in range(2)], "", "short end"]
    rows = []
    for k in range(30):
        text = []
        for n, lines in planted.items():
            text += [*[line("own", k, n, i) for i in range(4)], *lines]
        rows.append((k, "\n".join([*text, line("own", k, "end")])))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "\n".join(got[0]) == rows[0][1]
    for k in range(1, 30):
        assert got[k] == [x for x in rows[k][1].split("\n") if "own" in x], k


def test_what_goes_stays_whole_somewhere(spark):
    rng, line = np.random.default_rng(4), "one two three four five six %d"
    texts = ["\n".join([line % x, "", "  "][min(2, rng.integers(0, 12))] if rng.integers(0, 5) == 0 else line % x for x in rng.integers(0, 6, 9)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text.encode() for r in line_dedup.cleaned(docs).collect()}
    cut = lambda t: [b"\n".join(t.split(b"\n")[a : b + 1]) for a, b in line_dedup.stretches(t.split(b"\n"), 8)]
    before, after = Counter(x for t in texts for x in cut(t.encode())), {x for t in left.values() for x in cut(t)}
    assert {x for x, n in before.items() if n > 1} <= after and sum(map(len, left.values())) < 0.9 * sum(map(len, texts))


def test_mixing(spark, odd, labels):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = mixing.weights(docs, spark.read.parquet(f"{D}/labels.parquet")).toPandas()
    total = got.n_tokens.sum()
    for name, aim in mixing.TARGETS.items():
        assert abs((got.n_tokens * got.rate * got[f"p_{name}"]).sum() / total - aim) < 0.03
    assert (got.rate >= 0).all() and mixing.weights(odd, labels).count() == len(ROWS) and mixing.weights(odd.limit(0), labels).count() == 0


def test_mixing_reaches_rare_domains(spark):
    rng = np.random.default_rng(6)
    for low, toxic in ((0.0025, 0.0025), (0.004, 0.0005), (0.6, 0.3)):
        kind = rng.choice(3, 4000, p=[1 - low - toxic, low, toxic])
        kind[:3] = 0, 1, 2
        sure = rng.uniform(0.9, 0.9999, 4000)
        rows = [(int(n), [float(s) if j == k else (1 - float(s)) / 2 for j in range(3)]) for n, k, s in zip(rng.integers(1, 900, 4000), kind, sure)]
        docs = spark.createDataFrame(rows, "n_tokens long, p array<double>").cache()
        rate, share = mixing.rates(docs)
        got = docs.withColumn("x", rate).toPandas()
        p = np.array(got.p.tolist())
        assert np.abs((got.n_tokens * got.x).to_numpy() @ p / got.n_tokens.sum() - [0.9, 0.08, 0.02]).max() <= 2e-3
        assert (got.x >= 0).all() and max(abs(a - b) for a, b in zip(share, mixing.TARGETS.values())) <= 2e-3
        docs.unpersist()


def test_mixing_reports_what_it_misses(spark):
    docs = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (30, [0.9, 0.1, 0.0])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="nearest fit"):
        _, share = mixing.rates(docs)
    assert abs(share[0] - 0.9) < 2e-3 and abs(share[1] - 0.08) < 2e-3 and share[2] == 0
    with pytest.raises(RuntimeError, match="no fit"):
        mixing.rates(docs, steps=1)


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, 100).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert {r.lang_pred for r in language_id.identify(odd).where("doc_id < 3").collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def test_search_awkward(odd):
    assert topk_search.search(odd, "doc_id % 2 = 0", 3).count() > 0 and topk_search.search(odd.limit(0), "doc_id = 0").count() == 0


def test_packing(spark, odd):
    slow, _ = packing.encoders(*packing.default_paths())
    for docs in (odd, spark.read.parquet(f"{D}/documents.parquet"), odd.limit(0)):
        got = packing.pack(docs).toPandas()
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
        expected = Counter()
        for r in docs.collect():
            ids = np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            expected.update((r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 2048)))
        assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got.notna(), None).itertuples(index=False, name=None)) == expected
        if len(got):
            assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.02 + 1


def test_token_tree():
    slow, fast = packing.encoders(*packing.default_paths())
    count = lambda t: len(packing.encode(t, slow, fast))
    rng, text = np.random.default_rng(5), " ".join(f"word{i}," for i in range(400))
    tree = token_counts.TokenTree(text, count, 64)
    for _ in range(40):
        a = int(rng.integers(0, len(text) + 1))
        b, new = min(len(text), a + int(rng.choice([0, 1, 7, 200]))), str(rng.choice(["", " ", "x", "\n\n", " 'll ", "é 1"]))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert "".join(tree.leaf) == text and tree.total == count(text)


def test_counts_and_resampling_awkward(spark, odd, labels):
    assert token_counts.counts(odd).count() == len(ROWS)
    got = resampling.resample(odd, labels, share=0.5).toPandas()
    assert len(got) == len(ROWS) and got.kept.sum() in (5, 6)
    assert resampling.resample(odd.limit(0), labels).count() == 0 and resampling.resample(odd, labels.limit(0)).where("kept").count() == len(ROWS)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and 0 < out.count() <= n * 1.1, name
        docs = out
    assert pipeline.run(spark, D).count() > 0
