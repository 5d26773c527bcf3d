"""Language identification in two steps: family, then one-versus-one linear support vector machines inside it.

Features are hashed character n-grams (bytes of the lower-cased text, n of 1 to 4), averaged over the whole text.
Families come from a table of related languages; a language without an entry is a family of its own. Family scores and
the pairwise machines are linear, trained by stochastic subgradient descent on the hinge loss, so that a prediction is
one sum of table rows. Training takes at most per_language documents of each language (smallest hashes of doc_id).

Null text, empty text and text without a letter: `und`, score 0. With one learned language that is always the answer,
and with none every document is `und`. Ties go to the alphabetically first language. Prediction looks at text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.model_text import texts

BITS = 15
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi mr ne bn gu pa ur",
    "han": "zh yue ja",
}
#: Training documents of each language, at most.
PER_LANGUAGE = 600
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    head = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if head in members.split()), f"only {lang}")


def hashed(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    h, out = b + np.uint32(1), []
    for n in range(1, 5):
        if n > 1:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


class Rows:
    """Sparse rows of features, of the order of 1, as the constant is."""

    def __init__(self, samples: list[str]):
        found = [np.unique(hashed(t), return_counts=True) for t in samples]
        self.size = np.array([len(u) for u, _ in found], dtype=np.int64)
        self.at = np.append(0, np.cumsum(self.size))[:-1]
        self.column = np.concatenate([u.astype(np.int32) for u, _ in found]) if found else np.zeros(0, np.int32)
        self.value = np.concatenate([(40 * c / c.sum()).astype(np.float32) for _, c in found]) if found else np.zeros(0, np.float32)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, values, where each row begins) of some rows."""
        size = self.size[rows]
        first = np.append(0, np.cumsum(size))[:-1]
        which = np.arange(size.sum()) + np.repeat(self.at[rows] - first, size)
        return self.column[which], self.value[which], first


def _svm(x: Rows, use: np.ndarray, y: np.ndarray, rounds: int = 40, decay: float = 1e-5) -> np.ndarray:
    """Averaged subgradient descent on the hinge loss over the rows `use` of x; the last weight is the constant."""
    rng, n, width = np.random.default_rng(7), len(y), 1 << BITS
    w, total, steps = np.zeros(width + 1), np.zeros(width + 1), 0
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    for r in range(rounds):
        for part in np.array_split(rng.permutation(n), max(1, n // 32)):
            column, value, first = x.take(use[part])
            miss = (np.add.reduceat(value * w[column], first) + w[-1]) * y[part] < 1
            w *= 1 - decay
            if miss.any():
                pull = np.where(miss, weight[part] * y[part], 0.0) * (2 / ((1 + r) * len(part)))
                w[:-1] += np.bincount(column, value * np.repeat(pull, x.size[use[part]]), width)
                w[-1] += pull.sum()
            if r >= rounds // 2:
                total, steps = total + w, steps + 1
    return total / max(1, steps)


class Model:
    """families: names; langs: languages by family; rows: one table for all linear scores, by bucket."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for _, lang in samples})
        self.families = sorted({family(x) for x in self.langs})
        x = Rows([text for text, _ in samples])
        lang = np.array([y for _, y in samples])
        fam = np.array([family(y) for y in lang])
        self.jobs: list[tuple[str, str, str]] = []
        columns = []
        pairs = [("family", a, b) for a, b in combinations(self.families, 2)]
        for f in self.families:
            pairs += [("lang", a, b) for a, b in combinations([y for y in self.langs if family(y) == f], 2)]
        for kind, a, b in pairs:
            of = fam if kind == "family" else lang
            use = np.flatnonzero((of == a) | (of == b))
            w = _svm(x, use, np.where(of[use] == a, 1.0, -1.0))
            self.jobs.append((kind, a, b))
            column, value, first = x.take(use)
            columns.append(w / (np.median(np.abs(np.add.reduceat(value * w[column], first) + w[-1])) or 1))
        self.rows = np.array(columns, dtype=np.float32).T.copy() if columns else np.zeros(((1 << BITS) + 1, 0), np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not _LETTER.search(text):
            return "und", 0.0
        if not self.jobs:
            return self.langs[0], 1.0
        f = hashed(text)
        z = 40 * self.rows[f].mean(axis=0, dtype=np.float64) + self.rows[-1]
        won: dict[tuple[str, str], float] = {}
        for (kind, a, b), v in zip(self.jobs, z):
            p = 1 / (1 + np.exp(-3 * float(np.clip(v, -20, 20))))
            won[kind, a] = won.get((kind, a), 0) + p
            won[kind, b] = won.get((kind, b), 0) + 1 - p
        def best(kind: str, names: list[str]) -> tuple[str, float]:
            top = max(names, key=lambda y: (won.get((kind, y), 1.0), [-ord(c) for c in y]))
            return top, won.get((kind, top), 1.0) / max(1, len(names) - 1)
        fam, p = best("family", self.families)
        lang, q = best("lang", [y for y in self.langs if family(y) == fam])
        return lang, min(1.0, max(0.0, p * q))


def _remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of documents that aren't held out; at most per_language texts a language come to the driver.

    One scan counts the languages, one takes the texts: about twice as many as needed by hash, then the first of these.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder() != 0)).where(F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.xxhash64("doc_id").alias("key"))
    sizes = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count("*")).alias("share")).collect()  # a row a language
    if not sizes:
        return Model([])
    # One row a language, as many as there are machines to train for: a proven bound for the broadcast.
    shares = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, share double"))
    near = usable.join(shares, "lang").where(F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))  # about 2 x per_language rows each
    chosen = near.withColumn("place", place).where(F.col("place") <= per_language).select("text", "lang", "place").collect()
    return Model([(r["text"], r["lang"]) for r in sorted(chosen, key=lambda r: (r["lang"], r["place"]))])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, own in texts(batches):
            found = [m.predict(t) for t in own]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([a for a, _ in found], pa.string()), pa.array([float(b) for _, b in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select("doc_id", "text", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predictions(docs, train(docs, per_language))
