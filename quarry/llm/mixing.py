"""Mixing to target weights with soft domain membership, in SQL expressions.

1. A naive Bayes classifier over hashed words and word endings is fitted on labelled rows, at most max_train of them
   (those with the smallest hash of doc_id): domains clean, low and toxic from the columns quality and toxic.
2. Each document gets posteriors p over the domains and a token count n (words between white space; the public
   tokenizers have no SQL form).
3. Rates x >= 0, one per document, minimise the squared distance between the expected domain totals sum(x n p) and
   the targets (weights times the corpus total), with NEAR times the squared distance from x = 1 to choose among
   equals: gradient steps from x = 1, scaled by the inverse Gram matrix of the documents above 0, summed and then
   projected. A document's rate depends only on its p and the sum of the steps, three numbers, so a step is one
   aggregate over the written (n, p) table, and nothing per document is kept between steps. It ends when all shares
   are within the tolerance or the optimality condition holds, else it raises; a target out of reach gives a warning.

Empty and null texts have no tokens: posteriors are the priors, they get a rate like any other and add nothing to the
totals. Without labelled rows all posteriors are equal. Without tokens all rates are 1. Rows that repeat are mixed
each by itself. A domain whose documents hold no tokens can't reach its target; the fit is then the nearest one.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import words, written

DOMAINS = ("clean", "low", "toxic")
#: Weights of the domains in the mixture; they sum to 1.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
BUCKETS = 16384
#: Documents the classifier is fitted on, at most.
MAX_TRAIN = 20_000
#: Weight of the distance from x = 1, and the slope below which a fit counts as optimal.
NEAR = 1e-9
OPTIMAL = 1e-6


def features(text: Column) -> Column:
    """Bucket numbers of a text's words, lower-cased, and of their last two characters."""
    w = words(F.lower(text))
    of_word = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    of_end = F.transform(w, lambda x: F.pmod(F.xxhash64(F.right(x, F.lit(2)), F.lit(1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(of_word, of_end)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[float], list[list[float]]]:
    """Log priors, and per domain the log probability of each bucket."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    one = one.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers: a proven bound for the broadcast.
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    each = known.select("domain", F.explode(features(F.coalesce("text", F.lit("")))).alias("b"))
    counts = [[1.0] * BUCKETS for _ in DOMAINS]  # one added everywhere
    for row in each.groupBy("domain", "b").count().collect():  # at most DOMAINS x BUCKETS rows
        counts[row["domain"]][row["b"]] += row["count"]
    share = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(share.values()) + len(DOMAINS)
    priors = [math.log((share.get(k, 0) + 1) / total) for k in range(len(DOMAINS))]
    sums = [sum(c) for c in counts]
    return priors, [[math.log(x / s) for x in c] for c, s in zip(counts, sums)]


def _table(values: list[float]) -> Column:
    """An array constant, as one string that the optimiser folds."""
    return F.split(F.lit(" ".join(f"{v:.6f}" for v in values)), " ").cast("array<double>")


def _adding(table: Column) -> Callable[[Column, Column], Column]:
    return lambda a, b: a + F.get(table, b)


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], temperature: float = 4.0) -> DataFrame:
    """row, n_tokens and p, an array over DOMAINS; temperature divides the evidence, for softer membership."""
    priors, logs = model
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), features(F.coalesce("text", F.lit(""))).alias("f")
    )
    z = []
    for k in range(1, len(DOMAINS)):
        ratio = _table([a - b for a, b in zip(logs[k], logs[0])])
        evidence = F.aggregate("f", F.lit(0.0), _adding(ratio))
        z.append((evidence / temperature + (priors[k] - priors[0])).alias(f"z{k}"))
    step = step.select("row", (F.size("f") / 2).cast("long").alias("n_tokens"), *z)
    top = F.greatest(F.lit(0.0), *[F.col(f"z{k}") for k in range(1, len(DOMAINS))])
    e = [F.exp(-top), *[F.exp(F.col(f"z{k}") - top) for k in range(1, len(DOMAINS))]]
    return step.select("row", "n_tokens", F.array(*[x / sum(e[1:], e[0]) for x in e]).alias("p"))


def _dot(p: Column, step: list[float]) -> Column:
    return sum((F.get(p, F.lit(j)) * F.lit(v) for j, v in list(enumerate(step))[1:]), F.get(p, F.lit(0)) * F.lit(step[0]))


def _rate(p: Column, step: list[float], most: float | None = None) -> Column:
    """x after the given sum of gradient steps, from x = 1, at least 0 and, if given, at most `most`."""
    x = F.greatest(F.lit(0.0), 1.0 - _dot(p, step))
    return x if most is None else F.least(F.lit(float(most)), x)


def rates(
    mixed: DataFrame, targets: dict[str, float] | None = None, steps: int = 60, tolerance: float = 2e-3, most: float | None = None, near: float = NEAR
) -> tuple[Column, list[float]]:
    """The rate as a column over p, and the shares reached. mixed: n_tokens and p, written. most: an upper bound of the
    rates, beside the lower one of 0. near: the weight of the distance from x = 1.

    Warns when the nearest fit misses a target by more than tolerance; raises when no fit is found in `steps` passes.
    """
    aim = np.array([(targets or TARGETS)[k] for k in DOMAINS])
    d = range(len(DOMAINS))
    p = [F.get("p", F.lit(j)) for j in d]
    n = F.col("n_tokens")
    total = float(mixed.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return F.lit(1.0), [0.0 for _ in d]

    def measured(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares, the Gram matrix of the rows with a rate above 0, and the function that the steps bring down."""
        x = F.col("x")
        live = mixed.select("n_tokens", "p", _rate(F.col("p"), step.tolist(), most).alias("x"), _dot(F.col("p"), step.tolist()).alias("q")).where("x > 0")
        inside = F.lit(True) if most is None else x < most
        sums = [F.sum(F.when(inside, n * p[i] * p[j])).alias(f"g{i}_{j}") for i in d for j in d if i <= j]
        cost = n * (1 - (x - 1) * (x - 1) - 2 * x * F.col("q"))  # n * x * x inside the bounds
        row = live.agg(*[F.sum(n * p[j] * x).alias(f"t{j}") for j in d], F.sum(cost).alias("xx"), *sums).first()
        share = np.array([row[f"t{j}"] or 0.0 for j in d]) / total
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in d] for i in d]) / total
        return share, gram, (row["xx"] or 0.0) / total / 2 + float(aim @ step) + near / 2 * float(step @ step)

    step = np.zeros(len(DOMAINS))
    share, gram, value = measured(step)
    passes = 1
    while True:
        slope = share - aim - near * step
        reached = np.abs(share - aim).max() <= tolerance
        if reached or np.abs(slope).max() <= OPTIMAL:
            break
        move = np.linalg.solve(gram + near * np.eye(len(DOMAINS)), slope)
        size, gain = 1.0, float(slope @ move)
        while True:
            if passes >= steps:
                raise RuntimeError(f"mixing: no fit in {steps} passes; shares {share.tolist()} for targets {aim.tolist()}")
            found = measured(step + size * move)
            passes += 1
            if found[2] <= value - 1e-4 * size * gain + 1e-12 * abs(value):
                break
            size /= 4
        step, (share, gram, value) = step + size * move, found
    if not reached:
        warnings.warn(f"mixing: the nearest fit has shares {share.round(6).tolist()} for targets {aim.tolist()}", stacklevel=2)
    return _rate(F.col("p"), step.tolist(), most), share.tolist()


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_train: int = MAX_TRAIN, most: float | None = None, near: float = NEAR
) -> DataFrame:
    """row, n_tokens, p, rate and copies: the rate, rounded up or down at random by a hash of doc_id and text."""
    found = written(posteriors(docs, fit(docs, labels, max_train)), "mixing")
    rate, _ = rates(found, targets, most=most, near=near)
    u = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1_000_000)) / 1e6
    return found.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def weights(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, the posteriors and the rate of every row of documents."""
    narrow = docs.select("doc_id", "text")
    model = fit(narrow, labels)
    found = posteriors(narrow, model).select(
        F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text")).alias("row"), "n_tokens", "p"
    )
    found = written(found, "mixing")
    rate, _ = rates(found, targets)
    u = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1_000_000)) / 1e6
    out = found.withColumn("rate", F.round(rate, 6))
    return out.select(
        "row.doc_id", "n_tokens", *[F.round(F.get("p", F.lit(j)), 6).alias(f"p_{k}") for j, k in enumerate(DOMAINS)],
        "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None, near: float = NEAR) -> DataFrame:
    """The mixture: each document as often as its rate says, with the columns of docs.

    Where a domain is nearly absent, unbounded rates repeat a few documents that may belong to it very often, and others
    make room; with `most` and a larger `near` the mixture stays close to the documents there are.
    """
    out = mix(docs, labels, targets, most=most, near=near)
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
