"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated as extreme values.

A word's share of toxic tokens has a Dirichlet prior centred on that of its first six bytes, theirs on that of the first
four, theirs on the share among all tokens. Counts live in a fixed number of hash buckets, so what is broadcast does
not grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from ._text import on_batches, parts, word_hashes
from .folds import fold

HEADS = (4, 6)  # bytes
BITS = (18, 18, 19)  # log2 of the buckets for first four bytes, first six bytes, words
PRIOR = (20.0, 5.0, 2.0)  # tokens that the coarser level counts for
DOUBT = 1.5  # standard deviations by which a log-odds ratio is drawn towards zero
DRIFT = 0.1  # what each token costs a segment
EULER = 0.5772156649
SIGNIFICANT = 0.01  # largest expected number of chance passages
BIN, LOW, HIGH = 0.25, -10.0, 12.0
TOKEN_BIN, TOKEN_LOW, TOKEN_BINS = 0.05, -12.0, 480


def _buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    words, counts, heads = word_hashes(texts, HEADS)
    return [(h >> np.uint64(64 - bits)).astype(np.int64) for h, bits in zip([*heads, words], BITS)], counts


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) in order, in one pass over the positive scores.

    Each candidate remembers the last earlier one that begins at a lower running total, so the search for it skips what
    lies between.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low: list[float] = []
    high: list[float] = []
    start: list[int] = []
    stop: list[int] = []
    link: list[int] = []
    for k in np.flatnonzero(scores > 0).tolist():
        l, r, begin, j = total[k], total[k + 1], k, len(low) - 1
        while True:
            while j >= 0 and low[j] >= l:
                j = link[j]
            if j < 0 or high[j] >= r:
                break
            l, begin = low[j], start[j]
            before = link[j]
            del low[j:], high[j:], start[j:], stop[j:], link[j:]
            j = before
        low.append(l), high.append(r), start.append(begin), stop.append(k + 1), link.append(j)
    return [(a, b, float(h - l)) for a, b, h, l in zip(start, stop, high, low)]


@dataclass
class Model:
    toxic: list[np.ndarray]  # toxic tokens by bucket, for each level
    all: list[np.ndarray]
    base: float
    scale: float = 1.0  # lambda and ln K of the extreme-value distribution of a clean text's best segment
    log_k: float = 0.0
    weight: float = 1.0  # of the calibrated logistic curve
    offset: float = -3.0

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of every token, and the number of tokens of each text."""
        buckets, counts = _buckets(texts)
        share = self.base
        for at, toxic, every, prior in zip(buckets, self.toxic, self.all, PRIOR):
            hits, n = toxic[at], every[at]
            share = (hits + prior * share) / (n + prior)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        odds = np.log(share / (1 - share)) - np.log(self.base / (1 - self.base))
        sure = np.maximum(np.abs(odds) - DOUBT * np.sqrt(1 / (hits + 0.5) + 1 / (n - hits + 0.5)), 0)
        return np.sign(odds) * sure - DRIFT, counts

    def passages(self, texts: list[str]) -> tuple[list[list[tuple[int, int, float]]], np.ndarray, np.ndarray, np.ndarray]:
        """Maximal segments of each text, the best score, the number of tokens, and all token scores."""
        scores, counts = self.tokens(texts)
        ends = np.cumsum(counts)
        any_hit = np.add.reduceat(np.append(scores > 0, False), np.append(ends - counts, len(scores))[:-1]) if len(texts) else []
        found = [segments(scores[e - n:e]) if n and h else [] for e, n, h in zip(ends, counts, any_hit)]
        return found, np.array([max((s for *_, s in f), default=0.0) for f in found]), counts, scores

    def surprise(self, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Minus the log of the number of segments as good that chance would give."""
        return self.scale * best - np.log(np.maximum(counts, 1)) - self.log_k


def _count(rows: DataFrame) -> Model | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 1 << bits), np.int64) for bits in BITS]
        for batch, texts in parts(batches, "_text"):
            buckets, counts = _buckets(texts)
            label = np.repeat(np.array(batch.column("_toxic").to_pylist(), np.int64), counts)
            for table, at in zip(held, buckets):
                for one in (0, 1):
                    table[one] += np.bincount(at[label == one], minlength=table.shape[1])
        for level, table in enumerate(held):
            some = np.flatnonzero(table.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), level, np.int32)), pa.array(some.astype(np.int32)), pa.array(table[0, some]), pa.array(table[1, some])],
                                             ["level", "bucket", "clean", "toxic"])
    summed = on_batches(rows, run, "level int, bucket int, clean long, toxic long").groupBy("level", "bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # at most the fixed number of buckets
    level, at, clean, toxic = (summed.column(c).to_numpy() for c in ("level", "bucket", "clean", "toxic"))
    hits, every = [np.zeros(1 << b, np.float32) for b in BITS], [np.zeros(1 << b, np.float32) for b in BITS]
    for i in range(len(BITS)):
        own = level == i
        hits[i][at[own]], every[i][at[own]] = toxic[own], (clean + toxic)[own]
    ones, tokens = float(hits[0].sum()), float(every[0].sum())
    if not tokens:
        return None
    return Model(hits, every, min(max(ones / tokens, 1e-6), 1 - 1e-6))


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Fit the extreme-value distribution and the logistic curve, from one pass over the calibration texts.

    The pass keeps three numbers a text and a histogram of the clean texts' token scores, so the texts are moved and scored once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["toxic", "best", "n", "bin", "tokens"], np.zeros(TOKEN_BINS, np.int64)
        nothing = lambda kind, n: pa.nulls(n, kind)
        for batch, texts in parts(batches, "_text"):
            _, best, counts, scores = shared.value.passages(texts)
            toxic = batch.column("_toxic").cast(pa.int32())
            clean = np.repeat(toxic.to_numpy() == 0, counts)
            held += np.bincount(np.clip(((scores[clean] - TOKEN_LOW) / TOKEN_BIN).astype(int), 0, TOKEN_BINS - 1), minlength=TOKEN_BINS)
            yield pa.RecordBatch.from_arrays([toxic, pa.array(best, pa.float64()), pa.array(counts, pa.int64()),
                                              nothing(pa.int32(), len(texts)), nothing(pa.int64(), len(texts))], names)
        yield pa.RecordBatch.from_arrays([nothing(pa.int32(), TOKEN_BINS), nothing(pa.float64(), TOKEN_BINS), nothing(pa.int64(), TOKEN_BINS),
                                          pa.array(range(TOKEN_BINS), pa.int32()), pa.array(held)], names)
    seen = cut(on_batches(rows.select("_text", "_toxic"), run, "toxic int, best double, n long, bin int, tokens long"), "calibration")
    _extremes(seen, model)
    _curve(seen, model)


def _log_n() -> Column:
    return F.log(F.greatest("n", F.lit(1)))


def _extremes(seen: DataFrame, model: Model) -> None:
    """Lambda solves sum p(s) exp(lambda s) = 1 over the token scores of clean calibration texts; K fits their best segments' mean."""
    texts, best, log_n = seen.filter("toxic = 0").agg(F.count(F.lit(1)), F.avg("best"), F.avg(_log_n())).first()
    if not texts:
        return
    n = np.zeros(TOKEN_BINS)
    for k, tokens in seen.filter("bin is not null").groupBy("bin").agg(F.sum("tokens")).collect():  # a fixed number of bins
        n[k] = tokens
    at = TOKEN_LOW + TOKEN_BIN * (np.arange(TOKEN_BINS) + 0.5)
    if n[at > 0].sum() > 0 and (n * at).sum() < 0:
        low, high = 1e-3, 20.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (n * np.exp(mid * at)).sum() < n.sum() else (low, mid)
        model.scale = low
    model.log_k = model.scale * best - log_n - EULER


def _curve(seen: DataFrame, model: Model) -> None:
    """A logistic curve from the extreme-value statistic to the share of toxic calibration texts, from counts in fixed bins."""
    z = F.greatest(F.least(model.scale * F.col("best") - _log_n() - model.log_k, F.lit(HIGH)), F.lit(LOW))
    bins = seen.filter("toxic is not null").select(((z - LOW) / BIN).cast("int").alias("z"), "toxic")
    got = bins.groupBy("z", "toxic").count().collect()
    if len({r[1] for r in got}) < 2:
        return
    x, y, n = (np.array([float(f(r)) for r in got]) for f in (lambda r: LOW + BIN * (r[0] + 0.5), lambda r: r[1], lambda r: r[2]))
    middle, spread = np.average(x, weights=n), max(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)), 1e-6)
    design, beta = np.stack([np.ones_like(x), (x - middle) / spread], 1), np.zeros(2)
    for _ in range(50):  # Newton's method with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (y - p)) - [0, 0.1] * beta
        beta = beta + np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, 0.1]), slope)
    model.weight, model.offset = beta[1] / spread, beta[0] - beta[1] * middle / spread


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learn from all labelled rows given. Those of fold 1 calibrate, the others are counted; None without a labelled word.

    Labels other than 0 and 1 are ignored; where an id has several, the largest counts.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter("_toxic in (0, 1) and _id is not null")
    marks = marks.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(marks.hint("merge"), "_id")
    rows = rows.withColumn("_fold", fold(F.col("_id")))
    model = _count(rows.filter("_fold <> 1").select("_text", "_toxic"))
    if model:
        _calibrate(rows.filter("_fold = 1"), model)
    return model


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``score``, ``predicted``, ``surprise``, ``passages``.

    ``passages`` are the maximal segments that chance would give in fewer than ``SIGNIFICANT`` places of a text of this length: first
    word, word after the last, score, expected number. A NULL or empty text scores as a text without a hit. Without a model
    every score is 0. Rows may repeat, ids may be NULL, other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in parts(batches, "_text"):
            score, z, spans = np.zeros(len(texts)), np.zeros(len(texts)), [[] for _ in texts]
            if known:
                found, best, counts, _ = known.passages(texts)
                z = known.surprise(best, counts)
                score = 1 / (1 + np.exp(-np.clip(known.offset + known.weight * np.clip(z, LOW, HIGH), -30, 30)))
                for i, f in enumerate(found):
                    each = np.exp(-np.clip(known.surprise(np.array([s for *_, s in f]), np.full(len(f), counts[i])), -30, 300)) if f else ()
                    spans[i] = [{"start": a, "stop": b, "score": s, "expected": e} for (a, b, s), e in zip(f, each) if e < SIGNIFICANT]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(z), pa.array(spans, kind)],
                                             ["doc_id", "score", "predicted", "surprise", "passages"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return on_batches(rows, run, "doc_id long, score double, predicted int, surprise double, passages array<struct<start:long,stop:long,score:double,expected:double>>")


def toxicity_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside fold 0 and score all: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_passages``."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 0), labels)
    out = toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
