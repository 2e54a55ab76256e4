"""A quality classifier learned from trusted positives and unlabelled text: non-negative unbiased risk, linear model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import blocks_of, hashed_texts, slices, thinned, written

#: Most positives that a fit uses, picked by a hash of doc_id; all unlabelled rows are used.
LABELLED_ROWS = 50_000
#: Newton steps of the fits that the prior is estimated with, and of the last; the ridge, over the root of the number of positives.
PRIOR_STEPS, STEPS, RIDGE = 6, 12, 0.06
#: Shares of the positives below the cuts that the prior is estimated at, and the bound of standardised features.
CUTS, REACH = np.linspace(0, 0.5, 26), 8.0
ACCEPT = 0.7
_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r\x0b\f", 5), (b".,;:?", 6), (b"!", 7), (b"|", 8), (b"#$%&*@~^", 9), (b"<>[]{}()/\\=_+-", 10), (b"'\"`", 11)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
RAW = 20


def text_features(texts: list[bytes]) -> np.ndarray:
    """RAW numbers of each whole text: shares of kinds of characters, repetition of words and lines, lengths.

    An empty text has zeros; the last is 1 for a text without words."""
    out = np.zeros((len(texts), RAW))
    at = 0
    for low, high in blocks_of(texts):
        block = texts[low:high]
        words, counts = hashed_texts(block)
        begin = 0
        for t, n in zip(block, counts.tolist()):
            h = words[begin : begin + n]
            begin += n
            row = out[at]
            at += 1
            size = len(t)
            if not n:
                row[RAW - 1] = 1
                continue
            kinds = np.bincount(_CLASS[np.frombuffer(t, dtype=np.uint8)], minlength=13) / size
            row[:13] = kinds
            row[13] = len(np.unique(h)) / n
            row[14] = (h[1:] == h[:-1]).mean() if n > 1 else 0
            pairs = h[1:] * np.uint64(3) + h[:-1]
            row[15] = len(np.unique(pairs)) / max(1, n - 1)
            row[16] = np.log1p(n) / 10
            row[17] = min(size / n / 20, 2)
            lines = [x for x in t.split(b"\n") if x]
            row[18] = len(set(lines)) / max(1, len(lines))
    return out


def expanded(raw: np.ndarray) -> np.ndarray:
    """Raw numbers with their square roots, squares, and a constant."""
    return np.hstack([np.ones((len(raw), 1)), raw, np.sqrt(np.maximum(raw, 0)), raw * raw])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep`, and _f: the RAW numbers of the text (null: empty). No other column is read."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "_f array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in slices(big)):
            x = text_features([(t or "").encode() for t in b.column(b.num_columns - 1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, RAW * (len(x) + 1), RAW), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "_f"])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("_text")).mapInArrow(run, schema)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _softplus(x):
    return np.logaddexp(0, x)


class Model:
    """A linear model over standardised, expanded features."""

    def __init__(self, mean, scale, weights, prior=0.5):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def matrix(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((expanded(raw) - self.mean) / self.scale, -REACH, REACH)
        x[:, 0] = 1
        return x

    def score(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(self.matrix(raw) @ self.weights)


def _sums(table: DataFrame, make, width: int) -> np.ndarray:
    """The sum over all rows of what make(raw) returns, `width` numbers; a partition sends them once."""

    def run(batches):
        total = np.zeros(width)
        for b in batches:
            if len(b):
                total += make(np.stack(b["_f"].to_numpy()))
        yield pd.DataFrame({"k": np.arange(width), "v": total})

    rows = table.select("_f").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def risk_parts(w: np.ndarray, unlabelled: tuple[float, np.ndarray], positives: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased risk with the logistic loss, and their gradients.

    unlabelled: the mean loss of the unlabelled rows as negatives, and its gradient."""
    z = positives @ w
    positive, g_positive = prior * _softplus(-z).mean(), -prior * (positives.T @ _sigmoid(-z)) / len(z)
    negative, g_negative = unlabelled[0] - prior * _softplus(z).mean(), unlabelled[1] - prior * (positives.T @ _sigmoid(z)) / len(z)
    return positive, negative, g_positive, g_negative


def least_risk(sums, fits: list[tuple[np.ndarray, float]], width: int, ridge: float, steps: int) -> list[np.ndarray]:
    """The weights of the least non-negative risk for each (positives, prior) of fits, by Newton steps side by side.

    sums(weights) gives, for each weights, the mean loss of unlabelled rows as negatives, its gradient and its second
    derivatives. Where the negative part of the risk falls below 0, a step goes back up its gradient, as the method
    asks; the weights of the smallest risk on the way count, with the negative part taken as 0 at least."""
    w = [np.zeros(width) for _ in fits]
    best = [(np.inf, x) for x in w]
    penalty = np.full(width, ridge)
    penalty[0] = 1e-6
    for step in range(steps + 1):
        for k, ((p, prior), (loss, gradient, second)) in enumerate(zip(fits, sums(w))):
            positive, negative, g_positive, g_negative = risk_parts(w[k], (loss, gradient), p, prior)
            risk = positive + max(0.0, negative) + ridge / 2 * (w[k][1:] ** 2).sum()
            if risk < best[k][0]:
                best[k] = risk, w[k]
            h = second + np.diag(penalty + 1e-6)
            g = -g_negative if negative < 0 else g_positive + g_negative + penalty * w[k]
            d = np.linalg.solve(h, g)
            size = np.sqrt(max(d @ h @ d, 1e-18))
            w[k] = w[k] - (0.3 if negative < 0 else 1.0) * min(1.0, 1 / size) * d
        if step >= 4 and all(b is not x and abs(b - x).max() < 1e-9 for (_, b), x in zip(best, w)):
            break
    return [x for _, x in best]


def prior_of(share_unlabelled: np.ndarray, share_positive: np.ndarray, n: int, m: int) -> float:
    """The share of positives among unlabelled rows: no cut of a score can leave a smaller share of the unlabelled rows
    above it than the prior times that of the positives. The cut with the best bound, noise allowed for, decides."""
    margin = np.sqrt(np.log(40) / 2 / max(1, n)) + np.sqrt(np.log(40) / 2 / max(1, m))
    k = int(np.argmin((share_unlabelled + margin) / share_positive))
    return float(np.clip(share_unlabelled[k] / share_positive[k], 0.02, 0.98))


def fit(unlabelled: DataFrame, labelled: DataFrame, steps: int = STEPS, bound: int = LABELLED_ROWS) -> Model:
    """Fits on a table of unlabelled features (_f) and on labelled rows (doc_id, _f, label); of the positives `bound` at
    most, and of the other labels none.

    The risk is prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]), with the logistic loss. The class prior is
    estimated from positives and unlabelled rows alone (prior_of): two fits, each on half of the positives, score the
    other half and all unlabelled rows. Every step sums over all unlabelled rows on the executors; the driver holds sums
    only. Without positives the score is 0.5."""
    known = labelled.where("label = 1")
    rows = thinned(known, "doc_id", bound).orderBy(F.xxhash64("doc_id"), "doc_id", "_f").limit(bound).collect()
    raw = np.array([r["_f"] for r in rows]).reshape(-1, RAW)
    width = 1 + 3 * RAW
    sums = _sums(unlabelled, lambda x: np.concatenate([[len(x)], expanded(x).sum(0), (expanded(x) ** 2).sum(0)]), 1 + 2 * width)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + width] / n
    scale = np.sqrt(np.maximum(sums[1 + width :] / n - mean**2, 0))
    scale[scale < 1e-6 * (1 + np.abs(mean))] = 1  # no more than the rounding of the sums
    mean[0], scale[0] = 0, 1
    frame = Model(mean, scale, np.zeros(width))
    if not len(raw) or not sums[0]:
        return frame
    p = frame.matrix(raw)
    ridge = RIDGE / np.sqrt(len(p))

    def over_all(weights: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        table = np.stack(weights, 1)

        def part(raw):
            x = frame.matrix(raw)
            z = x @ table
            q = _sigmoid(z)
            return np.concatenate([y for k in range(z.shape[1]) for y in ([_softplus(z[:, k]).sum()], x.T @ q[:, k], ((x * (q[:, k] * (1 - q[:, k]))[:, None]).T @ x).ravel())])

        each = 1 + width + width * width
        got = _sums(unlabelled, part, each * len(weights)).reshape(-1, each) / n
        return [(g[0], g[1 : 1 + width], g[1 + width :].reshape(width, width)) for g in got]

    prior = 0.5
    if len(p) > 1:
        halves = [(p[k::2], prior) for k in (0, 1)]
        weights = least_risk(over_all, halves, width, max(ridge, 0.02), PRIOR_STEPS)
        cuts = [np.quantile(p[1 - k :: 2] @ w, CUTS) - 1e-6 for k, w in enumerate(weights)]  # the positives are among the rows: rounding must not part them
        table = np.stack(weights, 1)

        def above(raw):
            z = frame.matrix(raw) @ table
            return np.concatenate([(z[:, k, None] >= cuts[k]).sum(0) for k in (0, 1)])

        of_all = _sums(unlabelled, above, 2 * len(CUTS)).reshape(2, -1).mean(0) / n
        of_positives = np.mean([(p[1 - k :: 2] @ w >= cuts[k][:, None]).mean(1) for k, w in enumerate(weights)], axis=0)
        prior = prior_of(of_all, of_positives, len(p), int(n))
    (w,) = least_risk(over_all, [(p, prior)], width, ridge, steps)
    return Model(mean, scale, w, prior)


def learnt_rows(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: (doc_id, label) where crc32 of doc_id as text is not 2 modulo 4.

    A doc_id with several labels counts as positive if any of them is."""
    rows = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("quality").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("quality").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] = ("doc_id",)) -> tuple[DataFrame, Model]:
    """Columns `keep` and score of every row of docs, and the model, which the driver fits right here.

    The features go to a table in the shared folder once; fitting and scoring read that. Null and empty texts are scored
    as texts without words; repeated rows have a row each, and rows with one doc_id enter the fit as one, by the smaller
    features. A kept column named score gives way to the score; an empty table gives none."""
    keep = [c for c in keep if c != "score"]
    table = written(features(docs, list(dict.fromkeys([*keep, "doc_id"]))), "features")
    known = table.join(learnt_rows(labels), "doc_id").groupBy("doc_id").agg(F.min("_f").alias("_f"), F.first("label").alias("label"))
    model = fit(table, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, RAW)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*b.schema.names[:-1], "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return table.select(*[f"`{c}`" for c in keep], "_f").mapInArrow(run, schema), model


def keep_good(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """docs without those that score below `least`; texts are read a second time, by the fitted model. Rows with a null
    doc_id or text are judged by their text as all others are, repeated ones each for itself. Without positive labels to
    learn from nothing is rejected."""
    _, model = score_documents(docs.select("doc_id", "text"), labels)
    if not model.weights.any():
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in slices(big)):
            x = text_features([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(model.score(x) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, _ = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
