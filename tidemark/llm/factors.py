"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_j w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)): all pairs of features interact
through RANK factors, in time linear in the features that a text has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import U, Words, map_texts, positional, row_sums
from tidemark.session import cut_lineage

WORDS, BINS, RANK = 1 << 14, 8, 8
STATISTICS = ("log_words", "log_chars", "log_given_chars", "word_length", "symbols", "capitals", "marks", "bars", "digits",
              "breaks", "distinct", "neighbours")
FEATURES = WORDS + BINS * len(STATISTICS)


def statistics(w: Words, given: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; shares are of the bytes or words of the text, 0 in an empty one."""

    def share(chars: bytes) -> np.ndarray:
        return row_sums(np.isin(w.data, np.frombuffer(chars, np.uint8)), w.bounds) / np.maximum(size, 1)

    size = np.diff(w.bounds)
    letters = row_sums((w.data | 32) - 97 < 26, w.bounds)
    capitals = row_sums(w.data - np.uint8(65) < 26, w.bounds)
    order = np.lexsort((w.hash, w.row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    distinct = np.bincount(w.row[order][fresh], minlength=w.rows)
    echo = np.zeros(len(order), bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    words = np.maximum(w.count, 1)
    columns = [np.log1p(w.count), np.log1p(size), np.log1p(np.maximum(given, 0)), row_sums(w.end - w.start, w.offsets) / words, share(b"#*$%&<>@~^"),
               capitals / np.maximum(letters, 1), share(b"!?"), share(b"|"), share(b"0123456789"), share(b"\n"), distinct / words, row_sums(echo, w.offsets) / words]
    return np.stack(columns, 1)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the words of each text; a text's values have length 1."""
    cell, number = np.unique(w.row * WORDS + (w.hash & U(WORDS - 1)).astype(np.int64), return_counts=True)
    row = cell // WORDS
    value = np.log1p(number)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=w.rows))
    return row, cell % WORDS, value / norm[row]


class Machine:
    """Weights, factors and the bin borders of the statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 9):
        self.edges = edges
        self.bias, self.weight = 0.0, np.zeros(FEATURES)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (FEATURES, RANK))

    def inputs(self, words, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of all features, ordered by text."""
        row, bucket, value = words
        bins = np.stack([np.searchsorted(e, s) for e, s in zip(self.edges, stats.T, strict=True)], 1)
        place = WORDS + BINS * np.arange(len(STATISTICS)) + bins
        rows = np.concatenate([row, np.repeat(np.arange(len(stats)), len(STATISTICS))])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([bucket, place.ravel()])[order], np.concatenate([value, np.ones(place.size)])[order]

    def raw(self, row, feature, value, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the sigmoid, and the factor sums of each text. Every text has its statistics, so none is empty."""
        first = np.searchsorted(row, np.arange(texts))
        if not texts:
            return np.zeros(0), np.zeros((0, RANK))
        scaled = self.factor[feature] * value[:, None]
        sums = np.add.reduceat(scaled, first)
        squares = np.add.reduceat((scaled**2).sum(1), first)
        linear = np.add.reduceat(self.weight[feature] * value, first)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def learn(self, row, feature, value, label: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.1, decay: float = 1e-5) -> None:
        """Logistic loss by AdaGrad over `steps` small batches, in an order that the seed fixes."""
        rng = np.random.default_rng(7)
        first = np.searchsorted(row, np.arange(len(label) + 1))
        seen_w, seen_v, seen_b = np.full(FEATURES, 1e-8), np.full((FEATURES, RANK), 1e-8), 1e-8
        parts = max(1, len(label) // batch)
        for _ in range(-(-steps // parts)):
            for some in np.array_split(rng.permutation(len(label)), parts):
                at = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                r = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
                f, x = feature[at], value[at]
                raw, sums = self.raw(r, f, x, len(some))
                error = (1 / (1 + np.exp(-raw)) - label[some]) / len(some)
                g = error[r] * x
                touched, back = np.unique(f, return_inverse=True)
                grad_w = np.bincount(back, weights=g) + decay * self.weight[touched]
                each = g[:, None] * (sums[r] - self.factor[f] * x[:, None])
                grad_v = np.stack([np.bincount(back, weights=c) for c in each.T], 1) + decay * self.factor[touched]
                seen_w[touched] += grad_w**2
                seen_v[touched] += grad_v**2
                seen_b += error.sum() ** 2
                self.weight[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
                self.factor[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)

    def score(self, words, stats: np.ndarray) -> np.ndarray:
        raw, _ = self.raw(*self.inputs(words, stats), len(stats))
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def numbers(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(float))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Machine:
    """Learns from about `most` labelled documents, chosen by a hash of the id.

    docs: doc_id, text, n_chars; labels: doc_id, quality, one row for each document to learn from. Features of the sample,
    at most WORDS + statistics for each document, come to the driver; texts do not.
    """
    rows = labels.count()
    share = min(1.0, most / max(rows, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    sample = cut_lineage(labels.where(draw < share).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality")))
    # two numbers a row and a checked count: small enough to send to every task
    side = F.broadcast(sample) if sample.count() <= 2 * most else sample
    chosen = docs.join(side, F.col("doc_id") == F.col("_id")).select("text", F.col("n_chars").cast("double").alias("n_chars"), "quality")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0))
        row, bucket, value = word_features(w)
        first = np.searchsorted(row, np.arange(w.rows + 1))
        pick = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
        made = [batch.column(2), pa.array(list(statistics(w, numbers(batch.column(1)))), pa.list_(pa.float64())),
                pa.array([bucket[p] for p in pick], pa.list_(pa.int32())), pa.array([value[p] for p in pick], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(made, names=["quality", "stats", "buckets", "vals"])

    table = map_texts(chosen, "text", "quality double, stats array<double>, buckets array<int>, vals array<float>", run).toArrow()
    label = table["quality"].to_numpy()
    size = table["buckets"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    stats = table["stats"].combine_chunks().flatten().to_numpy().reshape(len(label), len(STATISTICS))
    # rows in an order of their own, whatever order the tasks ended in
    order = np.lexsort((label, *stats.T))
    bucket = table["buckets"].combine_chunks().flatten().to_numpy().astype(np.int64)
    value = table["vals"].combine_chunks().flatten().to_numpy().astype(float)
    begin = np.cumsum(size) - size
    pick = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(order)), size[order])
    quantile = np.linspace(0, 1, BINS + 1)[1:-1]
    machine = Machine(np.quantile(stats, quantile, axis=0).T if len(stats) else np.zeros((len(STATISTICS), BINS - 1)))
    if len(label):
        words = (row, bucket[pick], value[pick])
        machine.learn(*machine.inputs(words, stats[order]), label[order])
    return machine


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.3, back: list[str] | None = None) -> DataFrame:
    """Columns of `docs` under names by place (all, or those of `back`), with score and predicted.

    Scoring reads the text and n_chars alone. A text goes to Python once, and returns only if it is asked for.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    plain, names, fields = positional(docs)
    text, given = (docs.columns.index(c) for c in ("text", "n_chars"))
    keep = [i for i, c in enumerate(docs.columns) if back is None or c in back]
    sent = [*keep, *({text, given} - set(keep))]
    table = plain.select(*(F.col(names[i]).cast("string" if i == text else fields[i].dataType).alias(names[i]) for i in sent))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(sent.index(text)))
        score = held.value.score(word_features(w), statistics(w, numbers(batch.column(sent.index(given)))))
        made = [*(batch.column(i) for i in range(len(keep))), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(made, names=[*(names[i] for i in keep), "score", "predicted"])

    kept = [T.StructField(names[i], T.StringType() if i == text else fields[i].dataType) for i in keep]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(table, names[text], schema, run)


def remainder(id: Column) -> Column:
    return F.crc32(id.cast("string")) % 5


def machine_for(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Machine:
    """Learns from labelled documents whose crc32(doc_id) modulo 5 is not 0; several labels of one document are averaged."""
    some = labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    return fit(docs.select("doc_id", "text", "n_chars"), some, most)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text, n_chars).

    Null and empty texts are scored by their statistics, a null n_chars counts as 0. Without labels every score is 1/2 or
    near it. Repeated rows stay; an empty table gives none; other columns are not read.
    """
    rest = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("held_out"), "text", "n_chars")
    return scored(table, machine_for(docs, labels, most), back=["doc_id", "held_out"]).select(F.col("_c0").alias("doc_id"), F.col("_c1").alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """The rows of `docs` that are predicted to be good, with all their columns; see `quality_scores`."""
    kept = scored(docs, machine_for(docs, labels, most)).where("predicted = 1").drop("score", "predicted")
    return kept.toDF(*docs.columns)
