"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import U, blocks, map_texts, mix

SIZES = (1, 2, 3)
MODEL_BYTES = 32_000_000
UNDETERMINED = "und"


def grams(texts: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every character n-gram; texts are in lower case, white space counts as one blank."""
    lower = [" " + " ".join(t.lower().split()) + " " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(lower)), np.fromiter(map(len, lower), np.int64, len(lower)))
    out, rows = [], []
    code = np.zeros(len(points), np.uint64)
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * U(0x110000) + points[n - 1 :] + U(1)
        inside = row[:m] == row[n - 1 :]
        out.append((mix(code[inside] + U(n << 60)) & U(dim - 1)).astype(np.int64))
        rows.append(row[:m][inside])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def dimension(languages: int) -> int:
    """Buckets: 2^15, halved while the matrix of doubles would be above MODEL_BYTES, so the broadcast is bounded."""
    dim = 1 << 15
    while dim > 256 and dim * languages * 8 > MODEL_BYTES:
        dim //= 2
    if dim * languages * 8 > MODEL_BYTES:
        raise ValueError(f"{languages} languages are too many for a model of {MODEL_BYTES} bytes")
    return dim


class Model:
    """Log probabilities by language and bucket."""

    def __init__(self, languages: list[str], prior: np.ndarray, logs: np.ndarray):
        self.languages, self.prior, self.logs = languages, prior, logs

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the best language, its posterior) of each text; counts of a few texts at a time meet the matrix."""
        dim = len(self.logs)
        bucket, row = grams(texts, dim)
        log = np.tile(self.prior, (len(texts), 1))
        # sparse counts: the buckets that a text has, with their numbers
        cell, number = np.unique(row * dim + bucket, return_counts=True)
        at = cell // dim
        first = np.searchsorted(at, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            log[i] += number[a:b] @ self.logs[cell[a:b] - i * dim]
        best = log.argmax(1)
        top = log.max(1, keepdims=True)
        return best, 1.0 / np.exp(log - top).sum(1)


def fit(labelled: DataFrame, per_language: int = 2000) -> Model:
    """Learns from (text, lang, key): about `per_language` rows of each language, chosen by a hash of `key`.

    One sum for each language and bucket comes to the driver, so the model's size does not depend on the rows.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((256, 0)))
    dim = dimension(len(languages))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    draw = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(draw < share[F.col("lang")]).select("text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) * dim, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                bucket, row = grams([t or "" for t in part.column(0).to_pylist()], dim)
                of = np.array([number[k] for k in part.column(1).to_pylist()], np.int64)
                total += np.bincount(of[row] * dim + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]])], names=["cell", "n"])

    summed = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(len(languages) * dim)
    seen[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(float)
    seen = seen.reshape(len(languages), dim).T + 0.5
    prior = np.log(np.array([counts[k] for k in languages]) / sum(counts.values()))
    return Model(languages, prior, np.log(seen / seen.sum(0)))


def identified(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text).

    A null text, or one without a letter, is undetermined with score 0, and so is every text if no language was learned.
    Ties go to the language first in order. Repeated rows stay; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), letter.alias("letter"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        texts = [t or "" for t in batch.column(3).to_pylist()]
        letter = batch.column(2).to_numpy(zero_copy_only=False)
        if m.languages:
            best, score = m.score(texts)
            names = pd.Series(m.languages, dtype=object).to_numpy()[best]
        else:
            score, names, letter = np.zeros(len(texts)), np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts), bool)
        made = [batch.column(0), batch.column(1), pa.array(np.where(letter, names, UNDETERMINED), pa.string()), pa.array(np.where(letter, score, 0.0))]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "held_out", "lang_pred", "score"])

    return map_texts(table, "text", "doc_id long, held_out boolean, lang_pred string, score double", run)


def remainder(docs: DataFrame, parts: int) -> Column:
    return F.crc32(docs["doc_id"].cast("string")) % parts


def language_of(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """Learns from rows with a language whose crc32(doc_id) modulo 4 is not 2, and predicts all rows; see `identified`."""
    rest = remainder(docs, 4)
    labelled = docs.where(rest.isNotNull() & (rest != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(labelled.select("text", "lang", F.col("doc_id").alias("key")), per_language)
    return identified(docs, model, rest == 2)
