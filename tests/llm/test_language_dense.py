"""Language scores against dense counts of every n-gram, one text at a time."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.language import SIZES, dimension, language_of
from tidemark.llm.text import U, mix


def buckets(text, dim):
    """How often a text has each bucket: its n-grams of characters, by the rule of their hash."""
    out, low = Counter(), " " + " ".join(text.lower().split()) + " "
    for n in SIZES:
        for i in range(len(low) - n + 1):
            code = 0
            for c in low[i : i + n]:
                code = (code * 0x110000 + ord(c) + 1) % (1 << 64)
            out[int(mix(np.array([(code + (n << 60)) % (1 << 64)], np.uint64))[0] & U(dim - 1))] += 1
    return out


def dense(table, held_out):
    learned = [(text, lang) for id, text, lang in table if text is not None and lang is not None and id in held_out and not held_out[id]]
    languages = sorted({lang for _, lang in learned})
    dim = dimension(len(languages))
    counts = defaultdict(lambda: np.full(dim, 0.5))
    rows = Counter(lang for _, lang in learned)
    for text, lang in learned:
        for bucket, n in buckets(text, dim).items():
            counts[lang][bucket] += n
    logs = {k: np.log(counts[k] / counts[k].sum()) for k in languages}
    out = []
    for id, text, _ in table:
        if text is None or not any(c.isalpha() for c in text):
            out.append((id, "und", 0.0))
            continue
        seen = np.zeros(dim)
        for bucket, n in buckets(text, dim).items():
            seen[bucket] = n
        log = np.array([math.log(rows[k] / len(learned)) + seen @ logs[k] for k in languages])
        out.append((id, languages[int(log.argmax())], 1 / np.exp(log - log.max()).sum()))
    return sorted(out, key=str)


def test_scores_equal_dense_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang").limit(60)
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "1 2 3 !", "de"), (9003, "", None), (9004, "Äther É 日本", "fr"), (9005, "a", "en")], docs.schema)
    table = docs.unionByName(odd).checkpoint()
    held_out = {r[0]: r[1] for r in table.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).collect()}
    want = dense([tuple(r) for r in table.collect()], held_out)
    got = sorted((tuple(r) for r in language_of(table).select("doc_id", "lang_pred", "score").collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)
