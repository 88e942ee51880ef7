"""Phrases against brute force, on random texts, odd rows and an empty table."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as module
from tidemark.llm.collocations import GAP, Sieve, Tokens, collocations, extended, first_of_each, hot_keys, sieve_of, stripe_batches

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(table, least, longest=5, percent=100, most=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered[p[i : i + n]], a)
        rows = []
        for p, a in found.items():
            if p in covered and 100 * covered[p] >= percent * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(rows[:most])]
    return sorted(out)


def texts(seed, number=60):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "É", "é", "d-e", "日本", "x" * 50, "\x1f", "A"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r"]
    return [(rnd.choice(["en", "de", None, "und", ""]), "".join(x for _ in range(rnd.randint(0, 80)) for x in (rnd.choice(words[: rnd.randint(2, 10)]), rnd.choice(marks)))) for _ in range(number)] + [("en", None), ("fr", " .,")]


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("options", [{"least": 3}, {"least": 1, "longest": 3}, {"least": 5, "longest": 6, "percent": 80}, {"least": 2, "most": 7}, {"least": 4, "bits": 10}])
def test_phrases(spark, options):
    table = texts(len(options))
    docs = spark.createDataFrame(table, "lang string, text string").repartition(3)
    plain = {k: v for k, v in options.items() if k != "bits"}
    assert got(collocations(docs, **options)) == brute(table, **plain)


def test_odd_and_empty(spark, odd, none):
    table = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert got(collocations(odd, least=2)) == brute(table, 2)
    assert collocations(none).count() == 0 and collocations(odd.where("text is null")).count() == 0
    # nothing is frequent
    assert collocations(odd.where("doc_id = 4")).count() == 0


def test_large_products(spark):
    # 400,000 pairs: 1000 a n needs more than 32 bits, and the order of equal rows is by bytes
    rows = spark.range(4000).select(F.lit("en").alias("lang"), F.expr("repeat('big deal. Zoo keeper; ', 100)").alias("text"))
    assert got(collocations(rows)) == [("en", 1, "big deal", 400_000, 400_000, 400_000, 1_600_000, 4000), ("en", 2, "zoo keeper", 400_000, 400_000, 400_000, 1_600_000, 4000)]


def test_tokens_and_keys():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["a b. c d", "a b", "c d"])], names=["lang", "text"])
    t = Tokens(batch)
    assert t.within(2).tolist() == [True, False, True, False, True, False, True] and GAP.sum() == 12
    keys = t.keys(2)
    assert keys[2] == keys[6] and keys[0] != keys[4] and len(t.keys(9)) == 0
    assert extended(extended(t.base[:1], t.id[:1]), t.id[1:2])[0] == keys[0]


def test_sieve_lets_all_of_its_own_through():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    cells = np.zeros(1 << 10, np.uint64)
    cell, bit = Sieve.bits(key, 16)
    np.bitwise_or.at(cells, cell, bit)
    assert Sieve(cells)(key).all() and Sieve(cells)(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.1


def test_hot_prefixes_are_split(spark):
    # one word has a third of all places: its stripe is dealt to many tasks, and the counts stay whole
    table = [("en", " ".join(f"the w{(i * 7 + j) % 40} v{j}" for j in range(60))) for i in range(50)]
    docs = spark.createDataFrame(table, "lang string, text string").repartition(5)
    assert got(collocations(docs, least=4)) == brute(table, 4)
    phrases = spark.createDataFrame([("en", [5], 999), ("en", [6, 7], 1), ("de", [-1], 1000)], "lang string, ids array<long>, f long")
    assert len(hot_keys(phrases, 999_500)) == 1 and len(hot_keys(phrases.where("f > 5000"), 1)) == 0


def test_first_of_each(spark):
    rows = spark.createDataFrame([("k", f"p{i:03}", i % 5) for i in range(200)], "key string, phrase string, a long")
    order = [F.col("a").desc(), F.col("phrase")]
    want = sorted((-(i % 5), f"p{i:03}") for i in range(200))[:17]
    found = sorted((r["rank"], r["phrase"]) for r in first_of_each(rows.repartition(7), "key", order, 17).collect())
    assert found == [(i + 1, p) for i, (_, p) in enumerate(want)]


def test_stripes_are_added_over_the_blocks_of_a_task(spark, monkeypatch):
    # a phrase that every block has is handed on once, not once for each block
    pairs = spark.createDataFrame([("en", [i, i + 1]) for i in range(4)] + [("de", [1, 2])], "lang string, ids array<long>")
    sieve = sieve_of(pairs, 16)

    def block(*rows):
        t = Tokens(pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["lang", "text"]))
        t.word_id = np.array([int(x) for x in t.distinct.cast(pa.binary()).cast(pa.string()).to_pylist()], np.uint64)
        t.id = t.word_id[t.code]
        return t

    def found(held, hot=()):
        monkeypatch.setattr(module.Stripes.__init__, "__defaults__", (held,))
        blocks = [block(("en", "0 1 2 3 4. 9 1 2 3"), ("de", "1 2 3")), block(("en", "1 2 3 7")), block(("en", "5 5 5"))] * 20
        made = [x for x in stripe_batches(iter(blocks), range(2, 4), sieve, 2, {2: np.array(hot, np.uint64), 3: np.zeros(0, np.uint64)}) if x is not None]
        counts = Counter()
        for batch in made:
            for r in batch.to_pylist():
                for word, n in zip(r["next"], r["counts"], strict=True):
                    counts[r["lang"], *r["prefix"], word] += n
        return counts, sum(x.num_rows for x in made)

    want = Counter({("en", 0, 1, 2): 20, ("en", 1, 2, 3): 60, ("en", 2, 3, 4): 20, ("en", 0, 1, 2, 3): 20, ("en", 1, 2, 3, 4): 20})
    counts, rows = found(module.HELD)
    assert counts == want and rows == 5
    assert found(3)[0] == want and 5 < found(3)[1]
    hot = block(("en", "1 2")).keys(2)
    assert found(module.HELD, hot) == (want, 5)


def test_rare_phrases_of_frequent_pairs_make_no_stripes(spark):
    # every pair of neighbours is frequent, but only one phrase of three words is; the others are left out before they are counted
    words = [f"w{i}" for i in range(12)]
    rare = [("en", f"{a} {b} {c}") for a in words for b in words for c in words]
    table = rare + [("en", "w1 w2 w3 w4 w5")] * 40
    docs = spark.createDataFrame(table, "lang string, text string").repartition(3)
    assert got(collocations(docs, least=20)) == brute(table, 20)
    pairs = module.word_stripes(docs, 20)[1]
    sieve = sieve_of(pairs, 20)
    cells = module.full_cells(docs, 5, sieve, 2, 20, 20)
    none = np.zeros(0, np.uint64)
    t = Tokens(pa.RecordBatch.from_pylist([{"lang": lang, "text": text} for lang, text in table]))
    assert not cells(t.keys(3)[t.within(3)][:100]).all() and cells(t.keys(5)[-5:][-1:]).all()
    made = [x for x in stripe_batches(iter([t]), range(2, 5), sieve, 2, dict.fromkeys(range(2, 5), none), cells) if x is not None]
    entries = sum(len(x["counts"].flatten()) for x in made)
    # three phrases of three words, two of four and one of five, and few that share their cells
    assert 6 <= entries <= 12


def test_cells_add_up_over_blocks_and_lengths(spark):
    # 7 texts in 7 tasks: no task has the 7 occurrences alone, and a cell of any range is found again
    table = [("en", "a b c d"), ("de", "a b c")] * 7
    docs = spark.createDataFrame(table, "lang string, text string").repartition(7)
    sieve = sieve_of(module.word_stripes(docs, 7)[1], 16)
    t = Tokens(pa.RecordBatch.from_pylist([{"lang": lang, "text": text} for lang, text in table[:2]]))
    for bits in (8, 16, 20):
        for least, full in ((7, True), (15, False)):
            cells = module.full_cells(docs, 4, sieve, 2, least, bits)
            assert len(cells.cells) == 1 << bits - 6
            if full or bits > 8:
                assert cells(t.keys(3)[[0, 4]]).all() == full and cells(t.keys(4)[:1])[0] == full


def test_cells_are_added_over_the_blocks_of_a_task(spark):
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": f"a b c{i % 5}"} for i in range(20)])
    t = Tokens(batch)
    every = Sieve(np.full(1 << 10, ~np.uint64(0)))

    def found(held):
        made = [x for x in module.cell_batches(iter([t] * 6), 3, every, 2, 20, held) if x is not None]
        counts = Counter()
        for batch in made:
            for r in batch.to_pylist():
                for cell, n in zip(np.frombuffer(r["cells"], "<u2"), np.frombuffer(r["counts"], "<u4"), strict=True):
                    counts[r["range"], int(cell)] += int(n)
        return counts, len(made)

    counts, batches = found(1000)
    # five phrases, 24 times each, handed on once
    assert batches == 1 and sum(counts.values()) == 120 and sorted(counts.values()) == [24] * 5
    assert found(2) == (counts, 6)
