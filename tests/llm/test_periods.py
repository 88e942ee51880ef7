"""Periodic runs against brute force, on random texts, odd rows and an empty table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm.periods import merged, periodic_runs, re_pair, run_digest, runs_of


def brute_runs(words, exponent=4, length=6):
    """{(start, end): smallest period}, by comparing the words with themselves at every distance."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return out


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(rnd.randint(1, 6)):
        letters, words = rnd.choice([1, 2, 2, 3, 5, 50]), []
        while len(words) < rnd.randint(0, 160):
            unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 12))]
            words += (unit * rnd.randint(1, 9))[: rnd.randint(1, 90)] if rnd.random() < 0.4 else unit
        out.append(words)
    return out


def flat(some):
    code = np.array([c for w in some for c in w], np.int64)
    return code, np.repeat(np.arange(len(some)), [len(w) for w in some]), np.cumsum([0] + [len(w) for w in some])


@pytest.mark.parametrize("exponent,length", [(4, 6), (4, 1), (5, 9)])
def test_runs_equal_brute_force(exponent, length):
    for seed in range(120):
        some = texts(seed)
        code, row, bounds = flat(some)
        got = [{} for _ in some]
        for b, e, q in zip(*runs_of(code, row, exponent, length).tolist(), strict=True):
            got[row[b]][b - bounds[row[b]], e - bounds[row[b]]] = q
        assert got == [brute_runs(w, exponent, length) for w in some]


def test_grammar_derives_the_text():
    for seed in range(60):
        code, row, _ = flat(texts(seed))
        key = np.unique(row * 100 + code, return_inverse=True)[1]
        (rule, start, cut, end), left, right = re_pair(key, row)
        assert (start < cut).all() and (cut < end).all() and (row[start] == row[end - 1]).all()
        # the symbols that are left cover the text, and every use of a rule is the same words cut at the same place
        assert sorted(left.tolist()) == left.tolist() and (left[1:] == right[:-1]).all()
        seen = {}
        for r, a, b, c in zip(rule.tolist(), start.tolist(), cut.tolist(), end.tolist(), strict=True):
            assert seen.setdefault(r, (b - a, tuple(key[a:c]))) == (b - a, tuple(key[a:c]))


def test_merging():
    parts = np.array([[0, 8, 2], [4, 12, 2], [11, 19, 2], [0, 12, 4], [30, 38, 2]])
    assert merged(*parts.T).T.tolist() == [[0, 12, 2], [11, 19, 2], [30, 38, 2]]
    assert merged(*np.zeros((3, 0), np.int64)).shape == (3, 0)


def wanted(id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted((b, e - b, q) for (b, e), q in brute_runs(w).items())
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for b, size, q in found for i in range(b + q, b + size)}
    lines = "".join(f"{b},{size},{q}\n" for b, size, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_digest(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table in (docs, odd.where("doc_id is null or doc_id <> 11"), odd.where("doc_id = 12").selectExpr("doc_id", "repeat(text, 20) text")):
        got = sorted((tuple(r) for r in run_digest(table).collect()), key=str)
        assert got == sorted((wanted(*r) for r in table.select("doc_id", "text").collect()), key=str)
    assert run_digest(none).count() == 0


def test_interface(spark, odd):
    docs = spark.createDataFrame([(1, "a b a b a b a b c c c c c c c c c c"), (None, None)], "doc_id long, text string")
    one, nothing = sorted((r.asDict(True) for r in periodic_runs(docs).collect()), key=lambda r: -r["n_words"])
    assert one["runs"] == [{"start": 0, "length": 8, "period": 2}, {"start": 8, "length": 10, "period": 1}]
    assert one["strongest"]["period"] == 1 and one["collapsed"] == "a b c"
    assert nothing == {"doc_id": None, "n_words": 0, "runs": [], "strongest": None, "collapsed": ""}
    assert periodic_runs(odd).where("doc_id = 11").first()["n_words"] == 60_000
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=3)
