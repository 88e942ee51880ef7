"""Operators over documents against brute force, on odd rows, empty tables and the smallest given tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import tiktoken
from oracle_check import compare, duck
from pyspark.sql import functions as F

from tidemark.llm.bpe import codec, encoded
from tidemark.llm.factors import good_documents, quality_scores
from tidemark.llm.graph import components
from tidemark.llm.jaccard import bands_for, linked, one_of_each
from tidemark.llm.language import language_of
from tidemark.llm.licenses import TEMPLATES, differences, licenses, statements, words
from tidemark.llm.mixture import mixed_documents, mixture, taken_words
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.repetition import quality_rules
from tidemark.llm.substrings import without_repeats
from tidemark.llm.text import Words, ngram_hash, row_ngrams

BASE = "/root/testdata/sf0.001"
PATH, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BASE}/labels.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, _, _, note = compare(spark, duck(BASE), name, QUERIES[name], ORACLES[name], BASE)
    assert ok, note


def test_words_and_hashes():
    w = Words(pa.array(["a  bb\tc", None, "", "bb", " c a", "é日"]))
    assert w.count.tolist() == [3, 0, 0, 1, 2, 1]
    assert w.hash[1] == w.hash[3] and w.hash[0] == w.hash[5] and w.hash[2] == w.hash[4] and len(set(w.hash.tolist())) == 4
    h = np.arange(50, dtype=np.uint64)
    for n in range(1, 20):
        same = ngram_hash(np.concatenate([h, h]), n)
        assert (same[: 50 - n + 1] == same[50:]).all() and len(set(same[: 50 - n + 1].tolist())) == 50 - n + 1
    assert row_ngrams(w, 2)[1].tolist() == [0, 1, 4]


def thue_morse(n, flip):
    """A word of n letters: by the parity of the bits of its places, or the other way round."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.fixture(scope="module")
def twins(spark):
    """Long words that polynomial hashes modulo a power of two confuse."""
    table = []
    for k, n in enumerate((1024, 2048, 4096)):
        a, b = thue_morse(n, 0), thue_morse(n, 1)
        rest = " ".join(f"x{k}y{i}" for i in range(12))
        table += [(10 * k + 1, f"{a} {rest}"), (10 * k + 2, f"{b} {rest}"), (10 * k + 3, f"{a} v w {b} v w u"), (10 * k + 4, f"{a}\n{b}\n{a}")]
    return spark.createDataFrame(table, "doc_id long, text string")


def test_long_words_do_not_collide(twins):
    table = [tuple(r) for r in twins.collect()]
    assert sorted((tuple(r) for r in without_repeats(twins, digest=True).collect()), key=str) == later_windows(table)
    assert sorted((tuple(r) for r in linked(twins).collect()), key=str) == brute_links(table)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec(PATH, PATTERN).ranks, special_tokens={})
    want = [(i, hashlib.sha256(np.array(reference.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in table]
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded(twins, PATH, PATTERN).collect()) == want
    rules = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules(twins).collect()}
    assert [rules[10 * k + j] for k in range(3) for j in (3, 4)] == [(0, 0), (0, 1)] * 3


def later_windows(table, size=13):
    first = {}
    for i, t in table:
        w = split(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in table:
        w, gone = split(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [400_000, 3])
def test_substrings(docs, odd, none, group):
    for table in (docs, odd):
        got = sorted((tuple(r) for r in without_repeats(table, group=group, digest=True).collect()), key=str)
        assert got == later_windows([tuple(r) for r in table.select("doc_id", "text").collect()])
    assert without_repeats(none, digest=True).count() == 0


def test_substrings_keep_columns(odd, none):
    cut = without_repeats(odd)
    assert cut.schema.fieldNames() == odd.schema.fieldNames()
    got = {r["doc_id"]: r for r in cut.collect()}
    assert 13 in got and 7 in got and 15 not in got and 20 not in got and got[1]["text"] is None and got[14]["text"] == "w1"
    assert len(split(got[8]["text"])) == 40 and got[8]["n_chars"] == len(got[8]["text"])
    assert got[16]["text"] == "\x00\x1f é 日本 😀 ‍" and got[16]["_c0"] == "x" and got[16]["_text"] == "y"
    assert without_repeats(none).count() == 0


def brute_links(table, n=5, threshold=0.8):
    def shingles(t):
        w = split(t)
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t) if i is not None else frozenset()) for i, t in table]
    links, edges = Counter(), defaultdict(set)
    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if s and t and len(s & t) / len(s | t) >= threshold:
                links[a] += 1
                links[b] += 1
                edges[a].add(b)
                edges[b].add(a)
    out = []
    for a, (i, _) in enumerate(sets):
        seen, todo = {a}, [a]
        while todo:
            for b in edges[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((i, None if i is None else min(sets[b][0] for b in seen), links[a]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [500_000, 200])
def test_jaccard(docs, odd, none, tile):
    for table in (docs, odd):
        got = sorted((tuple(r) for r in linked(table, tile=tile).collect()), key=str)
        assert got == brute_links([tuple(r) for r in table.select("doc_id", "text").collect()])
    assert linked(none).count() == 0


def test_one_of_each(odd, none):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and one_of_each(none).count() == 0
    ids = sorted(r["doc_id"] for r in kept.collect())
    want = brute_links([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert ids == sorted({i for i, c, _ in want if i is not None and i == c})


def test_one_of_each_text_of_an_id(spark):
    near, clean = (" ".join(f"{c}{i * i % 997}" for i in range(80)) for c in "vw")
    table = [(1, near), (2, near + " w1"), (2, clean), (2, clean), (3, None), (3, ""), (3, "one two"), (None, near), (None, "none"), (None, "none")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = [(1, near), (2, clean), (3, None), (3, ""), (3, "one two")]
    assert sorted(map(tuple, one_of_each(docs).collect()), key=str) == sorted(want, key=str)
    want += [(None, near), (None, "none"), (None, "none")]
    assert sorted(map(tuple, one_of_each(docs, unnamed=True).collect()), key=str) == sorted(want, key=str)


def test_bands_reach_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, n = bands_for(threshold, 0.999, 128)
        assert 1 - (1 - threshold**n) ** bands >= 0.999 and bands * n <= 128
    with pytest.raises(ValueError):
        bands_for(0.1, 0.9999, 10)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe(docs, odd, none):
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec(PATH, PATTERN).ranks, special_tokens={})
    for table in (docs, odd.where("length(text) < 100000 or text is null")):
        want = []
        for i, t in table.select("doc_id", "text").collect():
            ids = reference.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(tuple, encoded(table, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    long = rows(encoded(odd.where("doc_id = 10"), PATH, PATTERN, keep_ids=True))[0]
    assert long["decoded_sha256"] == hashlib.sha256(b"x" * 1_200_000).hexdigest() and len(long["ids"]) == 4 * long["n_tokens"]
    assert encoded(none, PATH, PATTERN).count() == 0


def test_bpe_trees_and_pretokens():
    coder = codec(PATH, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    pieces = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "1", "'s", "'re", "'ll", "'", "!!", "\t", "\x1c", "\x85", " ", "​", "日本", "😀"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(list("abcdefghinorst"), rng.integers(33, 500))) for _ in range(60)]
    texts += ["ab" * 2000, "a" * 3001, "=-" * 300 + "=" * 257, "日本語のテキスト" * 90, "", "'s", "x's", " 's", "''s", "'S"]
    for t in texts:
        got = coder.encode(t)
        assert got == reference.encode_ordinary(t), repr(t)
        assert coder.decode_block(np.array(got, np.int64))[0].tobytes() == t.encode()


def test_bpe_by_another_pattern():
    pattern = r"\p{L}+|\p{N}|[^\p{L}\p{N}]+"
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec(PATH, PATTERN).ranks, special_tokens={})
    for t in ("don't 12 a", "", "é日本 x\n\n1"):
        assert codec(PATH, pattern).encode(t) == reference.encode_ordinary(t)


def brute_rules(text):
    w = split(text)

    def inside(n, first):
        seen, at = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)), set()
        met = set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if seen[g] > 1 and (first or g in met):
                at.update(range(i, i + n))
            met.add(g)
        return at

    lines = [x for x in (text or "").split("\n") if split(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, w))
    repeat = len(inside(3, True))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    kept = not failed and 100 * sum(len("".join(split(x))) for x in again) <= 20 * chars
    for n, most in ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)):
        kept = kept and 100 * sum(len(w[i]) for i in inside(n, False)) <= most * chars
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(again), repeat, failed, kept


def test_quality_rules(odd, none):
    want = sorted(((i, *brute_rules(t)) for i, t in odd.select("doc_id", "text").collect()), key=str)
    assert sorted((tuple(r)[:8] for r in quality_rules(odd).collect()), key=str) == want
    assert quality_rules(none).count() == 0


def test_language(spark, docs, odd, none):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = language_of(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    got = {r["doc_id"]: r for r in rows(language_of(odd))}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == got[22]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[12]["lang_pred"] in ("en", "de", "fr") and all(0 <= r["score"] <= 1 for r in got.values()) and language_of(odd).count() == 25
    assert language_of(none).count() == 0
    unlabelled = language_of(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in rows(unlabelled)} == {("und", 0.0)}
    assert {r["held_out"] == (r["c"] == 2) for r in rows(language_of(docs).withColumn("c", F.crc32(F.col("doc_id").cast("string")) % 4))} == {True}


def test_quality_classifier(spark, odd, none, docs, labels):
    base = "/root/testdata/sf0.01"
    documents, marks = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_scores(documents, marks)
    by = {r["quality"]: r["p"] for r in rows(scores.where("held_out").join(marks, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")))}
    assert by[1] > 0.97 and by[0] < 0.1
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, quality_scores(documents, marks).collect()))
    got = rows(quality_scores(odd, labels))
    assert len(got) == 25 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_scores(none, labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).count() == 200
    doubled = labels.union(labels.selectExpr("doc_id", "cast(null as int)", "toxic"))
    assert quality_scores(docs, doubled).count() == 200
    good = good_documents(odd, labels)
    assert good.schema.fieldNames() == odd.schema.fieldNames() and good_documents(none, labels).count() == 0


def test_factors_interact():
    """The linear-time form equals the sum over all pairs."""
    from tidemark.llm.factors import BINS, STATISTICS, Machine

    machine = Machine(np.zeros((len(STATISTICS), BINS - 1)))
    rng = np.random.default_rng(2)
    machine.weight[:], machine.bias = rng.normal(size=len(machine.weight)), 0.3
    row, feature, value = np.array([0] * 5 + [1] * 4), rng.choice(1000, 9, replace=False), rng.normal(size=9)
    got, _ = machine.raw(row, feature, value, 2)
    for t in (0, 1):
        f, x = feature[row == t], value[row == t]
        pairs = sum(machine.factor[f[i]] @ machine.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert np.isclose(got[t], 0.3 + machine.weight[f] @ x + pairs)


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        if not open_:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("block", [1024, 7])
def test_mixture(docs, odd, none, block):
    for table in (docs, odd, odd.where("source = 'c' or doc_id < 5"), docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, "tiny").otherwise(F.col("source")))):
        got = taken_words(table, block).collect()
        sizes = Counter()
        for s, t in table.select("source", "text").collect():
            sizes[s] += len(split(t))
        want = brute_targets(sizes)
        assert sorted(got, key=str) == sorted(taken_words(table.repartition(5), block).collect(), key=str)
        assert sorted(round(r["target"], 6) for r in got) == sorted(round(want[s], 6) for s in table.select("source").toPandas()["source"].where(lambda c: c.notna(), None))
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        sums, pieces = mixture(table, block)
        for r in rows(sums.groupBy("source").agg(F.max("target").alias("t")).join(pieces.groupBy("source").agg(F.sum("words").alias("w")), "source", "left")):
            assert r["w"] is None or abs(r["w"] - r["t"]) <= 1
    assert taken_words(none).count() == 0


def test_mixture_schedule(docs):
    """Any long stretch of the schedule is near the weights."""
    sums, pieces = mixture(docs, 64)
    share = {r["source"]: r["s"] for r in rows(sums.groupBy("source").agg((F.max("target")).alias("s")))}
    total = sum(share.values())
    slots = pieces.select("source", "slot").where("slot is not null").distinct().toPandas()
    most = slots["slot"].max() + 1
    for a, b in ((0, most // 2), (most // 3, most)):
        part = slots[(slots["slot"] >= a) & (slots["slot"] < b)]["source"].value_counts()
        for s, t in share.items():
            assert abs(part.get(s, 0) - (b - a) * t / total) <= 8


def test_mixed_documents(odd, none, docs):
    mixed = mixed_documents(odd, 16)
    assert mixed.columns == odd.columns and mixed_documents(none).count() == 0
    words_of = Counter()
    for r in mixed.collect():
        words_of[r["doc_id"]] += len(split(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["_text"] == "y"
    want = Counter()
    for r in taken_words(odd, 16).collect():
        want[r["doc_id"]] += r["taken"]
    assert +words_of == +want


def test_licenses(docs, odd, none, spark):
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in rows(licenses(docs)))
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        for k, line in enumerate((t or "").split("\n")):
            want += [(i, k, n) for n, x in TEMPLATES.items() if "\n" not in x and x.lower() == line.strip().lower()]
    assert got == sorted(want) and got
    assert [(r["doc_id"], r["license"], r["exact"]) for r in rows(licenses(odd))] == [(17, "mit", True)]
    assert licenses(none).count() == 0


def test_license_statements():
    notice = " ".join(TEMPLATES["apache-2.0-notice"].split())
    assert [s[:2] + s[3:4] for s in statements(f"x y z\n{notice}\nend")] == [(1, "apache-2.0-notice", True)]
    broken = notice.replace(" You may obtain", "\nYou may obtain").replace("express or implied", "expressed or implied")
    found = statements(broken)
    assert [s[1] for s in found] == ["apache-2.0-notice"] and not found[0][3] and found[0][4] == ["express"] and found[0][5] == ["expressed"]
    assert [s[1] for s in statements("Some words. Licensed under CC BY-SA 4.0. Other words")] == ["cc-by-sa-4.0"]
    assert statements("your driver license has expired") == [] and statements("") == []
    two = statements("Released under the MIT License.\nLicensed under CC BY-NC 4.0.")
    assert [s[:2] for s in two] == [(0, "mit"), (1, "cc-by-nc-4.0")]
    for name, text in TEMPLATES.items():
        text = " ".join(text.split())
        assert name in [s[1] for s in statements("lorem ipsum dolor\n" + text + "\nsit amet")], name
        assert differences(words(text), words(text))[:2] == ([], [])


@pytest.mark.parametrize(("text", "names"), [
    ("Licensed under the MIT License", ["mit"]), ("Licensed under Apache 2.0", ["apache-2.0"]), ("GNU General Public License v3", ["gpl-3.0"]),
    ("SPDX-License-Identifier: MIT", ["mit"]), ("# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", ["mit", "gpl-2.0"]), ("SPDX-License-Identifier: Beerware", ["beerware"]),
    ("Released under GPLv3.", ["gpl-3.0"]), ("Licensed under the Apache\n# License, Version 2.0", ["apache-2.0"]), ("the 3-Clause BSD License", ["bsd-3-clause"]),
    ("available under a Creative Commons Attribution-NonCommercial 3.0 Unported License", ["cc-by-nc-3.0"]), ("Copyright 2020 A. All rights reserved.", ["all-rights-reserved"]),
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", ["gpl-3.0"]), ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", ["lgpl-2.1"]),
    ("## License\n\nMIT\n", ["mit"]), ("MIT or Apache-2.0 license", ["mit", "apache-2.0"]), ("your license is old. MIT said so", []), ("under the MIT dome", []), ("we use an apache 2.0 server", []),
])
def test_license_names(text, names, spark):
    assert [s[1] for s in statements(text)] == names
    assert [r["license"] for r in licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == names


def test_license_wording_differences():
    found = statements("Licensed under the MIT License")[0]
    assert not found[3] and found[4] == ["released"]
    assert statements("Licensed under Apache 2.0")[0][4:] == (["the", "license", "version"], [])
    notice = words(TEMPLATES["apache-2.0-notice"])
    for k in range(7, 7 + 8 * 9, 9):  # eight words in the place of others are under a tenth
        notice[k] = f"changed{k}"
    found = statements(" ".join(notice))
    assert [s[1] for s in found] == ["apache-2.0-notice"] and len(found[0][4]) == len(found[0][5]) == 8


def test_license_statements_beside_each_other():
    short = {"mit": "Released under the MIT License.", "apache-2.0": TEMPLATES["apache-2.0"], "gpl-3.0": TEMPLATES["gpl-3.0"]}
    notes = {n: " ".join(TEMPLATES[n].split()) for n in ("apache-2.0-notice", "mit-notice", "gpl-3.0-notice", "bsd-notice")}
    both = short | notes
    for a in both:
        for b in both:
            assert [s[1] for s in statements(f"{both[a]} {both[b]}")] == [a, b], (a, b)
    # a changed notice before an exact one of its own kind, and one a word of which is changed at its border
    changed = notes["mit-notice"].replace("free of charge", "free of all charge")
    assert [s[1:4:2] for s in statements(f"{changed} {notes['mit-notice']}")] == [("mit-notice", False), ("mit-notice", True)]
    found = statements("Licensed under the MIT License. " + notes["apache-2.0-notice"].replace("Licensed", "Licenced", 1))
    assert [s[1] for s in found] == ["mit", "apache-2.0-notice"]
