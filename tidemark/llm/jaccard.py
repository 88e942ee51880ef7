"""Similarity join of documents on their word n-grams: MinHash bands find pairs, whole n-gram sets confirm them.

Documents with the same n-gram set are one class from the start. Classes are shuffled on their band values. A band value that
several classes share is a bucket; a large bucket is cut into chunks, and every pair of chunks is a tile of its own. A pair
that shares several bands is looked at in the first of them only, and buckets with the same classes are read once. Links are
counted inside the tiles, so no row stands for a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.substrings import packed, print_of
from tidemark.llm.text import BLOCK_BYTES, U, Words, lean, map_texts, mix, ngram_hash, positional, row_ngrams
from tidemark.session import cut_lineage

SIDE = 256


def bands_for(threshold: float, recall: float, hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands to reach `recall` at `threshold` stay within `hashes`.

    More rows mean fewer false candidates. A pair at the threshold shares a band with probability 1 - (1 - t^rows)^bands.
    """
    best = None
    for rows in range(1, hashes + 1):
        missed = math.log1p(-(threshold**rows))
        if missed < 0 and math.log(1 - recall) / missed <= hashes // rows:
            best = math.ceil(math.log(1 - recall) / missed), rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches the recall")
    return best


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different n-grams of each text, ordered; a shorter text is one n-gram as a whole."""
    h, at = row_ngrams(w, n)
    hashes, rows = [h], [w.row[at]]
    for size in range(1, n):
        short = np.flatnonzero(w.count == size)
        if len(short):
            hashes.append(ngram_hash(w.hash, size)[w.offsets[short]])
            rows.append(short)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[fresh], h[fresh]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a 128-bit fingerprint of the n-gram set (one, two), its size, its band values and a hash of the text."""
    rng = np.random.default_rng(5)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
    offset = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1))
        row, h = shingles(w, n)
        first = np.searchsorted(row, np.arange(w.rows + 1))
        size = np.diff(first)
        some = np.flatnonzero(size)
        one, two, value = np.zeros(w.rows, np.uint64), np.zeros(w.rows, np.uint64), np.zeros((w.rows, bands), np.uint64)
        if len(some):
            begin = first[some]
            one[some], two[some] = np.add.reduceat(mix(h), begin), np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), begin)
            for band in range(bands):
                total = np.zeros(len(some), np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    total = mix(total + np.minimum.reduceat(h * factor[k] + offset[k], begin))
                value[some, band] = total
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * w.rows + 1, bands), pa.int32()), pa.array(value.ravel().view(np.int64)))
        made = [batch.column(0), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size), values, batch.column(2)]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "one", "two", "size", "bands", "print"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), print_of(F.col("text")).alias("print"))
    return map_texts(plain, "text", "doc_id long, one long, two long, size long, bands array<long>, print long", run)


class Member:
    """The classes of a tile: id, chunk, number of copies, band values and n-gram set of each."""

    def __init__(self, rows: list[dict], n: int):
        unpack = zstandard.ZstdDecompressor()
        rows = sorted({r["class"]: r for r in rows}.values(), key=lambda r: (r["chunk"], r["bands"]))
        self.id = np.array([r["class"] for r in rows], np.int64)
        self.chunk = np.array([r["chunk"] for r in rows])
        self.copies = np.array([r["copies"] for r in rows], np.int64)
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        sets, sizes, at = [], [], 0
        while at < len(rows):
            texts, size = [], 0
            while at < len(rows) and (not texts or size < BLOCK_BYTES):
                texts.append(unpack.decompress(rows[at]["pack"]))
                size += len(texts[-1])
                at += 1
            row, h = shingles(Words(pa.array(texts, pa.binary())), n)
            sets.append(h)
            sizes.append(np.bincount(row, minlength=len(texts)))
        self.hash = np.concatenate(sets)
        self.size = np.concatenate(sizes)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def common(self, a: slice, b: slice) -> np.ndarray:
        """Sizes of the intersections of all sets of one run of members with all of another."""
        ha, hb = self.hash[self.first[a.start] : self.first[a.stop]], self.hash[self.first[b.start] : self.first[b.stop]]
        ra, rb = (np.repeat(np.arange(s.stop - s.start), self.size[s]) for s in (a, b))
        if a == b:
            values, number = np.unique(ha, return_counts=True)
            shared = values[number > 1]
        else:
            shared = np.intersect1d(ha, hb)
        out = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
        for k in range(0, len(shared), 4096):
            part = shared[k : k + 4096]
            sides = []
            for h, r, size in ((ha, ra, out.shape[0]), (hb, rb, out.shape[1])):
                place = np.minimum(np.searchsorted(part, h), len(part) - 1)
                hit = part[place] == h
                grid = np.zeros((size, len(part)), np.float32)
                grid[r[hit], place[hit]] = 1
                sides.append(grid)
            out += sides[0] @ sides[1].T
        if a == b:
            np.fill_diagonal(out, self.size[a])
        return out


def links(rows: list[dict], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, copies linked to it, smallest class of its linked part) of a tile's members that have a link."""
    band, low, high = rows[0]["band"], rows[0]["low"], rows[0]["high"]
    m = Member(rows, n)
    found = np.zeros(len(m.id), np.int64)
    root = np.arange(len(m.id))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # one chunk with itself, or the members of one chunk with those of another
    split = len(m.id) if low == high else int(np.searchsorted(m.chunk, high))
    for i in range(0, split, SIDE):
        a = slice(i, min(i + SIDE, split))
        for j in range(i if low == high else split, len(m.id), SIDE):
            b = slice(j, min(j + SIDE, len(m.id)))
            # the pairs whose first common band is this one
            mine = m.bands[a, None, band] == m.bands[None, b, band]
            for earlier in range(band):
                mine &= m.bands[a, None, earlier] != m.bands[None, b, earlier]
            if a == b:
                mine &= np.tri(len(mine), k=-1, dtype=bool)
            small, large = np.minimum(m.size[a, None], m.size[None, b]), np.maximum(m.size[a, None], m.size[None, b])
            mine &= small >= threshold * large
            if not mine.any():
                continue
            both = m.common(a, b).astype(np.int64)
            mine &= both / (m.size[a, None] + m.size[None, b] - both) >= threshold
            x, y = np.nonzero(mine)
            x, y = x + a.start, y + b.start
            np.add.at(found, x, m.copies[y])
            np.add.at(found, y, m.copies[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    root[p] = q
    linked = np.flatnonzero(found)
    part = np.array([top(i) for i in linked.tolist()], np.int64)
    least = np.full(len(m.id), np.iinfo(np.int64).max)
    np.minimum.at(least, part, m.id[linked])
    return m.id[linked], found[linked], least[part]


def tile_links(tiles: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links of every tile; a tile's rows follow each other in one task."""

    def run(batches):
        held: list[dict] = []
        key = None
        out: list[tuple] = []

        def batch_of(done):
            made = [np.concatenate(x) for x in zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["class", "links", "root"])

        for batch in batches:
            for row in batch.to_pylist():
                now = row["band"], row["value"], row["low"], row["high"]
                if now != key and held:
                    out.append(links(held, n, threshold))
                    held = []
                    if len(out) >= 500:
                        yield batch_of(out)
                        out = []
                key = now
                held.append(row)
        if held:
            out.append(links(held, n, threshold))
        if out:
            yield batch_of(out)

    keys = ["band", "value", "low", "high"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "class long, links long, root long")


def linked(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, tile: int = 500_000) -> DataFrame:
    """doc_id, class_id, n_links of every row of `docs` (doc_id, text).

    n_links: other rows whose n-gram sets have a Jaccard similarity of `threshold` or more, copies included. class_id: the
    smallest doc_id of the rows that such links connect. A text of fewer than n words is one n-gram; without words (null,
    empty) a row has no links and is its own class. Repeated rows are copies. A row without doc_id takes no part: no class,
    no links. `tile`: n-grams on one side of a tile. Other columns are not read.
    """
    return grouped(docs, n, threshold, recall, tile).select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links")


def grouped(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, tile: int = 500_000) -> DataFrame:
    """As linked(): doc_id, the hash `print` of the text, the smallest (doc_id, print) of the class as `least`, and n_links."""
    bands, rows = bands_for(threshold, recall)
    signed = signatures(docs, n, bands, rows).withColumn("size", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("size")))
    signed = cut_lineage(signed)
    classes = (signed.where("size > 0").groupBy("one", "two")
               .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "print")).alias("least"), F.max("size").alias("size"), F.max("bands").alias("bands"))
               .withColumn("class", F.monotonically_increasing_id()))
    classes = cut_lineage(classes)
    placed = classes.select("class", "size", F.posexplode("bands").alias("band", "value"))
    draw = F.xxhash64("class").bitwiseAND(F.lit((1 << 40) - 1))
    buckets = (placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("total"), F.min("class").alias("first"), F.max("class").alias("last"), F.sum(draw).alias("draw"))
               .where("many > 1"))
    # buckets of the same classes are one, read in its first band
    buckets = (buckets.groupBy("many", "first", "last", "draw").agg(F.min(F.struct("band", "value", "total")).alias("b"))
               .select(F.col("b.band").alias("_band"), F.col("b.value").alias("_value"), F.ceil(F.col("b.total") / tile).alias("chunks")))
    members = placed.join(buckets, (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")))
    chunk = F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("chunks"))
    wanted = cut_lineage(members.select(F.col("class").alias("_class"), "band", "value", "chunks", chunk.alias("chunk")))
    # each text is fetched once, and then sent to its tiles
    calls = wanted.groupBy("_class").agg(F.collect_list(F.struct("band", "value", "chunks", "chunk")).alias("calls"))
    known = calls.join(classes, F.col("_class") == F.col("class")).select("class", "copies", "bands", F.col("least.doc_id").alias("least"), F.col("least.print").alias("print"), "calls")
    texts = packed(docs.select("doc_id", "text")).select("_id", "_print", F.col("_pack").alias("pack"))
    sent = known.join(texts, (F.col("least") == F.col("_id")) & (F.col("print") == F.col("_print"))).withColumn("call", F.explode("calls"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("call.chunks") - 1))
    tiles = (sent.select("class", "copies", "bands", "pack", "call", other.alias("_other"))
             .select("class", "copies", "bands", "pack", F.col("call.band").alias("band"), F.col("call.value").alias("value"), F.col("call.chunk").alias("chunk"),
                     F.least("call.chunk", "_other").alias("low"), F.greatest("call.chunk", "_other").alias("high")))
    found = cut_lineage(tile_links(tiles, n, threshold))
    counts = found.groupBy(F.col("class").alias("_c")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    labelled = (classes.select("class", "one", "two", "copies", "least").join(counts, F.col("class") == F.col("_c"), "left")
                .join(groups, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")))
    least = labelled.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("class_least"))
    labelled = (labelled.join(least, F.col("root") == F.col("_root"))
                .select(F.col("one").alias("_one"), F.col("two").alias("_two"), "class_least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    same = (F.col("size") > 0) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    own = F.coalesce("class_least", F.struct("doc_id", "print"))
    return signed.join(labelled, same, "left").select("doc_id", "print", own.alias("least"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, unnamed: bool = False, **options) -> DataFrame:
    """One row of `docs` for each group, all columns: the one with the smallest id, and of its texts that with the smallest hash.

    Different texts under one id are judged each; the same text under one id stays once. Rows without an id have no group:
    they go, or stay as they are if `unnamed`.
    """
    first = (F.col("doc_id") == F.col("least.doc_id")) & F.col("print").eqNullSafe(F.col("least.print"))
    kept = grouped(docs, **options).where(first).select(F.col("doc_id").alias("_kept"), F.col("print").alias("_least")).distinct()
    plain, names, _ = positional(docs)
    id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = (plain.withColumn("_print", print_of(F.col(text))).join(kept, (F.col(id) == F.col("_kept")) & (F.col("_print") == F.col("_least")))
             .dropDuplicates([id, "_print"]).select(*names))
    if unnamed:
        found = found.unionByName(plain.where(F.col(id).isNull()))
    return found.toDF(*docs.columns)
