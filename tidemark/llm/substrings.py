"""Passages that repeat across documents, by prefixes that split their windows.

A window is `size` consecutive words of one document. Every window has an anchor: the group of ANCHOR words with the least hash
among those in it. Equal windows have equal anchors at the same place, so anchors that occur in one document alone rule out
their windows, and only the suffixes around the others are moved. These are split by prefixes of two lengths: an anchor with
few windows is one prefix, and its suffixes fit in memory; one with more is split further, by the whole window. A group of
the first kind is sorted by windows of `size` words, not by whole suffixes: neighbours that are equal are a repeated window, and
its least document has it first; longer common prefixes and inner nodes are not computed. Of a group of the second kind the
least document is found by an aggregate before anything is moved.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import BLOCK_BYTES, U, Words, blocks, lean, map_texts, mix, ngram_hash, positional, string_bytes

ANCHOR = 4


class Windows:
    """All windows of a block of texts: first word, anchor's word and anchor's hash."""

    def __init__(self, column: pa.Array, size: int):
        self.words = w = Words(column)
        self.size = size
        gram = ngram_hash(w.hash, min(ANCHOR, size))
        n = max(0, len(w.hash) - size + 1)
        least, place = gram[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, size - min(ANCHOR, size) + 1):
            lower = gram[j : j + n] < least
            least[lower] = gram[j : j + n][lower]
            place[lower] = j
        self.start = np.flatnonzero(w.row[:n] == w.row[size - 1 :]) if n else np.zeros(0, np.int64)
        self.key = least[self.start].view(np.int64)
        self.anchor = self.start + place[self.start]
        self.row = w.row[self.start]


def print_of(text: Column) -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def packed(docs: DataFrame) -> DataFrame:
    """The text compressed in `_pack`, its hash in `_print`, doc_id in `_id`, and the other columns of `docs` by place."""
    plain, names, fields = positional(docs)
    text, id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    names.remove(text)
    fields = [f for f in fields if f.name != text]
    plain = plain.select(F.col(text).cast("string").alias("_text"), print_of(F.col(text)).alias("_print"), F.col(id).cast("long").alias("_id"), *names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = zstandard.ZstdCompressor(level=1)
        data, bounds = string_bytes(batch.column(0))
        packs = [None if missing else coder.compress(data[a:b]) for (a, b), missing in zip(itertools.pairwise(bounds.tolist()), batch.column(0).is_null().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(packs, pa.binary()), *(batch.column(i) for i in range(1, batch.num_columns))],
                                          names=["_pack", "_print", "_id", *names])

    return map_texts(plain, "_text", T.StructType([T.StructField("_pack", T.BinaryType()), T.StructField("_print", T.LongType()), T.StructField("_id", T.LongType()), *fields]), run)


def unpacked(column: pa.Array) -> pa.Array:
    coder = zstandard.ZstdDecompressor()
    return pa.array([b"" if p is None else coder.decompress(p) for p in column.to_pylist()], pa.binary())


def pack_blocks(batch: pa.RecordBatch, column: str):
    """Blocks of rows by compressed size, which is about half of the texts'."""
    return blocks(batch, column, BLOCK_BYTES // 2)


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """(key, id, windows): the different anchors of each document of (pack, id), and how many windows each has there."""

    def unique(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(unpacked(batch.column(0)), size)
        order = np.lexsort((w.key, w.row))
        key, row = w.key[order], w.row[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        number = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        return pa.RecordBatch.from_arrays([pa.array(key[fresh]), batch.column(1).take(pa.array(row[fresh])), pa.array(number)], names=["key", "id", "windows"])

    def run(batches):
        for batch in batches:
            for part in pack_blocks(batch, "_pack"):
                made = unique(part)
                if made.num_rows:
                    yield made

    return texts.select("_pack", "_id").mapInArrow(lean(run), "key long, id long, windows long")


def copies(docs: DataFrame) -> DataFrame:
    """(id, print) of the documents whose whole text a smaller one has."""
    marks = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), print_of(F.col("text")).alias("print"), F.md5(F.col("text").cast("string")).alias("whole"))
    first = marks.groupBy(F.col("whole").alias("_whole")).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return marks.join(first, F.col("whole") == F.col("_whole")).where("id > first").select("id", "print").distinct()


def candidate_rows(batch: pa.RecordBatch, size: int, whole: bool) -> pa.RecordBatch:
    """Suffixes of the windows of a block of documents (pack, print, id, keys) whose anchor is among the keys.

    whole: one row for each window, under the window itself, with the parts that its anchor's documents are dealt to; else one
    for each anchor, with the words of all its windows.
    """
    w = Windows(unpacked(batch.column(0)), size)
    given, bounds = batch.column(3).flatten(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
    keys = (given.field("key") if whole else given).to_numpy()

    def joint(key, row):
        return key.view(np.uint64) ^ mix(row.astype(np.uint64) + U(1))

    wanted = joint(keys, np.repeat(np.arange(w.words.rows), np.diff(bounds)))
    order = np.argsort(wanted, kind="stable")
    wanted = wanted[order]
    mine = joint(w.key, w.row)
    place = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
    hit = np.flatnonzero(wanted[place] == mine) if len(wanted) else np.zeros(0, np.int64)
    start, anchor, row, key = w.start[hit], w.anchor[hit], w.row[hit], w.key[hit]
    first = np.ones(len(hit), bool)
    if not whole:
        # windows of one anchor follow each other
        first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(hit)) - 1 if len(at) else at
    begin, end = w.words.start[start[at]], w.words.end[start[last] + size - 1] if len(at) else np.zeros(0, np.int64)
    data = w.words.data.tobytes()
    if whole:
        body = [b" ".join(data[a:b].split()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    else:
        body = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    pick = pa.array(row[at])
    parts = given.field("parts").take(pa.array(order[place[hit[at]]])) if whole else pa.array(np.ones(len(at), np.int64))
    place = start[at] - w.words.offsets[row[at]]
    return pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column(2).take(pick), batch.column(1).take(pick), pa.array(place), pa.array(body, pa.binary()), parts],
                                      names=["key", "id", "print", "place", "body", "parts"])


def candidates(found: DataFrame, size: int, whole: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pack_blocks(batch, "_pack"):
                made = candidate_rows(part, size, whole)
                if made.num_rows:
                    yield made

    return found.mapInArrow(lean(run), "key long, id long, print long, place long, body binary, parts long")


def subtree(key: np.ndarray, doc: np.ndarray, body: pa.Array, size: int) -> np.ndarray:
    """For each suffix row, the bits of its windows that occur in a smaller document: bit i for the window at word i.

    All windows of the rows are sorted below their prefix `key`, by the hashes of their `size` words; neighbours that agree in
    all of them are one window.
    """
    w = Words(body)
    windows = w.count - size + 1
    row = np.repeat(np.arange(w.rows), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = w.offsets[row] + step
    columns = [w.hash[at + j] for j in range(size)]
    order = np.lexsort((*columns[::-1], key[row]))
    common = key[row][order][1:] == key[row][order][:-1]
    for column in columns:
        common &= column[order][1:] == column[order][:-1]
    node = np.flatnonzero(np.concatenate([[True], ~common]))
    ids = doc[row][order]
    least = np.repeat(np.minimum.reduceat(ids, node), np.diff(np.append(node, len(ids))))
    later = np.zeros(len(row), bool)
    later[order] = ids > least
    return np.add.reduceat(later.astype(np.int64) << step, np.cumsum(windows) - windows)


def tree_hits(suffixes: DataFrame, size: int, limit: int = 50_000) -> DataFrame:
    """(id, print, place, bits) of suffix rows with a repeated window, group by group; groups of one task are joined up to `limit` rows."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks()
        bits = subtree(table["key"].to_numpy(), table["id"].to_numpy(), table["body"].combine_chunks(), size)
        hit = pa.array(np.flatnonzero(bits))
        made = table.select(["id", "print", "place"]).take(hit).append_column("bits", pa.array(bits[bits > 0]))
        return made.combine_chunks().to_batches()[0] if len(hit) else None

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                key = batch.column(0).to_numpy()
                if rows >= limit:
                    # what is held ends where the next group begins
                    last = held[-1].column(0)[-1].as_py()
                    cut = int(np.searchsorted(key, last, "right"))
                    if cut:
                        held.append(batch.slice(0, cut))
                    if cut < batch.num_rows:
                        made = solve(held)
                        if made is not None:
                            yield made
                        held, rows = [], 0
                    batch = batch.slice(cut)
                else:
                    size_now = min(batch.num_rows, limit - rows)
                    held.append(batch.slice(0, size_now))
                    rows += size_now
                    batch = batch.slice(size_now)
        if held:
            made = solve(held)
            if made is not None:
                yield made

    return suffixes.drop("parts").repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "id long, print long, place long, bits long")


def without_repeats(docs: DataFrame, size: int = 13, group: int = 400_000, digest: bool = False) -> DataFrame:
    """`docs` without the words of every window that also starts in a document with a smaller doc_id.

    Windows are judged on the input. With `digest`: doc_id, n_words, n_removed, kept_sha256 of every row. Else: the columns of
    `docs`; the text of a row that lost words is the kept words joined by one blank, and n_chars, if there, its length. Rows
    that lose all their words go.

    Null and empty texts have no words. A row without doc_id neither loses words nor makes others lose any. Repeated rows are
    treated alike; rows of one doc_id are not smaller than each other. `group`: windows from which an anchor is split by
    whole windows. Texts of any length are read whole; an empty table gives none.
    """
    # a window's bits lie in a row of its anchor, which can be at size - ANCHOR + 1 places in it
    if size - min(ANCHOR, size) >= 62:
        raise ValueError("windows of so many words have too many places for their anchor")
    # every join of texts is on the id alone, over the same filter and columns: one shuffle moves them for all of them
    texts = packed(docs.select("doc_id", "text") if digest else docs)
    if digest:
        texts = texts.select("_pack", "_print", "_id")
    named = texts.where("_id is not null")
    whole_copies = copies(docs.select("doc_id", "text"))
    # of equal texts only the first is searched
    twice = whole_copies.groupBy(F.col("id").alias("_cid")).agg(F.collect_set("print").alias("prints"))
    searched = named.join(twice, F.col("_id") == F.col("_cid"), "left").where("prints is null or not array_contains(prints, _print)").select("_pack", "_print", "_id")
    keys = anchors(searched, size)
    shared = keys.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("docs"), F.sum("windows").alias("many")).where("docs > 1").drop("docs")
    found = keys.select("key", "id").join(shared, F.col("key") == F.col("_key"))
    hot = F.col("many") > group
    found = found.groupBy("id").agg(F.collect_list(F.when(~hot, F.col("key"))).alias("cold"), F.collect_list(F.when(hot, F.struct("key", F.ceil(F.col("many") / group).alias("parts")))).alias("hot"))
    with_keys = searched.join(found, F.col("_id") == F.col("id"))
    cold = with_keys.where(F.size("cold") > 0).select("_pack", "_print", "_id", "cold")
    warm = with_keys.where(F.size("hot") > 0).select("_pack", "_print", "_id", "hot")
    hits = tree_hits(candidates(cold, size, False), size)
    whole = candidates(warm, size, True)
    first = whole.groupBy(F.col("body").alias("_body")).agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.max("parts").alias("_parts")).where("_first < _last")
    first = first.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    later = (whole.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(first, (F.col("body") == F.col("_body")) & (F.col("part") == F.col("_part")))
             .where("id > _first").select("id", "print", "place", F.lit(1).cast("long").alias("bits")))
    # a place of -1 marks a copy as a whole
    every = whole_copies.select("id", "print", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("bits"))
    marks = (hits.union(later).union(every).groupBy(F.col("id").alias("_mid"), "print")
             .agg(F.collect_list("place").alias("places"), F.collect_list("bits").alias("bits"))
             .groupBy("_mid").agg(F.collect_list(F.struct("print", "places", "bits")).alias("marks")))
    # a list of marks for each text of the id; the pairs of place and bits come from the same rows, so they are in one order
    mine = F.get(F.filter("marks", lambda m: m["print"] == F.col("_print")), F.lit(0))
    joined = named.join(marks, F.col("_id") == F.col("_mid"), "left").withColumn("mine", mine)
    joined = joined.withColumns({"places": F.col("mine.places"), "bits": F.col("mine.bits")}).drop("_mid", "marks", "mine", "_print")
    nothing = F.lit(None).cast("array<bigint>")
    joined = joined.unionByName(texts.where("_id is null").drop("_print").withColumns({"places": nothing, "bits": nothing}))
    fields = [T.StructField("_id", T.LongType())] if digest else [f for f in texts.schema.fields if f.name.startswith("_c")]
    names = [f.name for f in fields]
    rows = joined.select("_pack", "places", "bits", *names)
    output = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256" if digest else "_text", T.StringType())]

    def run(batches):
        for batch in batches:
            for part in pack_blocks(batch, "_pack"):
                made = cut(part, size, digest)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3, part.num_columns)), *made], names=[*names, "n_words", "n_removed", "kept_sha256" if digest else "_text"])

    result = rows.mapInArrow(lean(run), T.StructType([*fields, *output]))
    if digest:
        return result.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    changed = F.col("n_removed") > 0
    places = {c: F.col("_text") if c == "text" else F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in places:
        places["n_chars"] = F.when(changed, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(places["n_chars"])
    return result.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(*(column.alias(c) for c, column in places.items()))


def cut(batch: pa.RecordBatch, size: int, digest: bool) -> list[pa.Array]:
    """Words, removed words and what is kept of each row (pack, places, bits, ...)."""
    w = Words(unpacked(batch.column(0)))
    edge = np.zeros(len(w.start) + 1, np.int64)
    places, bits = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(w.rows), np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    place, mask = places.flatten().to_numpy(), bits.flatten().to_numpy()
    first = w.offsets[row] + place
    for i in np.unique(row[place < 0]).tolist():
        if w.count[i] >= size:
            edge[w.offsets[i]] += 1
            edge[w.offsets[i + 1]] -= 1
    while mask.any():
        at = first[mask & 1 == 1]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        first, mask = first + 1, mask >> 1
    removed = np.cumsum(edge[:-1]) > 0
    count = np.concatenate([[0], np.cumsum(removed)])
    lost = count[w.offsets[1:]] - count[w.offsets[:-1]]
    keep = np.flatnonzero(~removed)
    # kept words, each with the blank after it; the last blank of a row is left out
    start, length = w.start[keep], w.end[keep] - w.start[keep] + 1
    total = np.concatenate([[0], np.cumsum(length)])
    index = np.repeat(start - total[:-1], length) + np.arange(total[-1])
    data = np.append(w.data, np.uint8(32))[np.minimum(index, len(w.data))]
    data[total[1:] - 1] = 32
    data = data.tobytes()
    bounds = total[np.searchsorted(keep, w.offsets)]
    kept = [data[a : b - 1] if b > a else b"" for a, b in itertools.pairwise(bounds.tolist())]
    made = [pa.array(w.count), pa.array(lost)]
    if digest:
        return [*made, pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
    raw, ends, missing = w.data.tobytes(), w.bounds.tolist(), batch.column(0).is_null().to_pylist()
    texts = [None if missing[i] else (kept[i] if lost[i] else raw[ends[i] : ends[i + 1]]) for i in range(w.rows)]
    return [*made, pa.array(texts, pa.binary()).cast(pa.string())]
