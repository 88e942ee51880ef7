"""Phrases that occur more often than their parts suggest, by stripes.

A prefix of words keys a stripe: the words that follow it and how often. Tasks build the stripes of their texts, adding up those of
longer prefixes over all that they read as far as a bound allows, stripes of one prefix meet in a shuffle and are added word by word. An entry of a stripe is the frequency of a phrase, the frequencies of the
prefixes are the entries of the stripes before, and the largest entry of a stripe tells whether a longer phrase makes its prefix
superfluous. The stripes of single words also hold their totals.

A phrase of three words or more can be frequent only if the pairs in it are, and tasks leave out those that a sieve of the frequent
pairs does not let through. What is left is counted first in cells, a phrase in the cell of its hash: a cell counts all occurrences
of its phrases, so a phrase in a cell below the limit is not frequent, and stripes are made only of phrases in full cells. The sieve
has a fixed size, the cells grow in number with the input up to a bound; both may let too much through, which costs time but no
exactness. The stripes of the most frequent pairs, of which there are few, are split by their next words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import U, Words, blocks, hash_of, lean, mix
from tidemark.session import cut_lineage

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
BLOCK = 6_000_000
SAMPLE = 20_000  # texts in which words with long stripes are looked for; they only decide how stripes are dealt
HOT_SHARE, HOT_PARTS = 1000, 64  # a prefix with one of so many words has its stripe split into so many parts
SIEVE_BITS = 26
MORE_BITS = 3  # so many times the cells of phrases are doubled, as the words double from 2^26 on
CELLS_HELD = 3_000_000  # different cells that a task holds before it hands on their numbers
RANGE_BITS = 16  # cells of one range are added up in one group
HELD = 400_000  # different phrases of one length that a task holds before it hands on their stripes
STEP = U(0x9E3779B97F4A7C15)


def extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases from the keys of their beginnings and their last words."""
    return mix(key + word * STEP)


class Sieve:
    """A Bloom filter over keys of phrases."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def bits(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, bit) of every key, two of each."""
        low = U((1 << size) - 1)
        place = np.concatenate([key & low, (key >> U(32)) * U(0xD1B54A33) & low])
        return (place >> U(6)).astype(np.int64), U(1) << (place & U(63))

    def __call__(self, key: np.ndarray) -> np.ndarray:
        size = 6 + len(self.cells).bit_length() - 1
        cell, bit = self.bits(key, size)
        hit = self.cells[cell] & bit != 0
        return hit[: len(key)] & hit[len(key) :]


class Cells(Sieve):
    """Which cells of phrases are full; a phrase has one cell."""

    @staticmethod
    def places(key: np.ndarray, size: int) -> np.ndarray:
        return key * STEP >> U(64 - size)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        place = self.places(key, 6 + len(self.cells).bit_length() - 1)
        return self.cells[place >> U(6)] >> (place & U(63)) & U(1) != 0


def word_ids(distinct: pa.Array) -> np.ndarray:
    """Ids of words: the hash that the column function xxhash64 gives, so they need not be sent with the words."""
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in distinct.to_pylist()), np.uint64, len(distinct))


class Tokens:
    """Words of a block of texts (lang, text) with their pieces and languages."""

    def __init__(self, batch: pa.RecordBatch):
        w = Words(batch.column(1), GAP, lower=True)
        self.code, self.distinct = w.code, w.distinct
        self.word_id = word_ids(w.distinct)
        self.id = self.word_id[w.code]
        breaks = np.cumsum(BREAK[w.data])
        # grows at every break and with every text
        self.piece = breaks[w.start] + w.row if len(w.start) else np.zeros(0, np.int64)
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[w.row].astype(np.int64)
        self.base = hash_of(pa.array(x.encode() for x in self.langs.to_pylist()) if len(self.langs) else pa.array([], pa.binary()))[self.lang]

    def keys(self, length: int) -> np.ndarray:
        """Key of the phrase of so many words that starts at each word, as far as there are words."""
        key = self.base
        for j in range(length):
            key = extended(key[: len(self.id) - j], self.id[j:])
        return key

    def within(self, length: int) -> np.ndarray:
        """Whether the phrase of so many words at each word lies in one piece."""
        n = max(0, len(self.piece) - length + 1)
        return self.piece[:n] == self.piece[length - 1 : length - 1 + n]


def stripe_batch(t: Tokens, name: np.ndarray, after: np.ndarray, number: np.ndarray, place: np.ndarray, keys: np.ndarray, hot: np.ndarray, length: int) -> tuple:
    """Entries, given by the number of their prefix and with the place of one occurrence, as stripes: lang, prefix, part, next, counts.

    `after` is the code of the next word, or that of no word for the total. Stripes of `hot` prefixes are split by the next word.
    """
    total = after == len(t.distinct)
    id = t.word_id[np.where(total, 0, after)]
    part = np.where(np.isin(keys, hot) & ~total, id % U(HOT_PARTS), U(0)).astype(np.int64)
    order = np.lexsort((part, name))
    name, part, place, id, total, number = name[order], part[order], place[order], id[order], total[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (part[1:] != part[:-1])]))
    bounds = pa.array(np.append(first, len(name)), pa.int32())
    words = t.id[place[first][:, None] + np.arange(length)].view(np.int64).ravel()
    prefix = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, length), pa.int32()), pa.array(words))
    return (t.langs.take(pa.array(t.lang[place[first]])), prefix, pa.array(part[first].astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(id.view(np.int64), mask=total)),
            pa.ListArray.from_arrays(bounds, pa.array(number.astype(np.int32)))), place[first]


def word_rows(t: Tokens, hot: np.ndarray) -> pa.RecordBatch | None:
    """Stripes of the single words with their totals: (lang, prefix, part, next, counts, word)."""
    if not len(t.code):
        return None
    size = len(t.distinct) + 1
    name = t.lang * size + t.code
    pairs = np.flatnonzero(t.within(2))
    key, first, number = np.unique(name[pairs] * size + t.code[pairs + 1], return_index=True, return_counts=True)
    alone, at, times = np.unique(name, return_index=True, return_counts=True)
    place = np.concatenate([pairs[first], at])
    columns, shown = stripe_batch(t, np.concatenate([key // size, alone]), np.concatenate([key % size, np.full(len(alone), size - 1)]), np.concatenate([number, times]),
                                  place, t.keys(1)[place], hot, 1)
    word = t.distinct.take(pa.array(t.code[shown])).cast(pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, word], names=["lang", "prefix", "part", "next", "counts", "word"])


def sieved_phrases(t: Tokens, longest: int, sieve: Sieve, sieved: int, cells: Cells | None = None):
    """(length, places, keys) of the phrases of more than `sieved` and up to `longest` words in a block, shorter ones first.

    Phrases are left out if any `sieved` words in a row of theirs do not pass the sieve, or any longer part of theirs is in a cell
    that is not full.
    """
    key = t.keys(sieved) if len(t.id) >= sieved else np.zeros(0, np.uint64)
    at = np.flatnonzero(t.within(sieved) & sieve(key))
    key = key[at]
    for length in range(sieved + 1, longest + 1):
        # the phrase without its last word and the one without its first are there
        both = np.flatnonzero(at[:-1] + 1 == at[1:])
        at = at[both]
        key = extended(key[both], t.id[at + length - 1])
        if cells is not None:
            full = cells(key)
            at, key = at[full], key[full]
        yield length, at, key


def numbered(t: Tokens, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of one occurrence of every phrase of `length` words that starts at one of the places, and their numbers there."""
    if not len(at):
        return at, at
    size = len(t.distinct)
    name = t.lang[at] * size + t.code[at]
    for j in range(1, length):
        name = np.unique(name * size + t.code[at + j], return_inverse=True)[1]
    _, first, number = np.unique(name, return_index=True, return_counts=True)
    return at[first], number


class Stripes:
    """Stripes of the prefixes of `length` words, added up over the blocks of a task: (lang, prefix, part, next, counts).

    A phrase that many blocks have is handed on once, until more than `held` different ones are there. `hot`: keys of the
    prefixes to split.
    """

    def __init__(self, length: int, hot: np.ndarray, held: int = HELD):
        self.length, self.hot, self.held = length, hot, held
        self.langs: dict[str, int] = {}
        self.tables: list[np.ndarray] = []
        self.rows = 0

    def add(self, t: Tokens, at: np.ndarray, number: np.ndarray) -> pa.RecordBatch | None:
        """Takes the phrases at some places of a block; gives the stripes of all that is held if that is too much."""
        if not len(at):
            return None
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in t.langs.to_pylist()], np.int64)
        words = t.id[at[:, None] + np.arange(self.length + 1)]
        part = np.where(np.isin(t.keys(self.length)[at], self.hot), words[:, -1] % U(HOT_PARTS), U(0))
        self.tables.append(np.column_stack([codes[t.lang[at]], words[:, :-1].view(np.int64), part.astype(np.int64), words[:, -1].view(np.int64), number]))
        self.rows += len(at)
        if self.rows > self.held:
            self.merge()
        return self.taken() if self.rows > self.held // 2 else None

    def merge(self) -> None:
        table = np.concatenate(self.tables)
        table = table[np.lexsort(table[:, -2::-1].T)]
        first = np.flatnonzero(np.concatenate([[True], (table[1:, :-1] != table[:-1, :-1]).any(axis=1)]))
        number = np.add.reduceat(table[:, -1], first)
        table = table[first]
        table[:, -1] = number
        self.tables, self.rows = [table], len(table)

    def taken(self) -> pa.RecordBatch | None:
        """The stripes of the phrases held, which are held no longer."""
        if not self.rows:
            return None
        self.merge()
        table, n = self.tables[0], self.length
        first = np.flatnonzero(np.concatenate([[True], (table[1:, :-2] != table[:-1, :-2]).any(axis=1)]))
        bounds = pa.array(np.append(first, len(table)), pa.int32())
        prefix = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(first) + 1, n), pa.int32()), pa.array(table[first, 1 : n + 1].ravel()))
        lang = pa.array(self.langs, pa.string()).take(pa.array(table[first, 0]))
        made = [lang, prefix, pa.array(table[first, n + 1].astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(table[:, -2])), pa.ListArray.from_arrays(bounds, pa.array(table[:, -1]))]
        self.tables, self.rows = [], 0
        return pa.RecordBatch.from_arrays(made, names=["lang", "prefix", "part", "next", "counts"])


def stripe_batches(tokens, lengths: range, sieve: Sieve, sieved: int, hot: dict[int, np.ndarray], cells: Cells | None = None):
    """Stripes of the prefixes of each of `lengths` words, of the blocks of a task."""
    held = {n: Stripes(n, hot[n]) for n in lengths}
    for t in tokens:
        for length, at, _ in sieved_phrases(t, lengths.stop, sieve, sieved, cells):
            if length - 1 in held:
                yield held[length - 1].add(t, *numbered(t, at, length))
    for stripe in held.values():
        yield stripe.taken()


def over_tokens(texts: DataFrame, schema: str, fn) -> DataFrame:
    """Batches that `fn` makes of the blocks of tokens of a task; several Arrow batches fill a block."""

    def solve(held):
        table = pa.Table.from_batches(held).combine_chunks()
        for batch in table.to_batches():
            yield from map(Tokens, blocks(batch, "text", BLOCK))

    def tokens(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    def run(batches):
        yield from (made for made in fn(tokens(batches)) if made is not None)

    return texts.mapInArrow(lean(run), schema)


def sieve_of(phrases: DataFrame, bits: int) -> Sieve:
    """The sieve of (lang, ids); 2^(bits - 6) cells at most come to the driver, whatever the number of phrases."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).dictionary_encode()
            key = hash_of(pa.array(x.encode() for x in langs.dictionary.to_pylist()))[langs.indices.to_numpy()]
            words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            for column in words.T:
                key = extended(key, column)
            cell, bit = Sieve.bits(key, bits)
            some, back = np.unique(cell, return_inverse=True)
            value = np.zeros(len(some), np.uint64)
            np.bitwise_or.at(value, back, bit)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(value.view(np.int64))], names=["cell", "bits"])

    cells = np.zeros(1 << bits - 6, np.uint64)
    made = phrases.select("lang", "ids").mapInArrow(lean(run), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells[made["cell"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return Sieve(cells)


def cell_batches(tokens, longest: int, sieve: Sieve, sieved: int, bits: int, held: int = CELLS_HELD):
    """How many phrases of a task's blocks are in each cell: range of cells, cells in it, numbers, the last two as packed integers.

    Numbers are added up over the blocks, until more than `held` different cells are there.
    """
    cell, number = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for t in tokens:
        places = [Cells.places(key, bits).astype(np.uint32) for _, _, key in sieved_phrases(t, longest, sieve, sieved)]
        some, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *places]), return_counts=True)
        cell, back = np.unique(np.concatenate([cell, some]), return_inverse=True)
        number = np.bincount(back, np.concatenate([number, times]), len(cell)).astype(np.int64)
        if len(cell) > held:
            yield cell_rows(cell, number, bits)
            cell, number = cell[:0], number[:0]
    yield cell_rows(cell, number, bits)


def cell_rows(cell: np.ndarray, number: np.ndarray, bits: int) -> pa.RecordBatch | None:
    if not len(cell):
        return None
    low = min(RANGE_BITS, bits)
    part = cell >> np.uint32(low)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    bounds = np.append(first, len(cell))
    packed = [(cell & np.uint32((1 << low) - 1)).astype("<u2"), number.astype("<u4")]
    made = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in packed]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *made], names=["range", "cells", "counts"])


def full_cells(texts: DataFrame, longest: int, sieve: Sieve, sieved: int, least: int, bits: int) -> Cells:
    """The cells that hold `least` or more of the sieved phrases of up to `longest` words; 2^bits bits come to the driver."""
    given = texts.sparkSession.sparkContext.broadcast(sieve.cells)
    made = over_tokens(texts, "range int, cells binary, counts binary", lambda ts: cell_batches(ts, longest, Sieve(given.value), sieved, bits))
    low = min(RANGE_BITS, bits)

    def full(rows: pa.Table) -> pa.Table:
        number = np.zeros(1 << low, np.int64)
        for cells, counts in zip(rows["cells"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            number[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<u4")
        return pa.table({"range": rows["range"][:1], "full": pa.array([np.packbits(number >= least, bitorder="little").tobytes()], pa.binary())})

    cells = np.zeros(1 << bits - 6, np.uint64)
    step = 1 << low - 6
    for part, found in made.groupBy("range").applyInArrow(full, "range int, full binary").collect():
        cells[part * step : (part + 1) * step] = np.frombuffer(found, "<u8")
    return Cells(cells)


def hot_keys(phrases: DataFrame, total: int) -> np.ndarray:
    """Keys of the phrases (lang, ids, f) that have at least 1 / HOT_SHARE of all words; so there are no more than HOT_SHARE."""
    rows = phrases.where(F.col("f") * HOT_SHARE >= total).select("lang", "ids").collect()
    out = []
    for lang, ids in rows:
        key = hash_of(pa.array([lang.encode()]))
        for word in np.array(ids, np.int64).view(np.uint64):
            key = extended(key, word[None] if word.ndim else np.array([word]))
        out.append(key[0])
    return np.array(out, np.uint64)


def stripes(texts: DataFrame, lengths: range, sieve: Sieve, sieved: int, cells: Cells, hot: dict[int, np.ndarray], least: int) -> DataFrame:
    """(lang, ids, f) of the phrases of one word more than `lengths` that occur `least` times or more."""
    context = texts.sparkSession.sparkContext
    given = context.broadcast((sieve.cells, cells.cells, hot))
    made = over_tokens(texts, "lang string, prefix array<long>, part int, next array<long>, counts array<long>",
                       lambda ts: stripe_batches(ts, lengths, Sieve(given.value[0]), sieved, given.value[2], Cells(given.value[1])))
    # stripes of a prefix, or of a part of it, meet in one task; there they are added entry by entry
    entries = made.repartition("lang", "prefix", "part").select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "counts")))
    added = entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    return cut_lineage(added.select("lang", F.concat("prefix", F.array("next")).alias("ids"), "f"))


def hot_words(texts: DataFrame) -> np.ndarray:
    """Keys of words that are common in a sample of texts; any set gives the same counts, a good one even tasks."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).limit(SAMPLE)
    made = over_tokens(some, "lang string, id long, n int", lambda ts: map(word_counts, ts))
    rows = cut_lineage(made.groupBy("lang", "id").agg(F.sum("n").alias("f")))
    return hot_keys(rows.select("lang", F.array("id").alias("ids"), "f"), rows.agg(F.sum("f")).first()[0] or 0)


def word_counts(t: Tokens) -> pa.RecordBatch | None:
    key, number = np.unique(t.lang * len(t.distinct) + t.code, return_counts=True)
    if not len(key):
        return None
    made = [t.langs.take(pa.array(key // len(t.distinct))), pa.array(t.word_id[key % len(t.distinct)].view(np.int64)), pa.array(number.astype(np.int32))]
    return pa.RecordBatch.from_arrays(made, names=["lang", "id", "n"])


def word_stripes(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, id, word, f) of every word, and (lang, ids, f) of the pairs that occur `least` times or more, from one structure."""
    given = texts.sparkSession.sparkContext.broadcast(hot_words(texts))
    made = over_tokens(texts, "lang string, prefix array<long>, part int, next array<long>, counts array<int>, word string",
                       lambda ts: (word_rows(t, given.value) for t in ts))
    entries = made.repartition("lang", "prefix", "part").select("lang", "prefix", "part", "word", F.inline(F.arrays_zip("next", "counts")))
    # a word goes along as part of the key, so two words of one id stay apart
    added = entries.groupBy("lang", "prefix", "part", "word", "next").agg(F.sum("counts").alias("f")).where((F.col("f") >= least) | F.col("next").isNull())
    added = cut_lineage(added.drop("part"))
    words = added.where("next is null").select("lang", F.col("prefix")[0].alias("id"), "word", "f")
    return words, added.where("next is not null").select("lang", F.concat("prefix", F.array("next")).alias("ids"), "f")


def check_ids(words: DataFrame, frequent: DataFrame) -> None:
    """Phrases are counted by ids: an error if a frequent word shares its id with another word."""
    own = frequent.select(F.col("lang").alias("_lang"), F.col("id").alias("_id")).distinct()
    same = words.join(own, (F.col("lang") == F.col("_lang")) & (F.col("id") == F.col("_id"))).agg(F.count("*").alias("n"), F.count_distinct("lang", "id").alias("d")).first()
    if same["n"] != same["d"]:
        raise ValueError("two words have the same hash: choose another one")


def cut_scores(phrases: DataFrame, candidates: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of every candidate by its lowest-scoring cut, the shortest first part among equals."""
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    parts = candidates.select("lang", "ids", "a", cut.alias("k"))
    parts = parts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    for side, count in (("left", "l"), ("right", "r")):
        known = phrases.select(F.col("lang").alias("_lang"), F.col("ids").alias("_ids"), F.col("f").alias(count))
        parts = parts.join(known, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_ids"))).drop("_lang", "_ids")
    # a language may have a third of all candidates: its total goes to them, as long as languages are few
    few = totals.withColumnRenamed("lang", "_lang")
    parts = parts.join(F.broadcast(few) if few.count() <= 100_000 else few, F.col("lang") == F.col("_lang")).drop("_lang")
    # exact: decimals of 38 digits hold the products, and `div` gives whole numbers
    exact = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "n")).alias("cut")
    return parts.groupBy("lang", "ids", "a").agg(lowest).select("lang", "ids", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def maximal(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one contains with `percent` of their number or more.

    Of the longer candidates those of one word more tell: what lies between has at least the frequency of the longer.
    """
    longer = candidates.where(F.size("ids") > 2)
    inside = longer.select("lang", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("ids"), "a").union(longer.select("lang", F.slice("ids", F.lit(2), F.size("ids") - 1).alias("ids"), "a"))
    most = inside.groupBy(F.col("lang").alias("_lang"), F.col("ids").alias("_ids")).agg(F.max("a").alias("most"))
    joined = candidates.join(most, (F.col("lang") == F.col("_lang")) & (F.col("ids") == F.col("_ids")), "left")
    return joined.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * percent)).select(*candidates.columns)


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` with the `phrase` of their ids; only the words of `rows` are looked up."""
    named = rows.select("lang", "ids", F.posexplode("ids").alias("place", "id")).join(words.select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), "word"), (F.col("lang") == F.col("_lang")) & (F.col("id") == F.col("_id")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    phrase = named.groupBy(F.col("lang").alias("_lang"), F.col("ids").alias("_ids")).agg(joined.alias("phrase"))
    return rows.join(phrase, (F.col("lang") == F.col("_lang")) & (F.col("ids") == F.col("_ids"))).drop("_lang", "_ids")


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key with their `rank`; parts of a key are ranked apart first, so no task sees a whole key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("rank") <= most)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, most: int = 2000, bits: int = SIEVE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language of `docs` (lang, text).

    Texts, in lower case as far as A to Z go, fall into pieces at `.,;:!?` and line ends, and those into words at blanks and tabs.
    A candidate is a phrase of 2 to `longest` words of one piece with frequency a >= `least`. Cut after k words it scores
    floor(1000 a n / (l r)), where l and r are the frequencies of both parts and n counts all words of the language; the lowest
    score counts, of equal ones that of the smallest k. A candidate goes if a longer one contains it with `percent` percent of a
    or more. Order: score, a, both descending, then phrase by its bytes.

    Null and empty texts have no words; a null language is `und`. Repeated rows count again, an empty table gives none, other
    columns are not read. Texts of any length are read whole. 2^bits bits, and up to 2^(bits + 3) for cells, are broadcast to every task.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    words, pairs = word_stripes(texts, least)
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("f").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("f") >= least)
    check_ids(words, frequent)
    found = frequent.select("lang", F.array("id").alias("ids"), "f").unionByName(pairs)
    # two more readings of the texts: the longer phrases are counted in cells, then those in full cells by their words
    lengths, sieve = range(2, longest), sieve_of(pairs, bits)
    if lengths and sieve.cells.any():
        cells = full_cells(texts, longest, sieve, 2, least, bits + min(MORE_BITS, max(0, total.bit_length() - 26)))
        hot = {n: hot_keys(pairs, total) if n == 2 else np.zeros(0, np.uint64) for n in lengths}
        found = found.unionByName(stripes(texts, lengths, sieve, 2, cells, hot, least))
    found = cut_lineage(found.where(F.size("ids") <= longest))
    candidates = found.where(F.size("ids") > 1).select("lang", "ids", F.col("f").alias("a"))
    scored = cut_scores(found, maximal(candidates, percent), totals)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return first_of_each(spelled(scored, frequent), "lang", order, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
