"""Documents packed into sequences of a fixed number of tokens, by a grouping genetic algorithm on islands.

Pieces of documents are dealt at random to shards of bounded size. A shard is solved on several islands, each a task of its own
with a population of packings. A child takes well-filled sequences of one parent whole, gives up those of the other parent
that hold any of their pieces, and the pieces displaced by that are put where they leave the least room. After each epoch the
best packing of an island moves to the next one. Of a shard's best packing the fullest sequences stand; the pieces of the others
are dealt anew with those of other shards, until one shard is left. A shard that needs no more sequences than its tokens fill
is done at once.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.text import IS_SPACE, lean, map_texts, string_bytes
from tidemark.session import cut_lineage

# fixed value: the pattern by which a byte-level tokenizer file splits texts when it asks for its own pattern
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 2000  # bytes without a change between blank and other bytes; longer ones are merged by the tokenizer's own library
SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN = 16_384, 4, 5, 2, 60
REST = 4  # one sequence in so many, the emptiest ones, is dealt anew
LIST = "array<struct<length: int, item: long>>"


class Coder:
    """Ids of a byte-level tokenizer file.

    A file whose merges stand in the order of their ids, with no other steps, is also a table of ranks, and such tables are
    encoded several times faster. Texts with an added token's string or a very long stretch go to the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.tokenizer = Tokenizer.from_str(json.dumps(content))
        self.added = [token["content"].encode() for token in content.get("added_tokens", [])]
        self.fast = None
        ranks = self.ranks(content)
        if ranks is not None:
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def ranks(content: dict) -> dict[bytes, int] | None:
        model, split = content["model"], content.get("pre_tokenizer") or {}
        plain = (content.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
                 and split.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))
        if not plain:
            return None
        # bytes stand for themselves where they are printable, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [vocabulary[a + b] for a, b in pairs]
        single = [t for t in vocabulary if len(t) == 1]
        added = {token["content"] for token in content.get("added_tokens", [])}
        merged = set(order)
        whole = len(single) == 256 and all(i in merged or t in added or len(t) == 1 for t, i in vocabulary.items())
        if not whole or order != sorted(order) or max(vocabulary[t] for t in single) >= min(order, default=256):
            return None
        return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block."""
        turn = np.ones(len(data) + 1, bool)
        turn[1:-1] = IS_SPACE[data[1:]] != IS_SPACE[data[:-1]]
        turn[bounds] = True
        turn = np.flatnonzero(turn)
        slow = set((np.searchsorted(bounds, turn[:-1][np.diff(turn) > LONGEST], "right") - 1).tolist())
        raw, out = data.tobytes(), []
        for row, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            part = raw[a:b]
            if self.fast is None or row in slow or any(t in part for t in self.added):
                ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(part.decode())
            out.append(np.array(ids, "<u4"))
        return out


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(docs: DataFrame, path: str, size: int, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids of every piece: ids of the text, then `end`; longer documents are cut from their end
    on into pieces of `size`, so the first may be shorter."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, lengths, numbers, parts = [], [], [], [], []
        for row, ids in enumerate(coder(path).encode(*string_bytes(batch.column(1)))):
            ids = np.append(ids, np.array([end], "<u4"))
            head = len(ids) % size
            cuts = [0, *range(head or size, len(ids) + 1, size)]
            for number, (a, b) in enumerate(itertools.pairwise(cuts)):
                rows.append(row)
                starts.append(a)
                lengths.append(b - a)
                numbers.append(number)
                parts.append(ids[a:b].tobytes())
        made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids"])

    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "text", "doc_id long, piece int, start long, length long, ids binary", run)


def best_fit(child: np.ndarray, load: list[int], items: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """`child` with each of the items, in the order given, in the sequence that it leaves the least room in; a new one if none has room."""
    if not len(items):
        return child
    least = int(sizes[items].min())
    room, mask = defaultdict(list), 0
    for i, used in enumerate(load):
        if size - used >= least:
            room[size - used].append(i)
            mask |= 1 << size - used
    count = len(load)
    for item, need in zip(items.tolist(), sizes[items].tolist(), strict=True):
        fitting = mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            place = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, place, count = size, count, count + 1
        child[item] = place
        if free - need >= least:
            room[free - need].append(place)
            mask |= 1 << free - need
    return child


def fitness(packing: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Smaller is better: the number of sequences, then how evenly they are filled."""
    load = np.bincount(packing, weights=sizes)
    return len(load), -float((load**2).sum())


def crossover(rng: np.random.Generator, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Packing `a` with about a quarter of the sequences of `b`, from its fuller half."""
    load_a, load_b = np.bincount(a, weights=sizes).astype(np.int64), np.bincount(b, weights=sizes).astype(np.int64)
    order = np.argsort(rng.random(len(load_b)) - load_b)
    full = order[: max(1, len(order) // 2)]
    taken = np.zeros(len(load_b), bool)
    taken[full[rng.random(len(full)) < 0.5]] = True
    moved = taken[b]
    gone = np.zeros(len(load_a), bool)
    gone[a[moved]] = True
    # the emptiest sequence is always dissolved, and two others by chance
    gone[np.argmin(load_a)] = True
    gone[rng.integers(0, len(load_a), 2)] = True
    child, stay = np.full(len(a), -1, np.int64), ~gone[a] & ~moved
    child[stay] = (np.cumsum(~gone) - 1)[a[stay]]
    child[moved] = int((~gone).sum()) + (np.cumsum(taken) - 1)[b[moved]]
    displaced = np.flatnonzero(child < 0)
    # largest first, strictly, nearly or hardly
    noise = 1 + rng.choice([0.0, 0.5, 4.0]) * rng.random(len(displaced))
    displaced = displaced[np.argsort(-sizes[displaced] * noise, kind="stable")]
    return best_fit(child, [*load_a[~gone].tolist(), *load_b[taken].tolist()], displaced, sizes, size)


def founders(rng: np.random.Generator, sizes: np.ndarray, size: int, number: int) -> list[np.ndarray]:
    """Best fit of the pieces, largest first, and in orders ever further from that."""
    out = []
    for k in range(number):
        order = np.argsort(-sizes * (1 + 0.5 * k * rng.random(len(sizes))), kind="stable")
        out.append(best_fit(np.full(len(sizes), -1, np.int64), [], order, sizes, size))
    return out


def evolve(sizes: np.ndarray, size: int, population: list[np.ndarray], seed: list[int], number: int, children: int) -> list[np.ndarray]:
    """A population after so many children, best first; it ends early at a packing that none can beat."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // size)
    if not population:
        population = founders(rng, sizes, size, 1)
        if fitness(population[0], sizes)[0] > least:
            population += founders(rng, sizes, size, number)[1:]
    ranked = sorted(((fitness(p, sizes), k, p) for k, p in enumerate(population)), key=lambda r: r[:2])[:number]
    for step in range(children):
        if ranked[0][0][0] <= least or len(ranked) < 2:
            break
        # each parent is the better of two
        i, j = (int(rng.integers(0, len(ranked), 2).min()) for _ in range(2))
        if i == j:
            j = (j + 1) % len(ranked)
        child = crossover(rng, ranked[i][2], ranked[j][2], sizes, size)
        score = fitness(child, sizes)
        if score < ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked = sorted([*ranked[:-1], (score, len(population) + step, child)], key=lambda r: r[:2])
    return [r[2] for r in ranked]


def one_by_one(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def generations(state: DataFrame, size: int, tasks: int, seed: list[int], population: int, children: int) -> DataFrame:
    """One epoch of every island: (shard, island, items, population), the best packing first."""

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                sizes = np.array([i["length"] for i in row["items"]], np.int64)
                before = [np.array(p, np.int64) for p in row["population"]]
                after = evolve(sizes, size, before, [*seed, row["shard"], row["island"]], population, children)
                sequences, even = fitness(after[0], sizes)
                yield pa.RecordBatch.from_pylist([{**row, "population": [p.astype(np.int32) for p in after], "sequences": sequences, "even": even}],
                                                 schema=pa.schema([(f.name, f.type) for f in batch.schema][:4] + [("sequences", pa.int64()), ("even", pa.float64())]))

    schema = f"shard long, island int, items {LIST}, population array<array<int>>, sequences long, even double"
    return cut_lineage(state.select("shard", "island", "items", "population").repartition(tasks, "shard", "island").mapInArrow(lean(run), schema))


def placed(best: DataFrame, size: int, turn: int, last: bool) -> DataFrame:
    """(item, length, sequence_id, offset, stands) of the pieces of each shard's best packing."""

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                sizes = np.array([i["length"] for i in row["items"]], np.int64)
                items = np.array([i["item"] for i in row["items"]], np.int64)
                packing = np.array(row["packing"], np.int64)
                load = np.bincount(packing, weights=sizes).astype(np.int64)
                again = np.zeros(len(load), bool)
                if not last:
                    poor = np.argsort(load, kind="stable")[: -(-len(load) // REST)]
                    again[poor] = True
                order = np.argsort(packing, kind="stable")
                total = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
                offset = np.empty(len(sizes), np.int64)
                offset[order] = total - total[np.searchsorted(packing[order], packing[order])]
                name = (turn << 56) + (row["shard"] << 20) + packing
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (items, sizes, name, offset, ~again[packing])], names=["item", "length", "sequence_id", "offset", "stands"])

    return cut_lineage(best.mapInArrow(lean(run), "item long, length long, sequence_id long, offset long, stands boolean"))


def sequences(pool: DataFrame, size: int, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION,
              epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """(item, sequence_id, offset) of every row of `pool` (item, length), lengths below `size`; `item` names a row alone."""
    if shard >= 1 << 19:
        raise ValueError("a shard has too many pieces")
    turn, done = 0, None
    limit = 4 * int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # pieces are dealt by a hash of their own names, so all shards have about the same number
        count = pool.count()
        shards = max(1, math.ceil(count / shard))
        named = pool.select(F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(shards).cast("long")).alias("shard"), F.struct(F.col("length").cast("int").alias("length"), "item").alias("one"))
        state = (named.groupBy("shard").agg(F.sort_array(F.collect_list("one")).alias("items"))
                 .select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", F.lit(None).cast("array<array<int>>").alias("population")))
        state = state.withColumn("population", F.coalesce("population", F.array().cast("array<array<int>>")))
        tasks = min(shards * islands, limit)
        for epoch in range(epochs):
            state = generations(state, size, tasks, [turn, epoch], population, children)
            if epoch + 1 < epochs:
                moving = state.select(F.col("shard").alias("_shard"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("_island"), F.col("population")[0].alias("elite"))
                state = (state.join(moving, (F.col("shard") == F.col("_shard")) & (F.col("island") == F.col("_island")))
                         .withColumn("population", F.array_append("population", F.col("elite"))))
        best = (state.groupBy("shard").agg(F.min_by(F.struct("items", F.col("population")[0].alias("packing")), F.struct("sequences", "even", "island")).alias("b"))
                .select("shard", "b.items", "b.packing"))
        found = placed(best, size, turn, shards == 1)
        stands = found.where("stands").select("item", "sequence_id", "offset")
        done = stands if done is None else done.unionByName(stands)
        if shards == 1:
            return done
        pool, turn = found.where("not stands").select("item", "length"), turn + 1


def packed_documents(docs: DataFrame, path: str, size: int = 2048, digest: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every row of `docs` (doc_id, text).

    A document is the ids of its text and an id 0. Those of more than `size` ids are cut into pieces, of which the first may be
    shorter; the others stay whole. Pieces fill the sequences from offset 0 on without gaps. With `digest` the ids are given as
    ids_crc32 only. `path` is a tokenizer file that every executor can open at the same place.

    A null text is empty: one id. Rows without doc_id are packed as well, repeated rows each by themselves. An empty table
    gives none; other columns are not read. Texts of any length are read whole.
    """
    content = F.crc32("ids").alias("ids_crc32") if digest else F.col("ids")
    cut = cut_lineage(pieces(docs, path, size).select("doc_id", "piece", "start", "length", content))
    cut = cut.withColumn("item", F.monotonically_increasing_id())
    own = cut.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")}).drop("item")
    rest = cut.where(F.col("length") < size)
    found = sequences(rest.select("item", "length"), size, **options).withColumnRenamed("item", "_item")
    return own.unionByName(rest.join(found, F.col("item") == F.col("_item")).drop("item", "_item"))
