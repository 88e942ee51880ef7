"""Byte-level BPE as a tree reduction.

A text is cut into the pretokens of a pattern; each is encoded on its own. The tokens of a byte string form a monoid: its
leaves are runs of at most LEAF bytes, encoded many at a time in numpy, and two neighbours are joined by encoding a window of
tokens around the seam anew. The window grows until the tokens at its borders fit: tokens are the encoding of their bytes
if, and only if, every two neighbours are the encoding of their own bytes, so once the pairs at both borders pass that test
nothing outside can change. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.text import map_texts, span_codes, string_bytes

LEAF = 32
NONE = np.int32(1 << 30)
# Pretokens of at most WIDTH tokens are remembered, 2^REMEMBER_BITS of them; a newer one takes the place of an older.
WIDTH, REMEMBER_BITS = 8, 18
BLOCK = 500_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# fixed value: the pattern whose matches are found in numpy
FIXED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space of the pattern's engine: Unicode's property, which lacks the separators 28 to 31.
PROPERTY = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}


class Codec:
    """Encoder and decoder of one rank file; its memory is bounded by the file and the remembered pretokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.source, self.pattern = pattern, regex.compile(spell(pattern))
        self.token_size = np.array([len(t) for t in self.tokens], np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        room = 1 << REMEMBER_BITS
        self.seen, self.held, self.ids = np.zeros((2, room), np.uint64), np.zeros(room, np.uint8), np.zeros((room, WIDTH), np.int32)
        self.table()

    def table(self) -> None:
        """Every split of every token into two tokens, in two hash tables over a pair of ids."""
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        keys, ranks = np.array(keys, np.uint64), np.array(ranks, np.int32)
        self.tables, bits = [], 21
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
            slot = keys * factor >> np.uint64(64 - bits)
            held, rank = np.full(1 << bits, 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(1 << bits, NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((factor, np.uint64(64 - bits), held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            # what did not fit goes to a further, smaller table
            keys, ranks, bits = keys[rest], ranks[rest], 17

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours merge to; NONE if they do not."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = None
        for factor, shift, held, rank in self.tables:
            slot = keys * factor >> shift
            got = np.where(held[slot] == keys, rank[slot], NONE)
            out = got if out is None else np.minimum(out, got)
        return np.full(keys.shape, NONE) if out is None else out

    def leaves(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of many byte runs of at most LEAF bytes: all ids, and each run's first place and number among them.

        The lowest rank merges first, the leftmost among equals.
        """
        count, made, where = np.zeros(len(start), np.int64), [], []
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for part in np.split(at, range(20_000, len(at), 20_000)):
                ids, left = self.merge(self.byte[data[start[part][:, None] + np.arange(n)]])
                count[part] = left
                made.append(ids[np.arange(n) < left[:, None]])
                where.append(part)
        flat = np.concatenate(made) if made else np.zeros(0, np.int32)
        first = np.zeros(len(start), np.int64)
        if where:
            order = np.concatenate(where)
            first[order] = np.cumsum(count[order]) - count[order]
        return flat, first, count

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged tokens of equally long rows, and how many each has."""
        rows, size = ids.shape
        length, done = np.full(rows, size), ids.copy()
        live, work, column = np.arange(rows), ids, np.arange(size)
        # the pair of column i and i + 1; the last column has none
        ranks = np.full((rows, size), NONE)
        ranks[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(live):
            row = np.arange(len(live))
            at = ranks.argmin(1)
            best = ranks[row, at]
            going = best != NONE
            if not going.all():
                done[live[~going]] = work[~going]
                live, work, ranks, at, best = live[going], work[going], ranks[going], at[going], best[going]
                row = np.arange(len(live))
            # what lies behind a merge moves one to the left
            move = np.minimum(column + (column > at[:, None]), size - 1)
            work, ranks = np.take_along_axis(work, move, 1), np.take_along_axis(ranks, move, 1)
            work[row, at] = best
            length[live] -= 1
            ranks[row, at] = NONE
            some = np.flatnonzero(at + 1 < length[live])
            ranks[some, at[some]] = self.rank_of(work[some, at[some]], work[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank_of(work[some, at[some] - 1], work[some, at[some]])
        return done, length

    @functools.lru_cache(maxsize=100_000)  # noqa: B019 - one codec lives as long as its process
    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        both = self.tokens[left] + self.tokens[right]
        parts = [bytes([b]) for b in both]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [self.tokens[left], self.tokens[right]]

    def window(self, data: bytes) -> list[int]:
        """Encoding of the bytes around a seam: a direct merge, leftmost lowest rank first."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        before = after = 1
        while True:
            a, b = max(0, len(left) - before), min(len(right), after)
            middle = self.window(b"".join([self.tokens[t] for t in left[a:] + right[:b]]))
            good_left = a == 0 or self.fits(left[a - 1], middle[0])
            good_right = b == len(right) or self.fits(middle[-1], right[b])
            if good_left and good_right:
                return left[:a] + middle + right[b:]
            before, after = before + (0 if good_left else before), after + (0 if good_right else after)

    def reduce(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours level by level up the tree."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def long(self, data: np.ndarray) -> list[int]:
        """Tokens of a byte string of any length."""
        start = np.arange(0, len(data), LEAF)
        flat, first, count = self.leaves(data, start, np.minimum(LEAF, len(data) - start))
        return self.reduce([flat[i : i + n].tolist() for i, n in zip(first.tolist(), count.tolist(), strict=True)])

    def pretokens(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte positions where pretokens of the rows begin, ascending, and the end of the data."""
        if self.source != FIXED_PATTERN:
            return np.append(self.matched(data, bounds), len(data))
        lead = (data & 0xC0) != 0x80
        place = np.flatnonzero(lead)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = classes()[points]
        head = np.zeros(len(points) + 1, bool)
        head[np.searchsorted(place, bounds)] = True
        n = len(points)
        begin = head[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(begin)  # runs of one class within a row
        if not n:
            return np.zeros(1, np.int64)
        after = np.append(run[1:], n)
        mark = np.zeros(n, bool)
        # white space before a word of any kind gives its last character away: a blank joins the word, others stand alone
        space = kind[run] == SPACE
        inner = space & ~head[after]
        mark[run[~inner]] = True
        last = after[inner] - 1
        mark[run[inner]] = True
        mark[last] = True
        blank = points[last] == 32
        mark[last[blank] + 1] = False
        mark[last[~blank] + 1] = True
        # a lone apostrophe that no blank has joined takes a short ending along
        lone = run[(after - run == 1) & (points[run] == 39) & mark[run]]
        lone = lone[~head[lone + 1]]
        one = np.append(points, np.zeros(2, np.uint32))
        two_ok = ~head[np.minimum(lone + 2, n)]
        first, second = one[lone + 1], one[lone + 2]
        single = np.isin(first, [ord(c) for c in "stmd"])
        double = two_ok & (((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
        for some, size in ((lone[single], 2), (lone[double], 3)):
            mark[some + 1] = False
            ends = some + size
            ends = ends[ends < n]
            mark[ends] = True
        return np.append(place[mark], len(data))

    def matched(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The same by the pattern itself, which must cover its whole text."""
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = a
            for part in self.pattern.findall(data[a:b].tobytes().decode()):
                out.append(at)
                at += len(part.encode())
        return np.array(out, np.int64)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and the bounds of each row's ids."""
        edges = self.pretokens(data, bounds)
        start, end = edges[:-1], edges[1:]
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        # equal pretokens of a block are encoded once; numbers rise with the first place of each
        back, distinct = span_codes(data, edges)
        pick = np.flatnonzero(back > np.concatenate([[-1], np.maximum.accumulate(back)[:-1]]))
        marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in distinct.to_pylist()), np.uint64).reshape(-1, 2)
        one, two = marks[:, 0], marks[:, 1]
        flat, first, count = self.unique(data, start[pick], end[pick] - start[pick], one, two)
        number = count[back]
        total = np.concatenate([[0], np.cumsum(number)])
        ids = flat[np.repeat(first[back] - total[:-1], number) + np.arange(total[-1])]
        return ids.astype("<u4"), total[np.searchsorted(start, bounds)]

    def unique(self, data, start, size, one, two) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of different byte strings: remembered ones, short ones together, long ones up their trees."""
        slot = (one >> np.uint64(64 - REMEMBER_BITS)).astype(np.int64)
        hit = (self.seen[0][slot] == one) & (self.seen[1][slot] == two)
        count = np.where(hit, self.held[slot], 0).astype(np.int64)
        known = self.ids[slot[hit]]
        parts = [known[np.arange(WIDTH) < count[hit][:, None]]]
        first = np.zeros(len(start), np.int64)
        first[hit] = np.cumsum(count[hit]) - count[hit]
        used = len(parts[0])
        brief = np.flatnonzero(~hit & (size <= LEAF))
        flat, at, number = self.leaves(data, start[brief], size[brief])
        parts.append(flat)
        first[brief], count[brief] = at + used, number
        used += len(flat)
        few = brief[number <= WIDTH]
        self.seen[0][slot[few]], self.seen[1][slot[few]], self.held[slot[few]] = one[few], two[few], count[few]
        rows = np.minimum(first[few][:, None] - used + len(flat) + np.arange(WIDTH), max(len(flat) - 1, 0))
        # of two that share a slot the last one stays, in all four arrays alike
        if len(few):
            self.ids[slot[few]] = flat[rows]
        for i in np.flatnonzero(~hit & (size > LEAF)).tolist():
            made = np.array(self.long(data[start[i] : start[i] + size[i]]), np.int32)
            parts.append(made)
            first[i], count[i] = used, len(made)
            used += len(made)
        return np.concatenate(parts), first, count

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(data, np.array([0, len(data)]))[0].tolist()

    def decode_block(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after the other, and the place of each id's first byte."""
        size = self.token_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.token_bytes[np.repeat(self.token_first[ids] - total[:-1], size) + np.arange(total[-1])], total


def spell(pattern: str) -> str:
    for short, long in PROPERTY.items():
        pattern = pattern.replace(short, long)
    return pattern


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N"), (SPACE, "White_Space")):
        member = regex.compile(rf"\p{{{name}}}+")
        for plane in range(0, 0x110000, 0x1000):
            if plane not in range(0xD000, 0xE000):
                points = range(plane, plane + 0x1000)
            else:  # surrogates are no characters
                points = range(0xD000, 0xD800)
            found = "".join(member.findall("".join(map(chr, points))))
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`, and `ids` (binary) if asked for.

    `path` is a rank file that every executor can open at the same place, like the pattern a parameter of the vocabulary.
    A null text is empty: no tokens and the hashes of nothing. Repeated rows stay; an empty table gives none; other columns
    are not read.
    """
    extra = ", ids binary" if keep_ids else ""
    schema = f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path, pattern)
        data, bounds = string_bytes(batch.column(1))
        ids, at = coder.encode_block(data, bounds)
        text, place = coder.decode_block(ids)
        coded = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        made = [batch.column(0), pa.array(np.diff(at)), pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(text[place[a] : place[b]]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            made, names = [*made, pa.array(coded, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(made, names=names)

    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "text", schema, run, BLOCK)
