"""Periodic runs of words, found in a grammar of each text.

Re-Pair replaces repeated pairs of symbols by rules, in all texts of a block at once: in a round every pair that is more
frequent than the pairs it overlaps. What is left of a text is covered by a balanced tree of further rules, each used once.
A rule derives the same words wherever it is used, so the runs that cross the border between its two sides are computed once
and moved to all places of its derivations. The rule of least extent that holds a run has it whole; pieces of a run that
smaller rules have are merged with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Words, map_texts

Order = Callable[[Words, list], np.ndarray]
BLOCK = 1_000_000
CANDIDATES = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Names:
    """Names of the groups of 1, 2, 4, ... symbols at every place; -1 where a text has the group once.

    Equal names are equal groups, so the words two places have in common are found by halving steps, without hashes.
    """

    def __init__(self, code: np.ndarray):
        n = len(code)
        self.level: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # place by name, ascending: name * (n + 1) + place
        at, key = np.arange(n), code
        while len(at):
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            lone = fresh & np.append(fresh[1:], True)
            name = np.cumsum(fresh[~lone]) - 1
            at = at[~lone]
            if not len(at):
                break
            names = np.full(n + 1, -1, np.int64)
            names[at] = name
            self.level.append(names)
            self.places.append(name * (n + 1) + at)
            # twice as many symbols: only where both halves occur again
            step = 1 << len(self.level) - 1
            at = np.flatnonzero((names[: n - step] >= 0) & (names[step:n] >= 0)) if n > step else at[:0]
            key = names[at] * (n + 1) + names[at + step]

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from places i and j on are equal, or before them if `back`."""
        out = np.zeros(len(i), np.int64)
        n = len(self.level[0]) - 1 if self.level else 0
        for k in range(len(self.level) - 1, -1, -1):
            a, b = (i - out - (1 << k), j - out - (1 << k)) if back else (i + out, j + out)
            inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
            names = self.level[k]
            left, right = names[np.where(inside, a, n)], names[np.where(inside, b, n)]
            out += ((left >= 0) & (left == right)).astype(np.int64) << k
        return out


def re_pair(code: np.ndarray, row: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, cut, end) of every use of a rule, then start and end of the symbols that are left.

    `code`: symbols of the texts one after the other, no symbol in two texts. Pairs of one symbol are counted from the left
    of its runs without overlap. Ends when no pair occurs twice.
    """
    rng = np.random.default_rng(seed)
    symbol, start, stop = code.copy(), np.arange(len(code)), np.arange(1, len(code) + 1)
    look, fresh = np.ones(len(code), bool), int(code.max()) + 1 if len(code) else 0
    first, used = fresh, [np.zeros((4, 0), np.int64)]
    while len(symbol) > 1:
        double = (symbol[:-1] == symbol[1:]) & (row[start[:-1]] == row[start[1:]])
        counted = look[:-1] & (row[start[:-1]] == row[start[1:]]) | double
        if double.any():
            place = np.arange(len(double))
            begin = np.maximum.accumulate(np.where(double & ~np.concatenate([[False], double[:-1]]), place, 0))
            counted &= ~(double & ((place - begin) % 2 == 1))
        at = np.flatnonzero(counted)
        pairs, which, number = np.unique(symbol[at] * fresh + symbol[at + 1], return_inverse=True, return_counts=True)
        again = number[which] > 1
        at, which = at[again], which[again]
        if not len(at):
            break
        look = np.zeros(len(symbol), bool)
        look[at] = True
        # a number for each pair: more frequent ones higher, equally frequent ones in any order
        weight = np.zeros(len(symbol) + 1, np.int64)
        weight[at] = (number * len(pairs) + rng.permutation(len(pairs)))[which] + 1
        best = (weight[at] > weight[at - 1]) & (weight[at] > weight[at + 1])
        at, which = at[best], which[best]
        _, rule, number = np.unique(which, return_inverse=True, return_counts=True)
        keep = number > 1
        at, rule = at[keep[rule]], (np.cumsum(keep) - 1)[rule[keep[rule]]]
        used.append(np.stack([fresh + rule, start[at], start[at + 1], stop[at + 1]]))
        symbol[at], stop[at] = fresh + rule, stop[at + 1]
        fresh += int(keep.sum())
        made, stay = np.zeros(len(symbol), bool), np.ones(len(symbol), bool)
        made[at], stay[at + 1] = True, False
        symbol, start, stop, look, made = symbol[stay], start[stay], stop[stay], look[stay], made[stay]
        look |= made
        look[:-1] |= made[1:]
    uses = np.concatenate(used, 1)
    uses[0] -= first
    return uses, start, stop


def tree_over(start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(start, cut, end) of the rules of a balanced tree over the symbols of each text."""
    if not len(start):
        return np.zeros((3, 0), np.int64)
    of = row[start]
    first = np.searchsorted(of, of)
    last = np.searchsorted(of, of, "right")
    place = np.arange(len(start))
    inner = place > first
    step = (place - first) & -(place - first)
    end = np.minimum(place + step, last) - 1
    return np.stack([start[place - step], start, stop[end]])[:, inner]


def crossing(names: Names, start: np.ndarray, cut: np.ndarray, end: np.ndarray, exponent: int, length: int) -> np.ndarray:
    """(rule, start, end, period) of the runs inside each rule that cross its cut, ends clipped to the rule.

    A run of `exponent` >= 4 periods q has two of them on one side of the cut. With 2^k <= q < 2^(k+1), the group of 2^k
    words next to the cut on that side occurs again q words on, so only the places of that name give periods.
    """
    found = [np.zeros((4, 0), np.int64)]
    size = end - start
    n = len(names.level[0]) - 1 if names.level else 0
    for k in range(len(names.level)):
        group, name, places = 1 << k, names.level[k], names.places[k]
        large = np.flatnonzero(size >= max(length, exponent * group))
        if not len(large):
            break
        for right in (True, False):
            side = (end - cut if right else cut - start)[large]
            most = np.minimum(np.minimum(2 * group - 1, side // 2), size[large] // exponent)
            anchor = cut[large] if right else cut[large] - group
            some = (most >= group) & (anchor >= 0)
            some[some] = name[anchor[some]] >= 0
            rule, anchor, most = large[some], anchor[some], most[some]
            base = name[anchor] * (n + 1) + anchor
            low, high = (base + group, base + most) if right else (base - most, base - group)
            a, b = np.searchsorted(places, low), np.searchsorted(places, high, "right")
            # many candidates are followed a part at a time
            total = np.cumsum(b - a)
            for part in np.split(np.arange(len(a)), np.searchsorted(total, np.arange(CANDIDATES, total[-1], CANDIDATES)) if len(total) else []):
                many = (b - a)[part]
                which = np.repeat(part, many)
                if not len(which):
                    continue
                other = places[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + a[which]] % (n + 1)
                period = np.abs(other - anchor[which])
                r = rule[which]
                near = cut[r] if right else cut[r] - period
                to = np.minimum(near + names.common(near, near + period) + period, end[r])
                begin = np.maximum(near - names.common(near, near + period, back=True), start[r])
                good = (begin < cut[r]) & (to > cut[r]) & (to - begin >= np.maximum(length, exponent * period))
                found.append(np.stack([r, begin, to, period])[:, good])
    every = np.concatenate(found, 1)
    # of several periods of one stretch the smallest is its own
    order = np.lexsort((every[3], every[2], every[1], every[0]))
    every = every[:, order]
    return every[:, np.concatenate([[True], (every[:3, 1:] != every[:3, :-1]).any(0)])] if every.shape[1] else every


def merged(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, end, period) of the maximal runs that the given stretches are parts of, by start and period."""
    order = np.lexsort((begin, period))
    begin, end, period = begin[order], end[order], period[order]
    if not len(begin):
        return np.zeros((3, 0), np.int64)
    # stretches of one period that share a period of words are one run
    kind = np.cumsum(np.concatenate([[False], period[1:] != period[:-1]]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(kind * far + end) - kind * far
    head = np.ones(len(begin), bool)
    head[1:] = (period[1:] != period[:-1]) | (begin[1:] > reach[:-1] - period[1:])
    first = np.flatnonzero(head)
    whole = np.stack([begin[first], reach[np.append(first[1:], len(begin)) - 1], period[first]])
    order = np.lexsort((whole[2], whole[1], whole[0]))
    whole = whole[:, order]
    whole = whole[:, np.concatenate([[True], (whole[:2, 1:] != whole[:2, :-1]).any(0)])]
    return whole[:, np.lexsort((whole[2], whole[0]))]


def runs_of(code: np.ndarray, row: np.ndarray, exponent: int, length: int) -> np.ndarray:
    """(start, end, period) of all runs of the texts; `code` numbers the words, equal where they are equal, `row` their texts."""
    # a symbol for each word of each text
    key = row * (int(code.max()) + 1 if len(code) else 1) + code
    code = np.unique(key, return_inverse=True)[1]
    names = Names(code)
    (rule, start, cut, end), left, right = re_pair(code, row)
    _, one = np.unique(rule, return_index=True)
    tree = tree_over(left, right, row)
    first = np.concatenate([np.stack([start, cut, end])[:, one], tree], 1)
    which, begin, to, period = crossing(names, *first, exponent, length)
    ruled = which < len(one)
    # from the first use of a rule to all of them
    order = np.argsort(rule, kind="stable")
    bounds = np.searchsorted(rule[order], np.arange(len(one) + 1))
    r, many = which[ruled], np.diff(bounds)[which[ruled]]
    use = order[np.repeat(bounds[r], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    shift = start[use] - np.repeat(first[0][r], many)
    moved = [np.concatenate([np.repeat(x[ruled], many) + d, x[~ruled]]) for x, d in ((begin, shift), (to, shift), (period, 0))]
    return merged(*moved)


def in_order(words: Words, order: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, `order` telling which word of the block stands at each place, joined by one blank."""
    at = np.flatnonzero(keep)
    source = order[at]
    start, size = words.start[source], words.end[source] - words.start[source] + 1
    total = np.concatenate([[0], np.cumsum(size)])
    data = np.append(words.data, np.uint8(32))[np.minimum(np.repeat(start - total[:-1], size) + np.arange(total[-1]), len(words.data))]
    data[total[1:] - 1] = 32
    data, bounds = data.tobytes(), total[np.searchsorted(at, words.offsets)].tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def strongest(begin: list[int], size: list[int], period: list[int]) -> int:
    """Index of the run with the greatest length / period, compared exactly; the first of equal ones."""
    best = 0
    for i in range(1, len(begin)):
        if size[i] * period[best] > size[best] * period[i]:
            best = i
    return best


def periodic_runs(docs: DataFrame, exponent: int = 4, length: int = 6, order: Order | None = None) -> DataFrame:
    """doc_id, n_words, runs, strongest, collapsed of every row of `docs` (doc_id, text).

    A run is a stretch of words with smallest period q and at least max(length, exponent * q) words that no neighbouring word
    extends. runs: (start, length, period) by start, then period. strongest: the one with the greatest length / period, ties
    to the smallest start, then period; null if there is none. collapsed: the words that no run has after its first period,
    joined by one blank. `order` may give, for the words of a block and the ids, the word that stands at each place.

    Null and empty texts have no words. A null doc_id stays null; repeated rows are treated alike; an empty table gives none;
    other columns are not read. Texts are read whole: memory grows with the longest one.
    """
    if exponent < 4 or length < 1:
        raise ValueError("a run needs four periods at least")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1))
        source = np.arange(len(w.start)) if order is None else order(w, batch.column(0).to_pylist())
        begin, end, period = runs_of(w.code[source], w.row, exponent, length)
        edge = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edge, begin + period, 1)
        np.add.at(edge, end, -1)
        kept = in_order(w, source, np.cumsum(edge[:-1]) == 0)
        bounds = np.searchsorted(begin, w.offsets)
        place = begin - w.offsets[w.row[begin]]
        size = end - begin
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (place, size, period)], fields=list(RUN))
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
        best = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            best.append(a + strongest(place[a:b].tolist(), size[a:b].tolist(), period[a:b].tolist()) if a < b else None)
        made = [batch.column(0), pa.array(w.count), listed, rows.take(pa.array(best, pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    run_type = "struct<start: long, length: long, period: long>"
    schema = f"doc_id long, n_words long, runs array<{run_type}>, strongest {run_type}, collapsed string"
    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "text", schema, run, BLOCK)


def looped(words: Words, ids: list) -> np.ndarray:
    """The order of op13: in a tenth of the texts, by crc32 of the id, words repeat from a place on; others are unchanged."""
    order = np.arange(len(words.start))
    for row, id in enumerate(ids):
        h, n = zlib.crc32(str(id).encode()) if id is not None else 1, int(words.count[row])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        first = int(words.offsets[row])
        order[first + a : first + n] = first + a + np.arange(n - a) % p
    return order


def run_digest(docs: DataFrame) -> DataFrame:
    """The result of op13: number of runs, the strongest one, and hashes of all runs and of the collapsed text."""
    found = periodic_runs(docs, order=looped)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.floor(F.expr("1000 * strongest.length div strongest.period")).cast("long").alias("exponent_milli"),
                        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
