"""Quality rules by repetition coverage: how much of a text lies inside n-grams and lines it has had before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import U, Words, hash_of, joined_spans, map_texts, mix, row_ngrams, row_sums, span_codes

# The most percent of a text's word characters that may lie in repeated n-grams of each length, and in
# repeated lines, as published for a large web corpus.
NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 20
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"


def repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its row, found earlier in its row) for values in order."""
    key = hashes ^ mix(rows.astype(np.uint64) + U(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    after, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    after[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | after, after


def covered(flags: np.ndarray, at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a flagged window of n words."""
    edge = np.zeros(words + 1, np.int64)
    chosen = at[flags]
    np.add.at(edge, chosen, 1)
    np.add.at(edge, chosen + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a block."""
    w = Words(column)
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = points[w.end] - points[w.start]
    out = {"n_words": w.count, "word_chars": row_sums(chars, w.offsets)}
    symbol = np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8))
    out["n_symbols"] = row_sums(symbol, w.bounds)
    # lines: from a row's start or after a break to the next break or the row's end
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, w.bounds[1:]]))
    row = np.searchsorted(w.bounds[1:], end, "left")
    # an empty last row shares its bound with the row before; only lines with a word count, and those are in one row
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    some = first < last
    start, end, first, last = start[some], end[some], first[some], last[some]
    row = w.row[first]
    code, lines = span_codes(*joined_spans(w.data, start, end))
    again = repeats(hash_of(lines)[code], row)[1] if len(start) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(row[again], minlength=w.rows)
    total = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = np.bincount(row[again], weights=(total[last] - total[first])[again], minlength=w.rows).astype(np.int64)
    h, at = row_ngrams(w, 3)
    out["n_repeat_words"] = row_sums(covered(repeats(h, w.row[at])[0], at, 3, len(chars)), w.offsets)
    for n in NGRAM_PERCENT:
        h, at = row_ngrams(w, n)
        out[f"dup_{n}gram_chars"] = row_sums(chars * covered(repeats(h, w.row[at])[1], at, n, len(chars)), w.offsets)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every row of `docs` (doc_id, text).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the characters inside
    repeated lines and n-grams. A text is kept if the base rules hold and no repeated share is above its bound. Null and
    empty texts have no words and fail. Repeated rows stay, an empty table gives none, other columns are not read.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    parts = ["dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_PERCENT)]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"{c} long" for c in parts)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column(1))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
        kept = ~failed & (100 * m["dup_line_chars"] <= LINE_PERCENT * m["word_chars"])
        for n, most in NGRAM_PERCENT.items():
            kept &= 100 * m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
        made = [batch.column(0), *(pa.array(m[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(m[c].astype(np.int64)) for c in parts)]
        return pa.RecordBatch.from_arrays(made, names=["doc_id", *counts, "base_failed", "kept", *parts])

    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "text", schema, run)
