import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, predicted int, key string, "
          "`class` string, rank int, words long, _c0 string, _text string, _id long, `_pack` string, taken long, slot long, _kept long")


def row(doc_id, text, lang="en", source="a", n_chars=None):
    return (doc_id, text, lang, source, len(text) if text is not None and n_chars is None else n_chars,
            7, 0.5, 3, "k", "c", 1, 2, "x", "y", 5, "p", 9, 4, 8)


def passage(seed, n=40):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 4001}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns whose names operators use themselves."""
    shared = passage(3, 60)
    rows = [
        row(None, shared), row(None, None), row(1, None, None, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "one two three"),
        row(6, "one two three"), row(7, shared), row(8, passage(8) + " " + shared), row(9, shared + " " + passage(9)), row(9, shared + " " + passage(9)),
        row(10, "x" * 1_200_000, source=None), row(11, passage(11, 60_000), "de", "b"), row(12, "the end. " * 300, "de", "b"),
        row(13, passage(13)), row(14, passage(13) + " w1"), row(15, passage(13) + " w1"), row(16, "\x00\x1f é 日本 😀 ‍", source=""),
        row(17, "Released under the MIT License.\nmore text"), row(18, "a\nb\na\nb\n\n a\nb"), row(19, shared.upper()),
        row(20, passage(8) + " " + shared, None, "c"), row(21, passage(21, 900), "fr", "c"), row(22, "! # | $ % 1 2 3", "fr", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
