"""Tokens of search text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: token pattern and stop words (dropped after normalisation).
TOKEN = "[a-z0-9]+"
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")


def normal_form(token: Column) -> Column:
    """Singular form: statuses -> status, -ies -> -y, a final s dropped (not ss) on words long enough."""
    length = F.length(token)
    return (F.when(token.isin("status", "statuses"), F.lit("status"))
            .when((length > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), length - 3), F.lit("y")))
            .when((length > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), length - 1))
            .otherwise(token))


def tokens(text: Column) -> Column:
    """All tokens of the whole text, in order, stop words removed."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(raw, normal_form), lambda t: ~t.isin(*STOP_WORDS))


def query_tokens(query: str) -> dict[str, int]:
    """Token counts of a question; the question is one short string."""
    counts: dict[str, int] = {}
    for token in re.findall(TOKEN, query.lower()):
        if token in ("status", "statuses"):
            token = "status"
        elif len(token) > 4 and token.endswith("ies"):
            token = token[:-3] + "y"
        elif len(token) > 3 and token.endswith("s") and not token.endswith("ss"):
            token = token[:-1]
        if token not in STOP_WORDS:
            counts[token] = counts.get(token, 0) + 1
    return counts
