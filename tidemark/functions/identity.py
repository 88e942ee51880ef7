"""Keys and fingerprints built from values: vault hash keys, change fingerprints, name-based event ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed: the URL namespace of name-based UUIDs (RFC 4122, appendix C).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical(c: Column, data_type: T.DataType | None = None) -> Column:
    """Text image of a value: '' for NULL, lower-case booleans, ISO dates, plain decimals, trimmed text."""
    if isinstance(data_type, T.BinaryType):
        text = F.lower(F.hex(c))
    elif isinstance(data_type, T.TimestampType):
        micros = F.date_format(c, "SSSSSS")
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))
    elif isinstance(data_type, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    else:
        text = F.trim(c.cast("string"))
    return F.coalesce(text, F.lit(""))


def hash_key(*parts: Column) -> Column:
    """MD5 of the business key, or of the parts of a composite one, as lower hex text."""
    texts = [canonical(p) for p in parts]
    return F.md5(texts[0] if len(texts) == 1 else F.concat_ws("||", *texts))


def pair_key(left: Column, right: Column) -> Column:
    """Link key of the SQL loads: MD5 over the two business keys joined by a bar."""
    return F.md5(F.concat(left, F.lit("|"), right))


def as_binary(key: Column) -> Column:
    return F.unhex(key)


def hash_diff(df: DataFrame, attributes: Sequence[str]) -> Column:
    """MD5 over the attributes in name order, each as `name=value`: a NULL cannot shift its neighbours."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.concat(F.lit(f"{name}="), canonical(F.col(name), types[name])) for name in sorted(attributes)]
    return F.md5(F.concat_ws("||", *parts))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID, version 5: SHA-1 of namespace and name with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
                    F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
                    F.substring(digest, 21, 12))


def json_text(c: Column) -> Column:
    """JSON literal of a text value: quotes and backslashes escaped. Callers keep the value ASCII."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def json_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def json_object(pairs: dict[str, Column]) -> Column:
    """Object text in key order with `, ` and `: ` separators; the values are JSON texts."""
    body = []
    for i, name in enumerate(sorted(pairs)):
        body += [F.lit((", " if i else "") + f'"{name}": '), pairs[name]]
    return F.concat(F.lit("{"), *body, F.lit("}"))
