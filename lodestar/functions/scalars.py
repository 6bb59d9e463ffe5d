"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column, attrs: Column) -> Column:
    """SHA-256 over text, a zero byte and the attributes' JSON, in hex."""
    return F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00")), F.encode(F.coalesce(attrs, F.lit("{}")), "UTF-8")), 256)


def canonical_json(attrs: Column) -> Column:
    """A JSON object with its keys in order and no spaces between; ``{}`` for
    null or empty text. Text that is no JSON stays as it is."""
    some = F.when(attrs != "", attrs)
    return F.coalesce(F.to_json(F.try_parse_json(some)), some, F.lit("{}"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def first_words(text: Column, n: int = 60) -> Column:
    """The first ``n`` words, with an ellipsis where words were cut."""
    w = F.split(one_line(text), " ")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))).otherwise(one_line(text))


def first_line(text: Column, n: int) -> Column:
    return truncate(one_line(F.substring_index(F.trim(text), "\n", 1)), n)


_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def normalize_time(text: Column) -> Column:
    """UTC in whole seconds; what is no time stays as it is."""
    plain = text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")
    zoned = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    at = F.when(plain | zoned, F.try_to_timestamp(text))
    return F.coalesce(F.date_format(F.date_trunc("second", at), _ISO), text)


def epoch_time(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text; empty where null or not positive."""
    at = F.timestamp_seconds(F.floor(seconds).cast("bigint"))
    return F.when(seconds > 0, F.date_format(at, _ISO)).otherwise(F.lit(""))


def flexible_time(value: Column) -> Column:
    """A number above 1e11 is milliseconds, below it seconds; text stays."""
    n = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double"))
    return F.when(n.isNotNull(), epoch_time(F.when(n > 1e11, n / 1000).otherwise(n))).otherwise(value)


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def is_binary(content: Column) -> Column:
    """A zero byte within the first 8192."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 8192)), "(..)", "$1 ")) > 0


def yaml_string(text: Column) -> Column:
    """Quoted where YAML needs it; a line break becomes a space."""
    flat = F.regexp_replace(text, r"\n", " ")
    special = (flat == "") | flat.rlike(r"""[:#\[\]{}&*!|>'"%@`,?-]|^\s|\s$""")
    quoted = F.concat(F.lit('"'), F.regexp_replace(flat, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(special, quoted).otherwise(flat)


def slug(text: Column, most: int) -> Column:
    """Lower-case ASCII letters and digits, hyphens between, at most ``most``."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(joined, 1, most), "-+$", "")
