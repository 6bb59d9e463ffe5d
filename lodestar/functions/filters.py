"""Attribute filters over JSON attributes with dynamic typing.

Values compare by class: numbers (true is 1, false is 0) are less than texts;
arrays and objects compare as their JSON text. A missing attribute or JSON null
matches nothing, also not ``NotEq``. A dot in a key is a nested path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"[a-zA-Z0-9_][a-zA-Z0-9_.-]{0,127}")


def check_key(key: str) -> str:
    if not _KEY.fullmatch(key or ""):
        raise ValueError(f"invalid attribute name {key!r}")
    return key


def _path(key: str) -> str:
    return "$" + "".join(f"['{p}']" for p in check_key(key).split("."))


@dataclass(frozen=True)
class Typed:
    """An attribute as class (1 number, 2 text, null missing), number, text."""

    kind: Column
    number: Column
    text: Column


def attribute(attrs: Column, key: str) -> Typed:
    path = _path(key)
    v = F.try_parse_json(attrs)
    name = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    boolean, string = name == "BOOLEAN", name == "STRING"
    number = name.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.when(number, F.try_variant_get(v, path, "double")).when(
        boolean, F.try_variant_get(v, path, "boolean").cast("int").cast("double")
    )
    kind = F.when(number | boolean, 1).when(name.isNull() | (name == "VOID"), F.lit(None).cast("int")).otherwise(2)
    text = F.when(kind == 2, F.when(string, F.try_variant_get(v, path, "string")).otherwise(F.get_json_object(attrs, path)))
    return Typed(kind, value, text)


def rendered(attrs: Column, key: str) -> Column:
    """An attribute as text: whole numbers without a fraction."""
    a = attribute(attrs, key)
    whole = F.when(a.number == F.floor(a.number), F.floor(a.number).cast("string")).otherwise(a.number.cast("string"))
    return F.when(a.kind == 1, whole).otherwise(a.text)


class Filter:
    def column(self, attrs: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Compare(Filter):
    op: str
    key: str
    value: object

    def column(self, attrs: Column) -> Column:
        a = attribute(attrs, self.key)
        if self.value is None:
            return F.lit(False)
        numeric = isinstance(self.value, (int, float))
        own, other = (a.number, 1) if numeric else (a.text, 2)
        lit = F.lit(float(self.value) if numeric else str(self.value))
        same = F.when(a.kind.isNotNull(), (a.kind == other))
        # of another class: texts are above every number
        above = same.isNotNull() & ~same & F.lit(numeric)
        below = same.isNotNull() & ~same & F.lit(not numeric)
        return {
            "=": same & (own == lit),
            "!=": F.when(same, own != lit).otherwise(same.isNotNull()),
            ">": (same & (own > lit)) | above,
            ">=": (same & (own >= lit)) | above,
            "<": (same & (own < lit)) | below,
            "<=": (same & (own <= lit)) | below,
        }[self.op]


def glob_pattern(pattern: str) -> str:
    """A GLOB pattern (``*``, ``?``, ``[a-z]``, ``[^a]``) as a regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 3 if pattern[i + 1 : i + 2] == "^" else i + 2)) > 0:
            body = pattern[i + 1 : end]
            no = body.startswith("^")
            body = body[no:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' * no}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


@dataclass(frozen=True)
class Glob(Filter):
    key: str
    pattern: str

    def column(self, attrs: Column) -> Column:
        return rendered(attrs, self.key).rlike(glob_pattern(self.pattern))


@dataclass(frozen=True)
class In(Filter):
    key: str
    values: tuple

    def column(self, attrs: Column) -> Column:
        check_key(self.key)
        return reduce(or_, [Compare("=", self.key, v).column(attrs) for v in self.values], F.lit(False))


@dataclass(frozen=True)
class And(Filter):
    parts: tuple = ()

    def column(self, attrs: Column) -> Column:
        return reduce(and_, [p.column(attrs) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Or(Filter):
    """Any part; without parts everything matches."""

    parts: tuple = ()

    def column(self, attrs: Column) -> Column:
        return reduce(or_, [p.column(attrs) for p in self.parts]) if self.parts else F.lit(True)


def coerce(text: str) -> object:
    """A plain decimal literal as a number; ``05`` and ``1e3`` stay text."""
    return float(text) if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d*[1-9])?", text) and text != "-0" else text


#: A comparison. Of several operators in a clause the one that stands first in
#: the alternatives counts, wherever it stands in the text.
CLAUSE = "|".join(rf"(?P<k{i}>.+?)(?P<o{i}>{op})(?P<v{i}>.*)" for i, op in enumerate((">=", "<=", "!=", "=", ">", "<")))


def _comparison(clause: str) -> Compare:
    found = re.fullmatch(CLAUSE, clause, re.DOTALL)
    if not found:
        raise ValueError(f"cannot parse {clause!r}")
    key, op, value = (x for x in found.groups() if x is not None)
    return Compare(op, check_key(key.strip()), coerce(value.strip()))


def parse_where(text: str) -> Filter | None:
    """``cost>5,status!=failed``: comma-separated comparisons, all must hold.
    Blank text is no filter, empty clauses are skipped."""
    clauses = [c.strip() for c in text.split(",") if c.strip()]
    return And(tuple(map(_comparison, clauses))) if text.strip() else None
