"""JSON documents as values: a schema subset, references inside a document, decimals.

They walk nested JSON of any shape, which no built-in function does, so each runs over Arrow
batches of document texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: The schema keywords that are understood; the grammar of decimal texts.
KEYWORDS = {"type", "required", "properties", "additionalProperties", "enum", "const", "items", "title", "description"}
DECIMAL = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?(e(-?[1-9][0-9]*|0))?")
_REFS = ArrayType(StructType().add("path", "string").add("hash", "string"))
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and number
    return number if kind == "number" else kind in _KINDS and isinstance(value, _KINDS[kind])


def _equal(a, b) -> bool:
    """Equality that keeps booleans, integers and floats apart."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def schema_error(value, schema, at: str = "$") -> str | None:
    """Where and by which keyword a value breaks a schema; None if it fits. A keyword that
    is not understood breaks it, but for those that start with ``x-``."""
    if not isinstance(schema, dict):
        return f"{at}: schema"
    for word in schema:
        if word not in KEYWORDS and not word.startswith("x-"):
            return f"{at}: {word}"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if "type" in schema and not (isinstance(kinds, list) and any(isinstance(k, str) and _is(value, k) for k in kinds)):
        return f"{at}: type"
    if "const" in schema and not _equal(value, schema["const"]):
        return f"{at}: const"
    if "enum" in schema and not (isinstance(schema["enum"], list) and any(_equal(value, x) for x in schema["enum"])):
        return f"{at}: enum"
    if isinstance(value, dict):
        if missing := [n for n in schema.get("required", []) if n not in value]:
            return f"{at}.{missing[0]}: required"
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name, inner in value.items():
            if name not in known and other is False:
                return f"{at}.{name}: additionalProperties"
            rule = known.get(name, other)
            if rule is not True and (found := schema_error(inner, rule, f"{at}.{name}")):
                return found
    if isinstance(value, list) and "items" in schema:
        for k, inner in enumerate(value):
            if found := schema_error(inner, schema["items"], f"{at}[{k}]"):
                return found
    return None


def references(value) -> Iterator[tuple[str, str]]:
    """Every (path, hash) object at any depth, in order."""
    if isinstance(value, dict):
        if isinstance(value.get("path"), str) and isinstance(value.get("hash"), str):
            yield value["path"], value["hash"]
        for inner in value.values():
            yield from references(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from references(inner)


def decimals_error(value, at: str = "$") -> str | None:
    """Where a scale or offset, at any depth, is no decimal text."""
    if isinstance(value, dict):
        for name, inner in value.items():
            if name in ("scale", "offset"):
                if not isinstance(inner, str) or not DECIMAL.fullmatch(inner) or inner.startswith("-") and not re.search("[1-9]", inner.split("e")[0]):
                    return f"{at}.{name}"
            elif found := decimals_error(inner, f"{at}.{name}"):
                return found
    elif isinstance(value, list):
        for k, inner in enumerate(value):
            if found := decimals_error(inner, f"{at}[{k}]"):
                return found
    return None


def _parsed(text: str | None):
    try:
        return json.loads(text), None
    except (TypeError, ValueError, RecursionError):
        return None, "$: json"


def conforms(schema: str):
    """A function of a column of JSON texts: what breaks this schema first, null if nothing."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        rule = json.loads(schema)
        read = texts.map(_parsed)
        return read.map(lambda x: x[1] or schema_error(x[0], rule))

    return run


@F.pandas_udf(_REFS)
def referenced(texts: pd.Series) -> pd.Series:
    """The (path, hash) references of each JSON text; none where it does not parse."""
    return texts.map(lambda t: [{"path": p, "hash": h} for p, h in references(_parsed(t)[0])])


@F.pandas_udf(StringType())
def storage_error(texts: pd.Series) -> pd.Series:
    """Where a storage description has a scale or offset that is no decimal text."""
    read = texts.map(_parsed)
    return read.map(lambda x: x[1] or decimals_error(x[0]))


def annotations(params: Column, keyword: str = "x-reference") -> Column:
    """map<name, target>: the properties of a parameter schema (JSON) that refer to something."""
    held = F.from_json(params, f"struct<properties: map<string, struct<`{keyword}`: string>>>")["properties"]
    return F.transform_values(F.map_filter(held, lambda _, v: v[keyword].isNotNull()), lambda _, v: v[keyword])
