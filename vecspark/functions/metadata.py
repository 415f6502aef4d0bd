"""Metadata of points: fields with strings, numbers or booleans, kept in one map for each type, so that matching is strict
in the type and a field may differ in type between points."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from vecspark.config import MAX_FIELD

TYPES = {"meta_str": "map<string,string>", "meta_num": "map<string,double>", "meta_bool": "map<string,boolean>"}


def normalized(value, field: str):
    """Strings and booleans as they are, numbers as doubles with -0.0 as 0.0; anything else is an error."""
    if isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)):
        try:
            number = float(value)
        except OverflowError:
            number = math.inf
        if not math.isfinite(number):
            raise ValueError(f"the number in metadata '{field}' is not finite: {value}")
        return number + 0.0
    raise ValueError(f"metadata '{field}' holds strings, numbers and booleans, not {value!r}")


def split(metadata: dict | None) -> tuple[dict, dict, dict]:
    """The three maps of one point's metadata."""
    out = ({}, {}, {})
    for field, value in (metadata or {}).items():
        if not isinstance(field, str) or not 1 <= len(field) <= MAX_FIELD:
            raise ValueError(f"a metadata field's name needs 1 to {MAX_FIELD} characters: {field!r}")
        value = normalized(value, field)
        out[0 if isinstance(value, str) else 2 if isinstance(value, bool) else 1][field] = value
    return out


def joined(meta_str: dict | None, meta_num: dict | None, meta_bool: dict | None) -> dict:
    return {**(meta_str or {}), **(meta_num or {}), **(meta_bool or {})}


def to_json(metadata: dict) -> str:
    return json.dumps(metadata, ensure_ascii=False, sort_keys=True)


def from_json(text: str) -> dict:
    return joined(*split(json.loads(text)))


def maps_of(df: DataFrame, columns: list[str]) -> list[Column]:
    """The three maps, made from columns of ``df`` by their types; a null is a field that is missing."""
    kinds: dict[str, list[Column]] = {k: [] for k in TYPES}
    for name in columns:
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, StringType):
            kinds["meta_str"].append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        elif isinstance(kind, BooleanType):
            kinds["meta_bool"].append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        elif isinstance(kind, NumericType):
            kinds["meta_num"].append(F.struct(F.lit(name).alias("key"), (value.cast("double") + F.lit(0.0)).alias("value")))
        else:
            raise ValueError(f"metadata '{name}' must be strings, numbers or booleans, not {kind.simpleString()}")
    return [(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.create_map()).cast(TYPES[k]).alias(k) for k, entries in kinds.items()]
