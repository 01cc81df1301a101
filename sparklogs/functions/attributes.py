"""Attributes: flat JSON objects as canonical text and as a map of texts for equality search."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"


def kind(value: Column) -> Column:
    """The type of a variant; '' where there is none (a missing field), 'VOID' for a JSON null."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def text_of(value: Column) -> Column:
    """A scalar variant as text."""
    return F.try_variant_get(value, "$", "string")


def without_nulls(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda _, v: kind(v) != "VOID")


def canonical(attributes: Column) -> Column:
    """Keys in order, value types kept, nulls dropped; {} for no attributes."""
    return F.coalesce(F.to_json(without_nulls(attributes)), F.lit("{}"))


def number_text(number: str) -> str:
    """A JSON number as a double prints it at its shortest, without exponent."""
    out = format(Decimal(repr(float(number))), "f")
    out = out.rstrip("0").rstrip(".") if "." in out else out
    return "0" if out == "-0" else out


def _number_texts(odd: Column) -> Column:
    """{"k": 1e3} as {"k": "1000"}, in Arrow batches."""

    def one(raw: str) -> str:
        return json.dumps({k: number_text(v) for k, v in json.loads(raw, parse_float=str, parse_int=str).items()})

    @F.pandas_udf("string")
    def number_texts(maps: pd.Series) -> pd.Series:
        return maps.map(one, na_action="ignore")

    return number_texts(odd)


def _odd(value: Column) -> Column:
    """Numbers whose text in Spark may differ from the shortest one of the double: doubles and long numbers."""
    return (kind(value) == "DOUBLE") | ((kind(value).rlike("^(BIGINT|DECIMAL)")) & (F.length(text_of(value)) > 15))


def search_map(attributes: Column) -> Column:
    """Every value as text. Only rows with odd numbers send these to Python; all others send a null."""
    held = without_nulls(attributes)
    odd = F.map_filter(held, lambda _, v: _odd(v))
    texts = F.transform_values(F.map_filter(held, lambda _, v: ~_odd(v)), lambda _, v: text_of(v))
    more = F.from_json(_number_texts(F.when(F.size(odd) > 0, F.to_json(odd))), "map<string,string>")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.map_concat(F.coalesce(texts, empty), F.coalesce(more, empty))


def parsed(attributes: Column) -> Column:
    """Attributes from their JSON text."""
    return F.try_variant_get(F.try_parse_json(attributes), "$", MAP)


def promoted(key: str) -> str:
    """The name of the column that holds an attribute's text, where a table has one."""
    return f"attr_{key}"
