"""Rewriting JSON text value by value or field by field, from the leaves up."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(x, f):
    if isinstance(x, dict):
        x = {k: _values(v, f) for k, v in x.items()}
    elif isinstance(x, list):
        x = [_values(v, f) for v in x]
    return f(x)


def _fields(x, f):
    if isinstance(x, dict):
        return dict(f(k, _fields(v, f)) for k, v in x.items())
    return [_fields(v, f) for v in x] if isinstance(x, list) else x


def _applied(walk, f) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(walk(json.loads(t), f), separators=(",", ":"), ensure_ascii=False))

    return rewrite


def transform(text: Column, f: Callable) -> Column:
    """Every value v becomes f(v); f returns v where it has nothing to change."""
    return _applied(_values, f)(text)


def transform_field(text: Column, f: Callable) -> Column:
    """Every field becomes f(name, value), a pair, so that names may change."""
    return _applied(_fields, f)(text)
