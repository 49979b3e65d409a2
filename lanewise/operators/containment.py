"""Containment of JSON documents: whether a stored document has everything that a wanted one has.

An object contains another if it has all its keys with values that contain the wanted ones; an array contains another if each wanted
element is contained in one of its own, in any order and however often; numbers are equal by value, strings, true, false and
null as such. A whole document that is an array also contains a single value that is one of its elements. Nothing else contains anything else.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def _step(key: str) -> str:
    if '"' in key and "'" in key:
        raise ValueError(f"keys with both kinds of quotes cannot be addressed: {key!r}")
    return f"$['{key}']" if "'" not in key else f'$["{key}"]'


def _number(value: Column, kind: Column, wanted: int | float | Decimal) -> Column:
    if isinstance(wanted, float) and wanted.is_integer():
        wanted = int(wanted)
    if isinstance(wanted, int) and abs(wanted) >= 1 << 53:
        return (kind == "BIGINT") & (F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(Decimal(wanted)))
    return F.try_variant_get(value, "$", "double") == F.lit(float(wanted))


def _contains(value: Column, wanted: Any) -> Column:
    """``value``: a variant; null (missing) contains nothing."""
    kind = F.schema_of_variant(value)
    if wanted is None:
        test = F.is_variant_null(value)
    elif isinstance(wanted, bool):
        test = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, (int, float, Decimal)):
        test = kind.rlike(f"^({'|'.join(_NUMBERS)})") & _number(value, kind, wanted)
    elif isinstance(wanted, str):
        test = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    elif isinstance(wanted, dict):
        test = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            test &= _contains(F.try_variant_get(value, _step(key), "variant"), inner)
    elif isinstance(wanted, (list, tuple)):
        test = kind.startswith("ARRAY")
        for inner in wanted:
            test &= _any_contains(value, inner)
    else:
        raise TypeError(f"no JSON value: {wanted!r}")
    return F.coalesce(value.isNotNull() & test, F.lit(False))


def _any_contains(array: Column, wanted: Any) -> Column:
    return F.exists(F.try_variant_get(array, "$", "array<variant>"), lambda element: _contains(element, wanted))


def contains(document: Column, wanted: Any) -> Column:
    """Whether the JSON text in ``document`` contains ``wanted`` (dicts, lists, strings, numbers, booleans, None). False for null and for texts that are no JSON."""
    value = F.try_parse_json(document)
    test = _contains(value, wanted)
    if wanted is None or not isinstance(wanted, (dict, list, tuple)):
        test |= F.coalesce(F.schema_of_variant(value).startswith("ARRAY") & _any_contains(value, wanted), F.lit(False))
    return test


def containing(df: DataFrame, column: str, wanted: Any) -> DataFrame:
    """Rows whose JSON document in ``column`` contains ``wanted``."""
    return df.filter(contains(F.col(column), wanted))
