"""Guards that fail a job whose input breaks a rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, after a look at its keys; a repeated key is an error."""
    found = duplicates(df, keys).take(1)
    if found:
        raise ValueError(f"repeated key {found[0].asDict()}")
    return df


def forbidden_keys(text: Column | str, names: tuple[str, ...]) -> Column:
    """Which of ``names`` are keys, at any depth, of a JSON text; none if it is no JSON.

    They are looked for in the text's schema, which holds keys as they are after
    unescaping, and no values.
    """
    schema = F.concat(F.schema_of_variant(F.try_parse_json(F.col(text) if isinstance(text, str) else text)), F.lit(","))
    has = lambda n: F.coalesce(schema.rlike(rf"(?:<|, )`?{re.escape(n)}`?: "), F.lit(False))
    return F.filter(F.array(*(F.when(has(n), n) for n in names)), lambda x: x.isNotNull())


# Fixed value: pixels of a canvas's side.
CANVAS = 784


def frozen(name: str, actual: int, expected: int = CANVAS) -> int:
    """``actual``, if it is what it is frozen at; anything else is an error."""
    if int(actual) != expected:
        raise ValueError(f"{name} is frozen at {expected}, not {actual}")
    return int(actual)
