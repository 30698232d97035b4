"""Tables with repeated rows once, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.tables import table

#: White space as `functions.text.SPACE` has it, in SQL.
SP = r"[ \t\n\x{0b}\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INVISIBLE = r"[\x{ad}\x{200b}\x{200d}\x{200c}\x{2060}\x{feff}]"
ANCHOR = r"\[\^([^\]]+)\]"


def once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, repeated rows once: rows that come twice are alike but for their load time."""
    return table(spark, folder, name).select(*columns).distinct()


def once_sql(name: str, *columns: str) -> str:
    return f"(SELECT DISTINCT {', '.join(columns)} FROM {name})"
