"""Records and texts that leave the house: identity fields taken out, secrets found; JSON lines as typed Parquet."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of fields that tell who a device or a person is.
IDENTITY = frozenset({"serial", "serial_number", "sn", "api_key", "password", "username"})
# Patterns of what must not be published.
SECRETS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "code_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})\b",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "api_key": r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{32,}\b",
    "serial": r"""(?i)["'](?:serial|serial_number|sn)["']\s*:\s*["'](?!SYNTHETIC-)[^"'\r\n]+["']""",
}


def without_identity(value):
    """A JSON value without identity fields at any depth; names are compared without case."""
    if isinstance(value, list):
        return [without_identity(v) for v in value]
    if not isinstance(value, dict):
        return value
    return {k: without_identity(v) for k, v in value.items() if k.lower() not in IDENTITY}


def redact(df: DataFrame, column: str) -> DataFrame:
    """`df` with the JSON in `column` free of identity fields. Null stays null; what isn't valid JSON can't be shown to be free of them and becomes null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(without_identity(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, TypeError, RecursionError):
                return None

        return texts.map(one)

    return df.withColumn(column, clean(F.col(column)))


def findings(df: DataFrame, column: str) -> DataFrame:
    """`df` with a flag for each kind of secret in the text of `column`; the text itself is dropped. A null text holds none."""
    return df.withColumns({k: F.coalesce(F.col(column).rlike(p), F.lit(False)) for k, p in SECRETS.items()}).drop(*([] if column in SECRETS else [column]))


def convert_json_lines(spark: SparkSession, source: str, target: str) -> DataFrame:
    """JSON lines with inferred types, kept as Parquet (zstd) in `target`; the table."""
    spark.read.json(source).write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)
