"""What is known about a column beyond its storage type."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class ColumnMeta:
    """Semantic type of one column: number, date, category, text or id."""

    name: str
    type: str
    unit: str | None = None
    order: tuple[str, ...] | None = None
    likert: bool = False
    has_time: bool = False
    date_order: str = "dmy"
    decimal_comma: bool = False
    empty: bool = False
    invalid: int = 0
    invalid_examples: tuple[str, ...] = field(default=())

    def with_(self, **changes) -> "ColumnMeta":
        return replace(self, **changes)


def storage_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(storage_type(df, name), NUMERIC_TYPES)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(storage_type(df, name), TIME_TYPES)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(storage_type(df, name), T.StringType)


def simple_metas(df: DataFrame) -> list[ColumnMeta]:
    """Semantic types read off the storage types, for frames that are already typed."""
    metas = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            metas.append(ColumnMeta(f.name, "number"))
        elif isinstance(f.dataType, TIME_TYPES):
            metas.append(ColumnMeta(f.name, "date"))
        else:
            metas.append(ColumnMeta(f.name, "category"))
    return metas


META_SCHEMA = (
    "name string, type string, unit string, `order` array<string>, likert boolean, has_time boolean, "
    "date_order string, decimal_comma boolean, empty boolean, invalid long, invalid_examples array<string>"
)


def meta_frame(spark: SparkSession, metas: list[ColumnMeta]) -> DataFrame:
    rows = []
    for m in metas:
        d = asdict(m)
        d["order"] = list(m.order) if m.order else None
        d["invalid_examples"] = list(m.invalid_examples)
        rows.append(tuple(d[k] for k in (
            "name", "type", "unit", "order", "likert", "has_time", "date_order", "decimal_comma", "empty", "invalid",
            "invalid_examples")))
    return spark.createDataFrame(rows, META_SCHEMA)
