"""Dataset store, bulk loading, and checks on what a text holds."""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.sources.delimited import read_delimited
from tablewise.sources.nested import read_geojson, read_json, read_xml

# --- fixed values -----------------------------------------------------------
DELIMITED = (".csv", ".tsv", ".tab", ".psv", ".dat")
BINARY_SHARE = 0.02
TABLE_DELIMITERS = (",", "\t", ";", "|")
MIN_TABLE_LINES = 3
# ----------------------------------------------------------------------------


def dataset_path(root: str, user: str, dataset: str) -> str:
    return f"{root}/{user}/{dataset}/original.parquet"


def save_dataset(df: DataFrame, root: str, user: str, dataset: str, mode: str = "error") -> str:
    path = dataset_path(root, user, dataset)
    df.write.parquet(path, mode=mode)
    return path


def load_dataset(spark: SparkSession, root: str, user: str, dataset: str) -> DataFrame:
    return spark.read.parquet(dataset_path(root, user, dataset))


def read_any(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables in one file, chosen by its extension."""
    kind = os.path.splitext(path)[1].lower()
    if kind in DELIMITED:
        return {"rows": read_delimited(spark, path)}
    if kind in (".json", ".ndjson", ".jsonl"):
        return read_json(spark, path)
    if kind == ".geojson":
        return {"rows": read_geojson(spark, path)}
    if kind == ".xml":
        return {"rows": read_xml(spark, path)}
    if kind == ".parquet":
        return {"rows": spark.read.parquet(path)}
    raise ValueError(f"{os.path.basename(path)}: {kind or 'unknown'} files aren't supported.")


def load_many(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every file is its own dataset; what cannot be read is reported and the rest still loads."""
    tables, errors = {}, []
    for path in paths:
        name = os.path.basename(path)
        try:
            found = read_any(spark, path)
            for part, df in found.items():
                tables[name if len(found) == 1 else f"{name} › {part}"] = df
        except (ValueError, PySparkException) as error:
            errors.append((name, str(error).splitlines()[0]))
    return tables, spark.createDataFrame(errors, "name string, error string")


def flag_binary_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", head: int | None = None) -> DataFrame:
    """Share of control and replacement characters; above 2 % the text is treated as binary.

    ``head`` limits the look to the first characters of each text.
    """
    body = F.substring(text, 1, head) if head else F.col(text)
    bad = F.length(F.regexp_replace(body, r"[^\x00-\x08\x0B\x0E-\x1F�]", ""))
    share = F.coalesce(bad / F.nullif(F.length(body), F.lit(0)), F.lit(0.0))
    return docs.select(doc, bad.alias("bad_chars"), share.alias("bad_share"), (share > BINARY_SHARE).alias("binary"))


def detect_delimited_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", max_lines: int | None = None) -> DataFrame:
    """(doc, lines, delimiter): the delimiter every non-blank line holds equally often, if there is one.

    All lines are read unless ``max_lines`` asks for a quick look at the first ones.
    """
    lines = F.filter(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n"), lambda l: l.rlike(r"(?U)\S"))
    lines = F.slice(lines, 1, max_lines) if max_lines else lines
    listed = docs.select(doc, lines.alias("l"))
    found = F.lit(None).cast("string")
    for d in reversed(TABLE_DELIMITERS):
        count = lambda line: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
        first = count(F.get("l", F.lit(0)))
        steady = (F.size("l") >= MIN_TABLE_LINES) & (first > 0) & F.forall("l", lambda line: count(line) == first)
        found = F.when(steady, F.lit(d)).otherwise(found)
    return listed.select(doc, F.size("l").alias("lines"), found.alias("delimiter"))
