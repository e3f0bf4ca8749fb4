"""JSON, GeoJSON and XML read into flat tables."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators.ordered import RANGE, running_total
from tablewise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -----------------------------------------------------------
MAX_STRUCT_FIELDS = 30
MAX_COLUMNS: int | None = None  # set to cut wide results
MAX_TABLES: int | None = None
# ----------------------------------------------------------------------------


def _flat(c: Column, kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.StructType) and len(kind.fields) < MAX_STRUCT_FIELDS:
        return [x for f in kind.fields for x in _flat(c[f.name], f.dataType, f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.to_json(c).alias(name)]
        return [F.array_join(c.cast("array<string>"), ", ", "").alias(name)]
    if isinstance(kind, (T.StructType, T.MapType)):
        return [F.to_json(c).alias(name)]
    return [c.alias(name)]


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns, scalar arrays joined text, object arrays JSON text."""
    made = [x for f in df.schema.fields for x in _flat(F.col(f"`{f.name}`"), f.dataType, f.name)]
    return df.select(*made[:MAX_COLUMNS])


def flatten_json_strings(df: DataFrame, col: str, schema: str | None = None, keep: list[str] = ()) -> DataFrame:
    """A column of JSON text as dotted columns; without a schema it is read off the data by a distributed pass."""
    if schema is None:
        found = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(col))).alias("s")).first()["s"]
        # Only whole type words change; keys may hold the same letters.
        schema = re.sub(r"(^|<|: )OBJECT<", r"\1STRUCT<", re.sub(r"(^|<|: )VOID(?=[,>]|$)", r"\1STRING", found))
    parsed = df.select(*keep, F.from_json(F.col(col), schema).alias(col))
    return flatten(parsed)


def _features(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("features").alias("f")).select("f.properties.*")


def _one_object_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the file holds several lines and each of them is an object of its own, whatever its name says."""
    line = F.trim("value")
    whole = line.startswith("{") & F.try_parse_json(line).isNotNull()
    facts = spark.read.text(path).where(line != "").agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("objects")).first()
    return facts["n"] > 1 and facts["n"] == facts["objects"]


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> dict[str, DataFrame]:
    """Table or tables in a JSON file: an array, lines of objects, a FeatureCollection or an object of arrays."""
    if lines is None:
        lines = path.lower().endswith((".ndjson", ".jsonl")) or _one_object_a_line(spark, path)
    raw = spark.read.json(path, multiLine=not lines)
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    if "features" in kinds and "type" in kinds and isinstance(kinds["features"], T.ArrayType):
        return {"features": flatten(_features(raw))}
    arrays = [n for n, k in kinds.items() if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StructType)]
    # A file-level object of arrays is a single row; rows of a real table stay as they are.
    if arrays and not lines and len(raw.limit(2).collect()) == 1:
        return {n: flatten(raw.select(F.inline(F.col(f"`{n}`")))) for n in arrays[:MAX_TABLES]}
    if "properties" in kinds and "type" in kinds and isinstance(kinds["properties"], T.StructType):
        return {"rows": flatten(raw.select("properties.*"))}
    return {"rows": flatten(raw)}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Properties of every feature."""
    return flatten(_features(spark.read.json(path, multiLine=True)))


def _tags_read(spark: SparkSession, path: str) -> DataFrame:
    """(__range, pos, name, kind) of every tag, a range being a file split, in the order of its scan."""
    raw = spark.read.option("lineSep", ">").text(path)
    place = F.concat_ws("|", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    tag = F.regexp_extract("value", r"<(/?[A-Za-z_][^\s<>/]*)[^<]*$", 1)
    tags = raw.select(place.alias(RANGE), F.monotonically_increasing_id().alias("pos"), tag.alias("tag"), F.col("value").endswith("/").alias("bare")).where(F.col("tag") != "")
    kind = F.when(F.col("tag").startswith("/"), -1).when(F.col("bare"), 0).otherwise(1)
    return tags.select(RANGE, "pos", F.regexp_replace("tag", "^/", "").alias("name"), kind.alias("kind"))


def xml_tags(spark: SparkSession, path: str) -> DataFrame:
    """(__range, pos, name, kind, depth) of every tag in the order of the files: kind is 1 for a start tag, -1 for an end tag, 0 for one that
    closes itself; depth counts the elements that are open after it. Records end at ">", so a tag over many lines is one record and
    files stay splittable; depths cross the borders of splits through one row a split."""
    return running_total(_tags_read(spark, path), "kind", ["pos"], name="depth", keep_range=True).withColumn("depth", F.col("depth") + F.col("kind"))


_FACTS = f"{RANGE} string, what string, level int, above string, name string, n long, first long"


class _Split:
    """What one split says of its elements: levels count from its start, parents that it does not hold stay open."""

    def __init__(self, place: str):
        self.place, self.level, self.head, self.held = place, 0, None, None
        self.last: dict[int, str] = {}  # the latest element of each level
        self.found: dict[tuple, list] = {}  # (level, parent or None, name) -> [elements with children, first]

    def tag(self, pos: int, name: str, kind: int) -> None:
        if self.head is None:
            self.head = kind
        if self.held and kind >= 0:  # a start tag has a child if no end tag follows
            self.count(*self.held)
        self.held = (self.level, self.last.get(self.level - 1), name, pos) if kind == 1 else None
        if kind >= 0:
            self.last[self.level] = name
        self.level += kind

    def count(self, level: int, above: str | None, name: str, pos: int) -> None:
        self.found.setdefault((level if above is None else None, above, name), [0, pos])[0] += 1

    def facts(self) -> list[tuple]:
        out = [(self.place, "split", self.level, None, None, self.head, None)]
        out += [(self.place, "last", level + 1, name, None, None, None) for level, name in self.last.items()]
        out += [(self.place, "found", *key, *value) for key, value in self.found.items()]
        return out + ([(self.place, "held", self.held[0], self.held[1], self.held[2], 1, self.held[3])] if self.held else [])


def _split_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One walk over the tags of each split, whose few facts are all that is shuffled."""
    split, schema = None, pa.schema([(RANGE, pa.string()), ("what", pa.string()), ("level", pa.int32()), ("above", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    for batch in batches:
        places = batch[RANGE].dictionary_encode()
        at, names = places.indices.to_pylist(), places.dictionary.to_pylist()
        for k, pos, name, kind in zip(at, batch["pos"].to_pylist(), batch["name"].to_pylist(), batch["kind"].to_pylist(), strict=True):
            if split is None or split.place != names[k]:
                if split:
                    yield table(split.facts())
                split = _Split(names[k])
            split.tag(pos, name, kind)
    if split:
        yield table(split.facts())


def repeated_tag(spark: SparkSession, path: str) -> str | None:
    """The element with children of its own that occurs most often below one kind of parent, counted over the whole file.

    A split counts its own elements in one walk. What crosses its borders - depths, the latest element of each level, what follows its
    last tag - goes on through a few rows a split, and so do its counts of elements whose parent an earlier split holds."""
    facts = cut_lineage(_tags_read(spark, path).mapInArrow(_split_facts, _FACTS))  # one row for each split, level and kind of element in it
    along = Window.orderBy(RANGE)
    splits = facts.where("what = 'split'").select(RANGE, F.coalesce(F.sum("level").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"), F.lead("n").over(along).alias("after"))
    rest = facts.where("what != 'split'").join(F.broadcast(splits), RANGE).where("what != 'held' or after >= 0")
    # A split's open elements ask before its own latest ones answer.
    asked = rest.withColumn("at", F.col("level") + F.col("off")).withColumn("side", (F.col("what") == "last").cast("int"))
    handed = Window.partitionBy("at").orderBy(RANGE, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("side") == 1, F.col("above")), ignorenulls=True).over(handed)
    open_ones = asked.where("above is null or side = 1").withColumn("above", latest).where("side = 0 and above is not null")
    found = asked.where("above is not null and side = 0").unionByName(open_ones)
    best = found.groupBy("above", "name").agg(F.sum("n").alias("n"), F.min(F.struct(RANGE, "first")).alias("first")).where("n >= 2").orderBy(F.col("n").desc(), "first").limit(1).collect()
    return best[0]["name"] if best else None


def _leaf_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.concat_ws("", *[_leaf_text(c[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.concat_ws("", F.transform(c, lambda x: _leaf_text(x, kind.elementType)))
    return F.coalesce(c.cast("string"), F.lit(""))


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Repeated elements as rows; attributes as ``@name``, nested children as their text."""
    tag = row_tag or repeated_tag(spark, path)
    if tag is None:
        raise ValueError("No repeated element to use as rows.")
    raw = spark.read.format("xml").options(rowTag=tag, attributePrefix="@", inferSchema=False).load(path)
    made = []
    for f in raw.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType))
        made.append((F.trim(_leaf_text(c, f.dataType)) if nested else F.trim(c.cast("string"))).alias(f.name))
    return raw.select(*made)
