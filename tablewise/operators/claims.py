"""Do the numbers quoted in a text follow from known results?

A fact supports a number when it lies in a small interval around it, so only the nearest fact below and above
matter.  Facts and quoted numbers are sorted together and each number carries its two neighbours: no pairs are
formed, and one answer with very many facts spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.meta import NUMERIC_TYPES
from tablewise.operators.ordered import carry, spread, takes_ranges, with_ranges
from tablewise.session import cut_lineage

# --- fixed values -----------------------------------------------------------
NUMBER_TOKEN = r"(?U)(?<![\w.])[-−]?[$€£¥₹৳]?\d(?:[\d,]*\d)?(?:\.\d+)?\s?(?:%|[kKmMbB](?![a-zA-Z]))?"
YEAR = r"^(19|20)\d\d$"
RELATIVE_TOLERANCE = 0.011
SMALL_LIMIT, SMALL_TOLERANCE, LARGE_TOLERANCE = 10, 0.051, 0.51
COUNTING_NUMBERS = range(0, 13)
SCALES = {"k": 1e3, "m": 1e6, "b": 1e9}
# ----------------------------------------------------------------------------


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), F.lit(0))


def token_value(token: Column) -> Column:
    """Numeric value of a quoted number; K, M and B are scaled, percent signs dropped."""
    plain = F.regexp_replace(F.replace(token, F.lit("−"), F.lit("-")), r"[$€£¥₹৳,\s\u00a0%]", "")
    factors = F.create_map(*[x for letter, factor in SCALES.items() for x in (F.lit(letter), F.lit(factor))])
    digits = F.regexp_replace(plain, "[kKmMbB]$", "").try_cast("double")
    return digits * F.coalesce(F.try_element_at(factors, F.lower(F.right(plain, F.lit(1)))), F.lit(1.0))


def extract_facts(results: DataFrame, key: str) -> DataFrame:
    """(key, value): every finite numeric cell, and every number inside string cells. Booleans are no facts."""
    numbers = [f.name for f in results.schema.fields if f.name != key and isinstance(f.dataType, NUMERIC_TYPES)]
    strings = [f.name for f in results.schema.fields if f.name != key and isinstance(f.dataType, T.StringType)]
    cells = [F.array(F.col(c).cast("double")) for c in numbers]
    cells += [F.transform(number_tokens(F.coalesce(F.col(c), F.lit(""))), token_value) for c in strings]
    every = F.concat(*cells) if cells else F.array().cast("array<double>")
    out = results.select(key, F.explode(every).alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def within_tolerance(known: Column, quoted: Column) -> Column:
    relative = F.greatest(F.abs(known), F.abs(quoted)) * RELATIVE_TOLERANCE
    fixed = F.when(F.abs(quoted) < SMALL_LIMIT, SMALL_TOLERANCE).otherwise(LARGE_TOLERANCE)
    return F.coalesce(F.abs(known - quoted) <= F.greatest(relative, fixed), F.lit(False))


def claims_of(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, token, value, percent): every number quoted in the text, years left out."""
    tokens = spread(answers.select(key, text)).select(key, F.posexplode(number_tokens(F.col(text))).alias("position", "token"))
    tokens = tokens.withColumn("token", F.trim("token")).where(~F.col("token").rlike(YEAR))
    return tokens.withColumn("value", token_value(F.col("token"))).withColumn("percent", F.col("token").rlike("%$")).where(F.col("value").isNotNull())


def verify_claims(answers: DataFrame, facts: DataFrame, key: str = "answer_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(key, position, token): quoted numbers that no fact of the same answer supports."""
    claims = claims_of(answers, key, text)
    v = F.col("value")
    # 18.4 % may be stored as 0.184, and prose drops the sign of a fall.
    readings = F.when(F.col("percent"), F.array(v, v / 100, -v, -v / 100)).otherwise(F.array(v, -v))
    read = claims.select(key, "position", "token", F.explode(readings).alias("value"))
    # The nearest counting number decides: any other is farther by more than the tolerance gains.
    nearest = F.least(F.lit(float(COUNTING_NUMBERS[-1])), F.greatest(F.lit(float(COUNTING_NUMBERS[0])), F.rint("value")))
    settled = read.withColumn("fine", within_tolerance(nearest, F.col("value")))
    quoted = settled.select(key, "value", F.lit(1).alias("kind"), "position", "token", "fine")
    known = facts.select(key, F.col("value").cast("double").alias("value")).distinct().select(
        key, "value", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("token"),
        F.lit(False).alias("fine"))
    order = ["value", "kind", "position"]
    line = quoted.unionByName(known)
    if takes_ranges(line, ranges):
        line = cut_lineage(line)  # reading the texts is the costly part, and the ranges pass over the rows several times
    line = with_ranges(line, [key, *order], ranges)
    near = carry(line, F.when(F.col("kind") == 0, F.col("value")), order, [key], "below", "above")
    judged = near.where(F.col("kind") == 1).withColumn(
        "ok", F.col("fine") | within_tolerance(F.col("below"), F.col("value")) | within_tolerance(F.col("above"), F.col("value")))
    return judged.groupBy(key, "position", "token").agg(F.bool_or("ok").alias("ok")).where(~F.col("ok")).select(key, "position", "token")
