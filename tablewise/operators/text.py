"""Corpus jobs on a documents frame: one row per document, the words are exploded and counted by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.parsing import squeeze_ends
from tablewise.operators.ordered import sliced, spread

# --- fixed values -----------------------------------------------------------
STOP_WORDS = frozenset((
    "a an the and or but if then else of to in on at for from by with without about as is are was were be been being it its this that "
    "these those there here we you they he she i me my our your their his her them us not no yes do does did done have has had can could "
    "will would should may might must shall into over under than so such very more most less least also just only own same other any "
    "each few all both some many much what which who whom whose when where why how up down out off again further once s t don now per "
    "via vs etc e.g i.e").split(" "))
WORD = r"[\p{L}][\p{L}\p{N}'’-]*"
LETTERS = r"[\p{L}]+"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"“(])"
PASSAGE_BREAK = r"(?U)(?<=[.!?])\s+"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
NUMBER = r"(?i)[$€£]?\s?-?\d[\d,]*\.?\d*(?:\s?%|\s?(?:percent|million|billion|bn|k|m)(?![A-Za-z0-9_]))?"
DATE = (r"(?<![A-Za-z0-9_])(?:\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4}|\d{4}-\d{2}-\d{2}|"
        r"(?:\d{1,2}\s)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s\d{4})(?![A-Za-z0-9_])")
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
WORDS_PER_MINUTE = 230
FLESCH = (206.835, 1.015, 84.6)
CONTEXT_CHARS = 50
# ----------------------------------------------------------------------------


def clean(c: Column) -> Column:
    return F.replace(c, F.lit("\r"), F.lit(""))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean(c)), F.lit(WORD), F.lit(0))


def sentences_of(c: Column) -> Column:
    parts = F.transform(F.split(clean(c), SENTENCE_BREAK), squeeze_ends)
    return F.filter(parts, lambda s: F.length(s) > 2)


def _syllables(words: Column) -> Column:
    """Vowel groups after dropping a final e, at least one per word; counted on the joined words with three regex passes."""
    joined = F.regexp_replace(F.array_join(words, " "), r"e(?= |$)", "")
    voiced = F.regexp_count(joined, F.lit(r"[^ ]*[aeiouy][^ ]*"))
    return F.regexp_count(joined, F.lit(r"[aeiouy]+")) + F.size(words) - voiced


def text_stats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, reading time, diversity and readability per document, without a shuffle."""
    base = spread(docs.select(doc, text)).select(doc, clean(F.col(text)).alias("__t"), words_of(F.col(text)).alias("__w"), sentences_of(F.col(text)).alias("__s"))
    paragraphs = F.size(F.filter(F.split("__t", PARAGRAPH_BREAK), lambda p: p.rlike(r"(?U)\S")))
    counted = base.select(
        doc, F.length("__t").alias("chars"), F.size("__w").alias("words"), F.size(F.array_distinct("__w")).alias("distinct_words"),
        F.size("__s").alias("sentences"), paragraphs.alias("paragraphs"), _syllables(F.col("__w")).alias("syllables"),
        F.aggregate("__s", F.lit(0), lambda acc, s: acc + F.regexp_count(s, F.lit(r"(?U)\S+"))).alias("__len"))
    w, s = F.col("words"), F.col("sentences")
    base_score, per_sentence, per_word = FLESCH
    flesch = F.when((w > 0) & (s > 0), base_score - per_sentence * (w / s) - per_word * (F.col("syllables") / w))
    return counted.select(
        doc, "chars", "words", "distinct_words", "sentences", "paragraphs", "syllables", (w / WORDS_PER_MINUTE).alias("reading_minutes"),
        F.when(w > 0, F.col("distinct_words") / w).otherwise(0.0).alias("lexical_diversity"),
        F.when(s > 0, F.col("__len") / s).alias("mean_sentence"), flesch.alias("flesch"))


def _content_word(w: Column) -> Column:
    return (F.length(w) >= 3) & ~w.isin(*sorted(STOP_WORDS))


def word_counts(docs: DataFrame, doc: str | None = "doc_id", text: str = "text") -> DataFrame:
    """(doc, word, n) of content words; without ``doc`` over the whole corpus."""
    keys = [doc] if doc else []
    long = spread(docs.select(*keys, text)).select(*keys, F.explode(words_of(F.col(text))).alias("word")).where(_content_word(F.col("word")))
    return long.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def _leaders(counts: DataFrame, key: str, doc: str | None, k: int) -> DataFrame:
    if doc is None:
        return counts.orderBy(F.col("n").desc(), key).limit(k)
    place = Window.partitionBy(doc).orderBy(F.col("n").desc(), key)
    return counts.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def keywords(docs: DataFrame, k: int = 25, doc: str | None = "doc_id", text: str = "text") -> DataFrame:
    return _leaders(word_counts(docs, doc, text), "word", doc, k)


def bigrams(docs: DataFrame, k: int = 15, doc: str | None = "doc_id", text: str = "text") -> DataFrame:
    """Adjacent content words that occur together more than once."""
    keys = [doc] if doc else []
    listed = sliced(docs.select(*keys, text)).select(*keys, words_of(F.col(text)).alias("w")).where(F.size("w") > 1)
    n = F.size("w") - 1
    pairs = listed.select(*keys, F.inline(F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("w", 2, n).alias("b"))))
    pairs = pairs.where(_content_word(F.col("a")) & _content_word(F.col("b")))
    counts = pairs.groupBy(*keys, F.concat_ws(" ", "a", "b").alias("bigram")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _leaders(counts, "bigram", doc, k)


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return spread(docs.select(doc, text)).select(doc, F.posexplode(F.split(clean(F.col(text)), "\n")).alias("line_no", "line"))


def numbers_in_context(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """Numbers with the text around them; bare one- and two-digit numbers are skipped.

    The gaps between matches give every match its place in the line.
    """
    lines = text_lines(docs, doc, text).select(
        doc, "line_no", "line", F.regexp_extract_all("line", F.lit(NUMBER), F.lit(0)).alias("found"), F.split("line", NUMBER).alias("gaps"))
    lines = lines.where(F.size("found") > 0)
    marks = F.aggregate(
        F.arrays_zip("found", F.slice("gaps", 1, F.size("found")).alias("gaps")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,found:string>>)").alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gaps"]) + F.length(m["found"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(m["gaps"])).alias("start"), m["found"].alias("found")))).alias("out")),
        lambda acc: acc["out"])
    spots = lines.select(doc, "line_no", "line", F.inline(marks))
    value = squeeze_ends(F.col("found"))
    first = F.greatest(F.lit(0), F.col("start") - CONTEXT_CHARS)
    last = F.col("start") + F.length("value") + CONTEXT_CHARS
    out = spots.withColumn("value", value).where(~F.col("value").rlike(r"^\d{1,2}$"))
    out = out.select(doc, "line_no", "start", "value", squeeze_ends(F.substring("line", first + 1, last - first)).alias("context"))
    if limit is None:
        return out
    place = Window.partitionBy(doc).orderBy("line_no", "start")
    return out.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= limit).drop("__r")


def dates_in_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    found = F.regexp_extract_all(clean(F.col(text)), F.lit(DATE), F.lit(0))
    kept = F.slice(found, 1, limit) if limit else found
    return docs.select(doc, F.posexplode(kept).alias("position", "found"))


def count_emails(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(doc, F.regexp_count(clean(F.col(text)), F.lit(EMAIL)).alias("emails"))


def headings(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """Lines with one to four leading hashes, or short lines that start like a title and hold no full stop."""
    lines = text_lines(docs, doc, text).withColumn("__t", squeeze_ends(F.col("line")))
    short = F.length("__t").between(4, 69) & F.col("__t").rlike(r"^[A-Z0-9][^.!?]*$")
    out = lines.where(F.col("line").rlike(r"(?U)^#{1,4}\s") | short).select(doc, "line_no", F.col("line").alias("heading"))
    if limit is None:
        return out
    place = Window.partitionBy(doc).orderBy("line_no")
    return out.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= limit).drop("__r")


def _runs(df: DataFrame, name: str, key: Callable[[Column], Column]) -> DataFrame:
    """df with the sorted array ``name`` cut into an array of runs that are equal in ``key``."""
    items, heads = F.col(name), F.col("__heads")
    first = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: (i == 1) | (key(F.get(items, i - 1)) != key(F.get(items, i - 2))))
    df = df.withColumn("__heads", F.when(F.size(items) > 0, first).otherwise(F.expr("cast(array() as array<int>)")))
    # Element by element: a slice reads the whole array, once for each run.
    cut = F.transform(heads, lambda h, j: F.transform(F.sequence(h, F.coalesce(F.get(heads, j + 1), F.size(items) + 1) - 1), lambda i: F.get(items, i - 1)))
    return df.withColumn(name, cut).drop("__heads")


def key_sentences(docs: DataFrame, k: int = 5, doc: str = "doc_id", text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Sentences richest in the document's frequent words; with ``max_chars`` only sentences shorter than that.

    A row is a document, and all is counted inside it, without a shuffle: words of the text and words of its sentences are sorted
    together, so that each run of one word knows how often the text holds it; the hits are sorted again by sentence."""
    base = spread(docs.select(doc, text)).select(
        doc, F.filter(words_of(F.col(text)), _content_word).alias("__w"),
        F.transform(sentences_of(F.col(text)), lambda s, i: F.struct(i.alias("position"), s.alias("sentence"))).alias("__s"))
    if max_chars is not None:
        base = base.withColumn("__s", F.filter("__s", lambda s: F.length(s["sentence"]) < max_chars))
    base = base.withColumn("__t", F.transform("__s", lambda s: F.regexp_extract_all(F.lower(s["sentence"]), F.lit(LETTERS), F.lit(0))))
    entry = lambda w, at: F.struct(w.alias("word"), at.cast("int").alias("at"))
    used = F.flatten(F.transform("__t", lambda words, i: F.transform(F.filter(words, _content_word), lambda w: entry(w, i))))
    every = _runs(base.withColumn("__e", F.sort_array(F.concat(F.transform("__w", lambda w: entry(w, F.lit(-1))), used))), "__e", lambda e: e["word"])
    # Words of the text come first in a run; as every sentence has a hit of 0, the runs by sentence line up with the sentences.
    every = every.withColumn("__e", F.transform("__e", lambda run: F.struct(F.size(F.filter(run, lambda e: e["at"] < 0)).alias("n"), run.alias("run"))))
    # A hit is one long: the sentence above, the count in the lower 32 bits.
    packed = lambda at: F.shiftleft(at.cast("long"), 32)
    hits = F.flatten(F.transform(F.filter("__e", lambda e: e["n"] > 0), lambda e: F.transform(
        F.filter(e["run"], lambda x: x["at"] >= 0), lambda x: packed(x["at"]) + e["n"])))
    none = F.transform("__s", lambda s, i: packed(i))
    summed = every.select(doc, "__s", "__t", F.array_max(F.transform("__e", lambda e: e["n"])).alias("__peak"), F.sort_array(F.concat(none, hits)).alias("__h"))
    summed = _runs(summed, "__h", lambda x: F.shiftright(x, 32)).withColumn(
        "__h", F.transform("__h", lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(0xFFFFFFFF))))
    peak = F.greatest(F.lit(1), F.coalesce("__peak", F.lit(1)))
    scored = F.transform(F.arrays_zip("__s", "__t", "__h"), lambda z: F.struct(
        (-(z["__h"] / peak / F.sqrt(F.greatest(F.lit(1), F.size(z["__t"]))))).alias("below"), z["__s"]["position"].alias("position"), z["__s"]["sentence"].alias("sentence")))
    best = summed.select(doc, F.posexplode(F.slice(F.sort_array(scored), 1, k)).alias("rank", "best"))
    return best.select(doc, "best.position", "best.sentence", (F.lit(0.0) - F.col("best.below")).alias("score"), (F.col("rank") + 1).alias("rank"))


def search_passages(docs: DataFrame, question: str, k: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages that hold the most words of the question (four letters or more)."""
    import re

    asked = re.findall(r"[^\W\d_]{4,}", question.lower())
    passages = spread(docs.select(doc, text)).select(doc, F.posexplode(F.split(F.col(text), PASSAGE_BREAK)).alias("position", "passage"))
    score = sum((F.lower("passage").contains(w).cast("int") for w in asked), F.lit(0))
    hit = passages.withColumn("score", score).where(F.col("score") > 0)
    place = Window.partitionBy(doc).orderBy(F.col("score").desc(), "position")
    out = hit.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.withColumn("passage", squeeze_ends(F.col("passage")))
