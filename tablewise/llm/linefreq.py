"""Quality rules on lines that a host repeats over many documents, all in DataFrame functions.

Each document's non-blank lines are normalised and hashed in its row. Documents are counted per (host, line); exact copies of a document
on one host are one document there, so a page that was crawled a thousand times does not condemn its own lines. Lines in more documents
than both limits allow are removed, and a document that keeps too few of its words is rejected.

Rows get a number when they are written once to the shared folder with their counts and line hashes; texts are read once. Counting
combines before the shuffle, so a line in a third of all documents is a few rows. Frequent lines go back to their documents by broadcast
as far as their number is bounded: beyond that only those that occur most, which no table can hold many of, and the rest by shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import BROADCAST_ROWS, WORD, aside, bounded_broadcast, stash

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MAX_DOCS, MAX_SHARE, LEAST_LEFT = 20, 0.001, 0.5
HOST = ["_none", "_host"]
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_lines", "words_left", "kept"]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words of an array lie in a window of three that occurs at least twice in it."""

    def covered(windows: Column) -> Column:
        def marked(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            places = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(paired, marked))

    def windows(hashes: Column) -> Column:
        inner = F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
        return F.transform(inner, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def measures(text: Column) -> Column:
    """A text's counts, and the hash and number of words of each of its lines that hold a word."""

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        plain = lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                        F.transform(lines, lambda x: F.struct(F.xxhash64(plain(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"))

    return F.struct(_let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("words"),
                    F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), of_lines).alias("lines"))


def rate_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT, texts: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_lines (lines removed), words_left and
    kept; text loses the lines removed, or is left out with texts=False.

    A line is removed if it occurs in more than max_docs distinct documents of its host, and in more than max_share of them; lines are
    equal if they are so in lower case with runs of spaces made one. kept is false for documents that fail the base rules (under 50 words, or
    over half of them in repeated windows of three) and for those that keep less than least_left of their words. docs needs text and
    the host's column; other columns pass through, those that bear one of the new names are replaced. A null host is a host. Every row
    is a document, but equal texts of one host are one in the counts; null and empty texts have no lines and fail the base rules. An
    empty table gives an empty result."""
    docs = docs.drop(*MADE)
    docs, back = aside(docs, {*HOST, "_row", "_m", "_one", "_two", "_first", "h", "n", "docs", "rows"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_none", F.col(host).isNull()).withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    rows = rows.withColumn("_one", F.xxhash64(text)).withColumn("_two", F.hash(text, F.lit(1))).withColumn("_m", measures(text))
    rows = stash(rows if texts else rows.drop("text"), "lines")
    m = F.col("_m")
    lines = m["lines"]["lines"]
    # Which rows are the first of their text on their host.
    copies = stash(rows.groupBy(*HOST, "_one", "_two").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    later = stash(rows.select("_row", *HOST, "_one", "_two").join(bounded_broadcast(copies), [*HOST, "_one", "_two"]).where("_row != first").select("_row"), "later-copies")
    new = rows.select("_row", *HOST, lines.alias("lines")).join(bounded_broadcast(later.withColumn("again", F.lit(1))), "_row", "left").withColumn("new", F.when(F.col("again").isNull(), 1).otherwise(0))
    counts = new.select(*HOST, "new", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy(*HOST, "h").agg(F.sum("new").alias("docs"), F.count(F.lit(1)).alias("rows"))
    hosts = stash(new.groupBy(*HOST).agg(F.sum("new").alias("all_docs"), F.sum(F.size("lines")).alias("all_lines")), "hosts")
    common = stash(counts.where(F.col("docs") > max_docs).join(bounded_broadcast(hosts), HOST).where(F.col("docs") > max_share * F.col("all_docs")).select(*HOST, "h", "rows"), "common-lines")
    each = rows.select("_row", *HOST, F.explode(lines).alias("l")).select("_row", *HOST, "l.h", F.col("l.n").alias("n"))
    n_common = common.count()
    if n_common <= BROADCAST_ROWS:
        hits = each.join(F.broadcast(common.drop("rows")), [*HOST, "h"])
    else:  # fewer than BROADCAST_ROWS lines can occur this often; the rest has no hot key
        often = (hosts.agg(F.sum("all_lines")).first()[0] or 0) / BROADCAST_ROWS
        hits = each.join(F.broadcast(common.where(F.col("rows") > often).drop("rows")), [*HOST, "h"]).unionByName(each.join(common.where(F.col("rows") <= often).drop("rows"), [*HOST, "h"]))
    gone = [F.count(F.lit(1)).alias("n_common_lines"), F.sum("n").alias("gone")] + ([F.collect_set("h").alias("h")] if texts else [])
    out = (rows if texts else rows.withColumn("_m", m.withField("lines", F.struct(m["lines"]["n_dup_lines"].alias("n_dup_lines"))))).join(hits.groupBy("_row").agg(*gone), "_row", "left")
    n_words, n_repeat = m["words"]["n_words"], m["words"]["n_repeat_words"]
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    left = n_words - F.coalesce("gone", F.lit(0))
    if texts:
        line_hash = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
        stays = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("h", line_hash(x))), "\n")
        out = out.withColumn("text", F.when(F.col("h").isNull(), F.col("text")).otherwise(stays))
    else:
        back = [c for c, name in zip(back, docs.columns, strict=True) if name != "text"]
    return out.select(*back, n_words.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["n_dup_lines"].alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
                      failed.alias("base_failed"), F.coalesce("n_common_lines", F.lit(0)).alias("n_common_lines"), left.alias("words_left"), (~failed & (left >= least_left * n_words)).alias("kept"))
