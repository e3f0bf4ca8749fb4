"""The registered queries of the numbered operators, each over its whole tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.contextmix import score_texts
from tablewise.llm.decontaminate import find_leaks
from tablewise.llm.hardneg import mine_hard_negatives
from tablewise.llm.linefreq import rate_lines
from tablewise.llm.mixing import mix_sources
from tablewise.llm.neardup import near_duplicates
from tablewise.llm.pii import KINDS, count_kind, find_pii, span_text
from tablewise.llm.preferences import conversations, format_branches, format_preferences, neighbour_pairs
from tablewise.llm.quality import score_quality
from tablewise.llm.shared import stash, word_count
from tablewise.llm.topk import quantised, top_k
from tablewise.llm.toxicity import score_toxicity
from tablewise.llm.treap import rank_documents
from tablewise.llm.urlfilter import judge_urls
from tablewise.session import configure

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and benchmark item that leaks into it; clean documents have none."""
    found = find_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.score", "l.start", "l.end")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "quality_vote", "quality", "keep")


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), width=2)


def op4_context_mixing(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score_texts(table(spark, sf, "documents"), held_out)


def op5_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    slim = stash(table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = mix_sources(slim, F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = quantised(table(spark, sf, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op7_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours as they are (pair_id from 0), and pairs that branch at a conversation's last answer (pair_id below 0)."""
    turns = table(spark, sf, "conversations")
    packed = stash(conversations(turns), "conversations")
    return format_preferences(turns, neighbour_pairs(turns), packed).unionByName(format_branches(turns, packed))


def op8_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge_urls(table(spark, sf, "pages").select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")).drop("text")


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = find_pii(table(spark, sf, "documents").select("doc_id", "text"))
    every = F.concat("pii_base", "pii_added")
    return found.select("doc_id", *[count_kind("pii_base", k).alias(f"n_{k}") for k in KINDS], F.sha2(span_text(F.col("pii_base")), 256).alias("base_sha256"),
                        span_text(every).alias("spans"), F.size("pii_added").cast("long").alias("n_added"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh row's label is moved on by one first."""
    e = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = e.where(F.coalesce(fine, F.lit(False))).select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    return mine_hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op12_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The host of a document is its source."""
    rated = rate_lines(table(spark, sf, "documents").select("doc_id", "source", "text"), texts=False)
    return rated.drop("source")


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 50)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_near_duplicates, op4_context_mixing, op5_mix_sources, op6_top_k, op7_preferences,
                                   op8_url_rules, op9_toxicity, op10_pii, op11_hard_negatives, op12_line_frequency, op13_ranked_search)}

_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

_URLS = """
with u as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(action, host, path)),
m as (select u.*, r.action, r.host || r.path as rule
      from u left join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select page_id, host, path, max_by(rule, length(rule)) as rule, coalesce(max_by(action, length(rule)), 'allow') as verdict
from m group by page_id, host, path"""

_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same, cast(list_sum(list_transform(list_zip(a.e, d.e), lambda z: z[1] * z[2])) as bigint) as score
      from v a join v d on a.vec_id % 100 = 0 and d.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_LINES = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, source is null as bare, coalesce(text, '') as text from documents),
w as (select r, list_filter(regexp_extract_all(text, '{_WORD}'), lambda x: x <> '') as ws from d),
g as (select r, i, (ws[i], ws[i + 1], ws[i + 2]) as three from (select r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w)),
t as (select r, unnest([i, i + 1, i + 2]) as i from (select r, i, count(*) over (partition by r, three) as n from g) where n > 1),
rep as (select r, count(distinct i) as n_repeat_words from t group by r),
l as (select r, host, bare, text, line, lower(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'))) as plain, len(regexp_extract_all(line, '{_WORD}')) as n
      from (select *, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD}')),
h as (select host, bare, count(distinct text) as docs from d group by host, bare),
f as (select host, bare, plain from (select host, bare, plain, count(distinct text) as n from l group by host, bare, plain) join h using (host, bare) where n > 20 and n > 0.001 * docs),
per as (select r, count(*) - count(distinct line) as n_dup_lines from l group by r),
c as (select r, count(*) as n_common_lines, cast(sum(n) as bigint) as gone from l join f using (host, bare, plain) group by r),
a as (select doc_id, len(ws) as n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_common_lines, 0) as n_common_lines, len(ws) - coalesce(gone, 0) as words_left
      from d join w using (r) left join rep using (r) left join per using (r) left join c using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and words_left >= 0.5 * n_words as kept from a"""

_SEARCH = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
b as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
c as (select count(*) as docs, cast(sum(len(ts)) as bigint) as terms from d where len(ts) > 0),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(ts) as n, unnest(ts) as term from d) group by r, doc_id, n, term),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term, docs),
s as (select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
      from b join p using (term) join w using (term), c group by item_id, r, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50"""

ORACLES = {"op6_top_k": _TOP_K, "op8_url_rules": _URLS, "op11_hard_negatives": _NEGATIVES, "op12_line_frequency": _LINES, "op13_ranked_search": _SEARCH}
