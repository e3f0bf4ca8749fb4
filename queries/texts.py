"""Text corpus (TX) and claim checking (VF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import ORACLES, load, query, r, rounded
from tablewise.operators import claims, text
from tablewise.operators.text import STOP_WORDS

W = r"[\p{L}][\p{L}\p{N}''’-]*"
STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
T = "replace(text, chr(13), '')"
# DuckDB's engine has no look-around: a break marker is written between sentences instead.
SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace({T}, '([.!?])\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(160))), lambda s: length(s) > 2)"""
DOCS = f"(select doc_id, {T} as t, regexp_extract_all(lower({T}), '{W}') as w, {SENTENCES} as s from documents)"


def docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


@query("tx01_text_stats", rf"""
    select doc_id, length(t) as chars, cast(len(w) as integer) as words, cast(len(list_distinct(w)) as integer) as distinct_words, cast(len(s) as integer) as sentences,
           cast(len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> '')) as integer) as paragraphs,
           {r('len(w) / 230.0')} as reading_minutes, {r('case when len(w) > 0 then len(list_distinct(w)) * 1.0 / len(w) else 0 end')} as lexical_diversity from {DOCS}""")
def tx01(spark, sf):
    stats = text.text_stats(docs(spark, sf)).select("doc_id", F.col("chars").cast("long"), "words", "distinct_words", "sentences", "paragraphs", "reading_minutes", "lexical_diversity")
    return rounded(stats)


SYLLABLES = r"list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]+')))))"


@query("tx02_flesch", f"""
    select doc_id, case when len(w) > 0 and len(s) > 0 then {r(f'206.835 - 1.015 * (len(w) * 1.0 / len(s)) - 84.6 * ({SYLLABLES} * 1.0 / len(w))', 3)} end as flesch from {DOCS}""")
def tx02(spark, sf):
    return rounded(text.text_stats(docs(spark, sf)).select("doc_id", "flesch"), 3)


WORD_COUNTS = f"""(select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from {DOCS}) where length(word) >= 3 and word not in ({STOPS}) group by all)"""


@query("tx03_keywords", f"select word, cast(sum(n) as bigint) as n from {WORD_COUNTS} group by 1 order by 2 desc, 1 limit 25")
def tx03(spark, sf):
    return text.keywords(docs(spark, sf), 25, doc=None)


@query("tx03_keywords_per_document", f"""
    select doc_id, word, n, cast(rk as integer) as rank from (select *, row_number() over (partition by doc_id order by n desc, word) as rk from {WORD_COUNTS}) where rk <= 25""")
def tx03b(spark, sf):
    return text.keywords(docs(spark, sf), 25)


@query("tx04_bigrams", f"""
    with p as (select unnest(list_zip(w[1:-2], w[2:])) as z from {DOCS} where len(w) > 1), b as (select z[1] as a, z[2] as b from p)
    select concat(a, ' ', b) as bigram, count(*) as n from b where length(a) >= 3 and length(b) >= 3 and a not in ({STOPS}) and b not in ({STOPS}) group by 1 having count(*) > 1 order by 2 desc, 1 limit 15""")
def tx04(spark, sf):
    return text.bigrams(docs(spark, sf), 15, doc=None)


@query("tx05_numbers_in_context", r"""
    with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as line from documents),
    n as (select doc_id, trim(unnest(regexp_extract_all(line, '(?i)[$€£]?\s?-?\d[\d,]*\.?\d*(?:\s?%|\s?(?:percent|million|billion|bn|k|m)\b)?')), ' ' || chr(9)) as value from l)
    select doc_id, value, count(*) as n from n where not regexp_full_match(value, '\d{1,2}') group by all""")
def tx05(spark, sf):
    return text.numbers_in_context(docs(spark, sf)).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


NUMBER = r"(?i)[$€£]?\s?-?\d[\d,]*\.?\d*(?:\s?%|\s?(?:percent|million|billion|bn|k|m)\b)?"


@query("tx05_number_contexts", rf"""
    with d as (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as a from documents),
    l as (select doc_id, unnest(range(len(a))) as line_no, unnest(a) as line from d),
    m as (select *, regexp_extract_all(line, '{NUMBER}') as f, regexp_split_to_array(line, '{NUMBER}') as g from l),
    n as (select doc_id, line_no, line, f, g, unnest(range(1, len(f) + 1)) as i from m where len(f) > 0),
    p as (select doc_id, line_no, line, trim(f[i], ' ' || chr(9)) as value,
                 list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as start from n)
    select doc_id, cast(line_no as integer) as line_no, cast(start as integer) as start, value,
           trim(substring(line, cast(greatest(0, start - 50) as bigint) + 1, cast(start + length(value) + 50 - greatest(0, start - 50) as bigint)), ' ' || chr(9)) as context
    from p where not regexp_full_match(value, '\d{{1,2}}')""")
def tx05b(spark, sf):
    return text.numbers_in_context(docs(spark, sf))


@query("tx06_dates_in_text", r"""
    with d as (select doc_id, regexp_extract_all(replace(text, chr(13), ''), '\b(?:\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:\d{1,2}\s)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s\d{4})\b') as f from documents
               union all select -1 - o_orderkey, [concat(day(o_orderdate), ' ', strftime(o_orderdate, '%b %Y')), strftime(o_orderdate, '%Y-%m-%d')] from orders)
    select doc_id, cast(unnest(range(len(f))) as integer) as position, unnest(f) as found from d""")
def tx06(spark, sf):
    made = load(spark, sf, "orders").selectExpr("-1 - o_orderkey as doc_id", "concat('Sent on ', date_format(o_orderdate, 'd MMM yyyy'), ', due ', date_format(o_orderdate, 'yyyy-MM-dd'), '.') as text")
    return text.dates_in_text(docs(spark, sf).unionByName(made))


@query("tx06_count_emails", r"select doc_id, cast(len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) as integer) as emails from documents")
def tx06b(spark, sf):
    return text.count_emails(docs(spark, sf))


@query("tx07_headings", r"""
    with l as (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as l from documents), e as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as heading from l)
    select doc_id, cast(line_no as integer) as line_no, heading from e where regexp_matches(heading, '^#{1,4}\s')
       or (length(trim(heading, ' ' || chr(9) || chr(160))) between 4 and 69 and regexp_full_match(trim(heading, ' ' || chr(9) || chr(160)), '[A-Z0-9][^.!?]*'))""")
def tx07(spark, sf):
    return text.headings(docs(spark, sf))


KEY_SENTENCES = rf"""
    with pk as (select doc_id, max(n) as peak from {WORD_COUNTS} group by 1),
    s as (select doc_id, unnest(range(len(s))) as position, unnest(s) as sentence from {DOCS}),
    t as (select doc_id, position, regexp_extract_all(lower(sentence), '[\p{{L}}]+') as w from s where {{kept}}),
    x as (select doc_id, position, unnest(w) as word from t),
    h as (select x.doc_id, position, sum(n) as hits from x join {WORD_COUNTS} c on c.doc_id = x.doc_id and c.word = x.word group by 1, 2),
    v as (select t.doc_id, t.position, coalesce(hits, 0) / greatest(1, coalesce(peak, 1)) / sqrt(greatest(1, len(w))) as score
          from t left join h using (doc_id, position) left join pk on pk.doc_id = t.doc_id)
    select doc_id, cast(position as integer) as position, {r('score')} as score, cast(rk as integer) as rank
    from (select *, row_number() over (partition by doc_id order by score desc, position) as rk from v) where rk <= 5"""


@query("tx08_key_sentences", KEY_SENTENCES.replace("{kept}", "length(sentence) < 400"))
def tx08(spark, sf):
    return rounded(text.key_sentences(docs(spark, sf), 5, max_chars=400).select("doc_id", "position", "score", "rank"))


@query("tx08_key_sentences_any_length", KEY_SENTENCES.replace("{kept}", "true"))
def tx08b(spark, sf):
    return rounded(text.key_sentences(docs(spark, sf), 5).select("doc_id", "position", "score", "rank"))


QUESTION = "Which model training data should their system find?"


@query("tx09_search_passages", r"""
    with p as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as l from documents),
    e as (select doc_id, unnest(range(len(l))) as position, lower(unnest(l)) as passage from p),
    s as (select doc_id, position, cast(contains(passage, 'which') as int) + cast(contains(passage, 'model') as int) + cast(contains(passage, 'training') as int) + cast(contains(passage, 'data') as int)
          + cast(contains(passage, 'should') as int) + cast(contains(passage, 'their') as int) + cast(contains(passage, 'system') as int) + cast(contains(passage, 'find') as int) as score from e)
    select doc_id, cast(position as integer) as position, score, cast(rk as integer) as rank
    from (select *, row_number() over (partition by doc_id order by score desc, position) as rk from s where score > 0) where rk <= 3""")
def tx09(spark, sf):
    return text.search_passages(docs(spark, sf), QUESTION).select("doc_id", "position", "score", "rank")


# --- VF: numbers quoted in a text against computed results ---
ANSWER = ("concat('Order total of $', replace(format_number(floor(o_totalprice / 100) / 10, 1), ',', ''), 'K in 1998, about ', case when o_orderkey % 10 = 0 then '777,777' else '7' end, "
          "' units and a change of ', cast(o_orderkey % 40 as string), '.5%.')")


@query("vf01_verify_claims", f"""
    with q as (select o_orderkey as answer_id, '$' || printf('%.1f', floor(o_totalprice / 100) / 10) || 'K' as token, floor(o_totalprice / 100) * 100 as v, false as pct, 0 as pos, o_totalprice as f1, (o_orderkey % 40 + 0.5) / 100 as f2, o_orderkey % 3 as m from orders
        union all select o_orderkey, case when o_orderkey % 10 = 0 then '777,777' else '7' end, case when o_orderkey % 10 = 0 then 777777 else 7 end, false, 2, o_totalprice, (o_orderkey % 40 + 0.5) / 100, o_orderkey % 3 from orders
        union all select o_orderkey, (o_orderkey % 40) || '.5%', o_orderkey % 40 + 0.5, true, 3, o_totalprice, (o_orderkey % 40 + 0.5) / 100, o_orderkey % 3 from orders),
    c as (select answer_id, pos, token, f1, case when m = 0 then f2 end as f2, unnest(case when pct then [v, v / 100, -v, -v / 100] else [v, -v] end) as c from q),
    k as (select *, unnest(list_concat([f1, f2], list_transform(range(13), lambda i: i * 1.0))) as k from c)
    select answer_id, token from k group by answer_id, pos, token
    having not bool_or(coalesce(abs(k - c) <= greatest(greatest(abs(k), abs(c)) * 0.011, case when abs(c) < 10 then 0.051 else 0.51 end), false))""")
def vf01(spark, sf):
    orders = load(spark, sf, "orders")
    answers = orders.selectExpr("o_orderkey as answer_id", f"{ANSWER} as text")
    results = orders.selectExpr("o_orderkey as answer_id", "o_totalprice", "case when o_orderkey % 3 = 0 then (o_orderkey % 40 + 0.5) / 100 end as change")
    return claims.verify_claims(answers, claims.extract_facts(results, "answer_id")).select("answer_id", "token")


@query("vf01_verify_claims_ranges", ORACLES["vf01_verify_claims"])
def vf01b(spark, sf):
    """Facts and quoted numbers spread over ranges, as for answers with very many facts."""
    orders = load(spark, sf, "orders")
    answers = orders.selectExpr("o_orderkey as answer_id", f"{ANSWER} as text")
    results = orders.selectExpr("o_orderkey as answer_id", "o_totalprice", "case when o_orderkey % 3 = 0 then (o_orderkey % 40 + 0.5) / 100 end as change")
    return claims.verify_claims(answers, claims.extract_facts(results, "answer_id"), ranges=6).select("answer_id", "token")


@query("vf02_extract_facts", f"""
    select o_orderkey, o_totalprice as value from orders union all select o_orderkey, cast(o_custkey as double) from orders
    union all select o_orderkey, round(floor(o_totalprice / 100) * 100, 2) from orders union all select o_orderkey, 12.5 from orders""")
def vf02(spark, sf):
    results = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "o_custkey", "concat('about $', replace(format_number(floor(o_totalprice / 100) / 10, 1), ',', ''), 'K, up 12.5%') as note", "o_orderkey > 5 as flag")
    return rounded(claims.extract_facts(results, "o_orderkey"), 2)
