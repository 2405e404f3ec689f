"""Text queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.functions import text as T
from sedimento.operators import textops
from sedimento.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _texts(spark, d).select("id", F.size(t).cast("bigint").alias("token_count"), F.array_join(t, " ").alias("tokens"))


def text_dedup_line(spark: SparkSession, d: str) -> DataFrame:
    return textops.dedup_lines(_texts(spark, d)).select("id", "changed", "total", "cleaned")


def text_dedup_token(spark: SparkSession, d: str) -> DataFrame:
    return textops.dedup_tokens(_texts(spark, d)).select("id", "changed", "total", "cleaned")


def stopwords(spark: SparkSession, d: str) -> DataFrame:
    return textops.remove_stop_words(_texts(spark, d)).select("id", "changed", "total", "cleaned")


def stemming(spark: SparkSession, d: str) -> DataFrame:
    return textops.stem_tokens(_texts(spark, d)).select("id", "changed", "total", "cleaned")


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return textops.text_quality(_texts(spark, d))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return textops.clean_text(_texts(spark, d))


def text_meta(spark: SparkSession, d: str) -> DataFrame:
    return textops.text_meta(_texts(spark, d))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return textops.sentences(_texts(spark, d))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return textops.bigrams(_texts(spark, d))


QUERIES = {f.__name__: f for f in (tokenize, text_dedup_line, text_dedup_token, stopwords, stemming, text_quality, clean_text, text_meta, sentence_split, bigram_counts)}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOK = r"regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+')"
_SQUEEZE = lambda c: f"regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"
_LINES = r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

SQL = {
    "tokenize": f"select doc_id as id, len({_TOK})::bigint as token_count, array_to_string({_TOK}, ' ') as tokens from documents",
    "text_dedup_line": f"""
        with u as (select doc_id as id, list_filter(list_transform({_LINES}, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') as u from documents),
        k as (select id, u, list_filter(u, lambda x, i: list_position(list_transform(u, lambda y: lower(y)), lower(x)) = i) as k from u)
        select id, (len(u) - len(k))::bigint as changed, len(u)::bigint as total, {_SQUEEZE("array_to_string(k, chr(10))")} as cleaned from k where len(u) > len(k)""",
    "text_dedup_token": f"""
        with u as (select doc_id as id, {_TOK} as u from documents),
        e as (select id, unnest(u) as t, generate_subscripts(u, 1) as i from u),
        f as (select id, lower(t) as k, min(i) as i, arg_min(t, i) as t, count(*) as n from e group by id, lower(t))
        select id, (sum(n) - count(*))::bigint as changed, sum(n)::bigint as total, string_agg(t, ' ' order by i) as cleaned from f group by id having sum(n) > count(*)""",
    "stopwords": f"""
        with u as (select doc_id as id, {_TOK} as u from documents),
        k as (select id, u, list_filter(u, lambda t: lower(t) not in ({_STOP})) as k from u)
        select id, (len(u) - len(k))::bigint as changed, len(u)::bigint as total, array_to_string(k, ' ') as cleaned from k where len(u) > len(k)""",
    "stemming": f"""
        with e as (select id, unnest(u) as t, generate_subscripts(u, 1) as i from (select doc_id as id, {_TOK} as u from documents)),
        s as (select id, i, t, case when t !~ '^[A-Za-z0-9_]+$' then t
            when lower(t) like '%ingly' and length(t) >= 7 then left(lower(t), length(t) - 5) when lower(t) like '%edly' and length(t) >= 6 then left(lower(t), length(t) - 4)
            when lower(t) like '%ing' and length(t) >= 5 then left(lower(t), length(t) - 3) when lower(t) like '%ed' and length(t) >= 4 then left(lower(t), length(t) - 2)
            when lower(t) like '%ies' and length(t) >= 5 then left(lower(t), length(t) - 3) || 'y' when lower(t) like '%es' and length(t) >= 4 then left(lower(t), length(t) - 2)
            when lower(t) like '%s' and length(t) >= 4 then left(lower(t), length(t) - 1) else lower(t) end as k from e)
        select id, sum((t <> k)::int)::bigint as changed, count(*)::bigint as total, string_agg(k, ' ' order by i) as cleaned from s group by id having sum((t <> k)::int) > 0""",
    "text_quality": f"""
        with x as (select doc_id as id, length(text) as n, regexp_replace(text, '{_WS}+', '', 'g') = '' as blank from documents where text is not null)
        select id, case when blank then 'empty_text' else 'short_text' end as issue, case when blank then 1.0::double else 1 - n / 200.0::double end as confidence from x where blank or n < 200""",
    "clean_text": f"select doc_id as id, {_SQUEEZE('text')} as cleaned from documents",
    "text_meta": f"select doc_id as id, (len({_LINES}) - (list_extract({_LINES}, -1) = '')::int)::bigint as line_count, length(text)::bigint as characters from documents where text is not null",
    "sentence_split": """
        select id, (i - 1)::bigint as n, s as sentence from (select id, unnest(u) as s, generate_subscripts(u, 1) as i from
            (select doc_id as id, regexp_extract_all(text, '[^。！？!?]+[。！？!?]') as u from documents))""",
    "bigram_counts": f"""
        with t as (select doc_id as id, regexp_replace(text, '{_WS}+', '', 'g') as t from documents where text is not null), p as (select id, t, unnest(range(1, length(t)))::int as i from t where length(t) >= 2)
        select id, substring(t, i, 2) as bigram, count(*)::bigint as n from p group by 1, 2""",
}
