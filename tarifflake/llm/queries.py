"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, collocations, extraction, fingerprints, hostrules, mixing, neardup, pieces, quality, spelling, substrings, tokens, topk
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_warc_packages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.read_packages(archives.write_packages(table(spark, sf_dir, "pages")))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.scored(table(spark, sf_dir, "documents"), labels)


OP5_SQL = """
with rows as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
    from rows q, rows d where q.vec_id % 50 = 0 and d.vec_id <> q.vec_id
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""


@query("op5_top_vectors", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


@query("op6_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(table(spark, sf_dir, "documents"), lambda: pieces.encoder(path))


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_figures(table(spark, sf_dir, "documents"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = tokens.write_token_files(table(spark, sf_dir, "documents"), lambda: tokens.encoder(path))
    return tokens.read_token_files(files)


@query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


OP11_SQL = r"""
with pieces as (
    select row_number() over () as piece, lang, words from (
        select lang, regexp_extract_all(unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as words
        from (select coalesce(lang, 'und') as lang, text from documents)) where len(words) > 0
), places as (select lang, words, unnest(range(1, len(words) + 1)) as i from pieces),
grams as (
    select lang, words[i] as w1, words[i + 1] as w2, words[i + 2] as w3 from places
), one as (select lang, w1, count(*) as f from grams group by all),
two as (select lang, w1, w2, count(*) as f from grams where w2 is not null group by all having count(*) >= 10),
three as (select lang, w1, w2, w3, count(*) as f from grams where w3 is not null group by all having count(*) >= 10),
sizes as (select lang, sum(f) as n from one group by lang),
cuts as (
    select c.lang, c.w1 || ' ' || c.w2 as phrase, c.f as a, 1 as k, l.f as l, r.f as r
    from two c join one l on l.lang = c.lang and l.w1 = c.w1 join one r on r.lang = c.lang and r.w1 = c.w2
    where not exists (select 1 from three t where t.lang = c.lang and 100 * t.f >= 50 * c.f and ((t.w1 = c.w1 and t.w2 = c.w2) or (t.w2 = c.w1 and t.w3 = c.w2)))
    union all
    select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f
    from three c join one l on l.lang = c.lang and l.w1 = c.w1 join two r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
    union all
    select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f
    from three c join two l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join one r on r.lang = c.lang and r.w1 = c.w3
), scored as (
    select *, cast((1000000 * cast(a as hugeint) * a) // (cast(l as hugeint) * r) as bigint) as score from cuts
    qualify row_number() over (partition by lang, phrase order by (1000000 * cast(a as hugeint) * a) // (cast(l as hugeint) * r), k) = 1
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join sizes using (lang) where rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with texts as (
    select row_number() over () as row_id, doc_id, source as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
    select row_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select row_id, words, unnest(range(1, len(words) - 1)) as i from texts where len(words) >= 3)
), repeated as (
    select row_id, count(distinct place) as n from (
        select row_id, unnest([i, i + 1, i + 2]) as place from (select row_id, i, count(*) over (partition by row_id, a, b, c) as often from windows) where often > 1)
    group by row_id
), lines as (
    select row_id, sum(often - 1) as n from (
        select row_id, line, count(*) as often from (select row_id, unnest(string_split(text, chr(10))) as line from texts)
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by all)
    group by row_id
), stats as (
    select row_id, doc_id, host, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words
    from texts left join repeated using (row_id) left join lines using (row_id)
), fails as (
    select *, n_words < 50 as r1, 100 * n_repeat_words > 50 * n_words as r2, 100 * n_symbols > 10 * n_words as r3, 100 * n_dup_lines > 10 * n_words as r4 from stats
), rules as (
    select host, rule, sum(cast(failed as int)) as failed, count(*) as docs
    from (select host, unnest([1, 2, 3, 4]) as rule, unnest([r1, r2, r3, r4]) as failed from fails) group by all
), prior as (select rule, sum(failed) / sum(docs) as mean, var_pop(failed / docs) as spread from rules group by rule),
strength as (select *, case when spread > 0 then greatest(1.0, least(10000.0, mean * (1 - mean) / spread - 1)) else 10000.0 end as s from prior),
refused as (select host from rules join strength using (rule) group by host having max((failed + mean * s) / (docs + s)) >= 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 or r2) as base_failed,
    not (r1 or r2) and not exists (select 1 from refused where refused.host is not distinct from fails.host) as kept
from fails
"""


@query("op13_host_rules", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judged(table(spark, sf_dir, "documents")).drop("host", "host_refused")
