"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewright.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return build

    return register


_MIX_SQL = r"""
with sized as (
    select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
        md5('mix:' || coalesce(cast(doc_id as varchar), '')) || ':' || coalesce(cast(doc_id as varchar), '') as place
    from documents),
sources as (
    select source, cast(sum(size) as bigint) as source_size, source is null as nosource,
        [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)] as weight
    from sized group by source),
levels as (
    select *, 2 * source_size as cap, 2.0::double * source_size / weight as fills_at,
        1.5::double * sum(source_size) over () as budget,
        coalesce(sum(2 * source_size) over (order by 2.0::double * source_size / weight rows between unbounded preceding and 1 preceding), 0) as held,
        sum(weight) over (order by 2.0::double * source_size / weight rows between current row and unbounded following) as open_weight
    from sources),
water as (
    select cast(max((budget - held) / open_weight) as double) as level from levels
    where (budget - held) / open_weight < fills_at),
targets as (
    select source, nosource, source_size,
        case when cast(cap as double) <= coalesce(level, 'infinity'::double) * weight then cast(cap as double) else level * weight end as target
    from levels, water),
queued as (
    select sized.doc_id, sized.source, sized.size, place, nosource, source_size, target,
        sum(size) over (partition by sized.source order by place) as upto
    from sized join targets on sized.source is not distinct from targets.source),
entries as (
    select size, cast(k * source_size + upto as double) / target as finish, nosource, source, place
    from queued, (values (0), (1)) turns(k) where size > 0 and target > 0),
merged as (
    select *, sum(size) over (order by finish, nosource, source, place) as words from entries),
passed as (
    select source, place, count(*) as times from (select distinct finish, source, place, words from merged)
    where words <= (select any_value(budget) from levels) group by source, place)
select doc_id, size, source_size, target, cast(size * coalesce(times, 0) as bigint) as taken
from queued left join passed on queued.source is not distinct from passed.source and queued.place = passed.place
"""


@query("op6_mix_sources", _MIX_SQL)
def op6(t: Tables) -> DataFrame:
    from lakewright.llm.mixing import mix

    return mix(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def op8(t: Tables) -> DataFrame:
    from lakewright.llm.counting import token_counts

    return token_counts(t.documents, limit=4096)


@query("op2_language")
def op2(t: Tables) -> DataFrame:
    from lakewright.llm.language import fit, held_out, identify

    found = identify(t.documents, fit(t.documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "shares")


@query("op9_quality")
def op9(t: Tables) -> DataFrame:
    from lakewright.llm.quality import assess, fit

    return assess(t.documents, fit(t.documents, t.labels))


@query("op4_line_dedup")
def op4(t: Tables) -> DataFrame:
    from lakewright.llm.lines import without_repeated_runs

    return without_repeated_runs(t.documents).drop("text")


_EXACT_SQL = r"""
with plain as (
    select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain
    from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by plain) as group_size,
    row_number() over best = 1 as kept, text_sha256
from plain window best as (partition by plain order by n_chars desc, doc_id nulls last)
"""


@query("op5_exact_dedup", _EXACT_SQL)
def op5(t: Tables) -> DataFrame:
    from lakewright.llm.exact import exact_duplicates

    return exact_duplicates(t.documents)


@query("op1_sentencepiece")
def op1(t: Tables) -> DataFrame:
    from lakewright.llm.sampling import digests

    return digests(t.documents)


@query("op10_private_data")
def op10(t: Tables) -> DataFrame:
    from lakewright.llm.private import EVERY, private_spans

    return private_spans(t.documents, kinds=EVERY)


@query("op3_near_dedup")
def op3(t: Tables) -> DataFrame:
    from lakewright.llm.neardup import near_duplicates

    return near_duplicates(t.documents)


@query("op7_suffix_dedup")
def op7(t: Tables) -> DataFrame:
    from lakewright.llm.suffixes import without_repeats

    return without_repeats(t.documents).drop("kept")


_CHAT_SQL = r"""
with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
turns as (
    select *, row_number() over place as k, lag(role) over place is not distinct from role as goes_on,
        length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as chars,
        length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) as role_chars
    from rows_ window place as (partition by conv_id order by turn nulls last, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by k)) as loss_sha256,
    cast(sum(chars + case when goes_on then 11 else 12 + role_chars + 1 + 11 end) as bigint) as formatted_chars,
    cast(sum(case when goes_on then 0 else 1 end) as bigint) as n_blocks
from turns group by conv_id
"""


@query("op11_chat_format", _CHAT_SQL)
def op11(t: Tables) -> DataFrame:
    from lakewright.llm.chat import digests

    said = "<|im_end|><|im_start|>assistant ok"
    extra = t.spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    return digests(t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra))


def _clusters_sql(rounds: int) -> str:
    """Every round compares all vectors with all centroids, component by component."""
    parts = ["""
with vecs as materialized (
    select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
long_ as materialized (select rn, unnest(v) as x, generate_subscripts(v, 1) as i from vecs),
first_ as materialized (
    select rn, row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c from vecs
    qualify row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) <= 40),
cent0 as materialized (select c, i, x as y from first_ join long_ using (rn))"""]
    for k in range(rounds + 1):
        parts.append(f"""
near{k} as materialized (
    select rn, c, d from (select rn, c, cast(sum((x - y) * (x - y)) as bigint) as d from long_ join cent{k} using (i) group by rn, c)
    qualify row_number() over (partition by rn order by d, c) = 1)""")
        if k < rounds:
            parts.append(f"""
cent{k + 1} as materialized (
    select old.c, old.i, coalesce(new.y, old.y) as y from cent{k} old left join (
        select c, i, cast(floor(sum(x) / count(*)) as bigint) as y from near{k} join long_ using (rn) group by c, i) new using (c, i))""")
    parts.append(f"""
names as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) as centroid_sha256 from cent{rounds} group by c)""")
    return ",".join(parts) + f"""
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
    cast(sum(d) over () as bigint) as inertia, centroid_sha256
from near{rounds} join vecs using (rn) join names using (c)
"""


@query("op13_centroid_clusters", _clusters_sql(5))
def op13(t: Tables) -> DataFrame:
    from lakewright.llm.clusters import cluster

    return cluster(t.embeddings)


_TERMS_OF = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_SEARCH_SQL = f"""
with docs as materialized (select row_number() over () as d, doc_id, {_TERMS_OF} as terms from documents),
totals as materialized (select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from docs where len(terms) > 0),
postings as materialized (select d, term, count(*) as tf from (select d, unnest(terms) as term from docs) group by d, term),
weights as materialized (
    select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from postings, totals group by term, n_docs),
sizes as materialized (select d, doc_id, 75 + (25 * len(terms) * n_docs) // n_terms as m from docs, totals where len(terms) > 0),
items as materialized (
    select i, item_id, term, count(*) as times from (
        select i, item_id, unnest(terms) as term from (select row_number() over () as i, item_id, {_TERMS_OF} as terms from benchmark))
    group by i, item_id, term),
scores as (
    select i, item_id, doc_id, d, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
    from items join weights using (term) join postings using (term) join sizes using (d) group by i, item_id, doc_id, d)
select item_id, cast(row_number() over best as integer) as rank, doc_id, score from scores where score > 0
window best as (partition by i order by score desc, doc_id nulls last) qualify row_number() over best <= 20
"""


@query("op12_lexical_search", _SEARCH_SQL)
def op12(t: Tables) -> DataFrame:
    from lakewright.llm.search import search

    return search(t.documents, t.benchmark)
