"""Queries of the text operators over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions import text as X
from quarterloom.plans import pipelines as L
from quarterloom.sources import table
from quarterloom.sources.lexicons import CATEGORIES, full_terms, lexicon_table, loaded_lexicons

# The lists as the SQL has them; the queries read theirs from files.
_LISTS = {c: frozenset(full_terms(c)) for c in CATEGORIES}
_TOKENS = "regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?')"
_quoted = lambda terms: ", ".join("'" + t.replace("'", "''") + "'" for t in sorted(terms))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.inline(F.array(F.struct(X.tokens("text").alias("words")))))


def t1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _words(spark, folder).select("doc_id", F.expr("if(words is null, null, cast(size(words) as bigint))").alias("n_tokens"), F.md5(F.array_join("words", " ")).alias("tokens_md5"))


def t3_lexicon_score(spark: SparkSession, folder: str) -> DataFrame:
    return X.with_scores(_words(spark, folder), "words", {"uncertainty": loaded_lexicons(spark)["uncertainty"]}, "full").withColumn("uncertainty_density_full", F.round("uncertainty_density_full", 9))


def t4_density_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and density by type of document."""
    kinds = table(spark, folder, "documents").select("doc_id", "doc_type")
    by = t3_lexicon_score(spark, folder).join(kinds, "doc_id").groupBy("doc_type").agg(F.sum("uncertainty_count_full").alias("hits"), F.sum("total_tokens_full").alias("tokens"))
    return by.select("doc_type", "hits", "tokens", F.round(X.density("hits", "tokens"), 9).alias("density"))


def t7_multi_category(spark: SparkSession, folder: str) -> DataFrame:
    lists = loaded_lexicons(spark)
    scores = X.with_scores(_words(spark, folder), "words", lists, "full")
    return scores.select("doc_id", "total_tokens_full", *(f"{c}_count_full" for c in lists), "negation_excluded_full")


def j4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """How often each lexicon term occurs: tokens joined to the lexicon, a list of fixed size."""
    long = _words(spark, folder).select(F.explode("words").alias("term"))
    terms = F.broadcast(lexicon_table(spark, loaded_lexicons(spark)))
    return long.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term").select("category", "term", "n")


def s3_lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """The lists as their files give them, after the size guard."""
    terms = lexicon_table(spark, loaded_lexicons(spark))
    return terms.groupBy("category").agg(F.count("*").alias("n_terms"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")).alias("terms_md5"))


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus").select("corpus_id", "transcript").withColumn("start", X.section_start("transcript"))


def t5_section_start(spark: SparkSession, folder: str) -> DataFrame:
    return _transcripts(spark, folder).select("corpus_id", F.col("start").cast("bigint").alias("start"))


def t6_section(spark: SparkSession, folder: str) -> DataFrame:
    part = _transcripts(spark, folder).withColumn("part", X.section("transcript", "start"))
    return part.select("corpus_id", F.length("part").cast("bigint").alias("part_length"), F.md5("part").alias("part_md5"))


def t8_plain_section(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "corpus").select("corpus_id", X.plain_section("transcript").alias("part"))
    return part.select("corpus_id", F.length("part").cast("bigint").alias("part_length"), F.md5("part").alias("part_md5"))


def t9_plain_density(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.plain_density("text").alias("density"))


def t10_figures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.figure_cascade("text").alias("figure"))


def pr17_usable(spark: SparkSession, folder: str) -> DataFrame:
    """Density of the section where it is long enough, else null."""
    part = _transcripts(spark, folder).withColumn("part", X.section("transcript", "start"))
    words = part.select("corpus_id", F.inline(F.array(F.struct(X.tokens("part").alias("words")))))
    scores = X.with_scores(words, "words", {"uncertainty": loaded_lexicons(spark)["uncertainty"]}, "qa")
    return scores.select("corpus_id", F.when(F.col("total_tokens_qa") >= 500, F.round("uncertainty_density_qa", 9)).alias("density"))


def s2_feature_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The counts and outcomes of the whole feature build."""
    rows = L.build_features(table(spark, folder, "corpus"), loaded_lexicons(spark), F.lit(True))
    counts = [f"{c}_count_{part}" for part in ("full", "qa") for c in _LISTS]
    return rows.select(
        "ticker", F.col("year").cast("bigint").alias("year"), F.col("quarter").cast("bigint").alias("quarter"), "qa_isolated", "total_tokens_full", "total_tokens_qa",
        "negation_excluded_full", "negation_excluded_qa", *counts, F.round("eps_ttm_next_q", 6).alias("eps_ttm_next_q"), F.round("eps_ttm_growth_next_q", 6).alias("growth"),
    )


def _score_sql(key: str, source: str, text: str, terms: str) -> str:
    return f"""
    tok as (select {key}, unnest({_TOKENS.format(text)}) as t, generate_subscripts({_TOKENS.format(text)}, 1) as i from {source}),
    neg as (select *, max(case when t in ({_quoted(X.NEGATORS)}) then 1 else 0 end) over (partition by {key} order by i rows between 3 preceding and 1 preceding) as negated from tok),
    hit as (select {key}, count(*) filter (where t in ({terms}) and coalesce(negated, 0) = 0) as c, count(*) filter (where t in ({terms}) and negated = 1) as x from neg group by {key})"""


_START_SQL = " , ".join(
    f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda j: coalesce(list_sum(list_transform(p{k}[1:j], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m{k}[1:j-1], lambda s: length(s))), 0)), lambda v: v >= 0.15::double * n and v <= 0.95::double * n)[1]"""
    for k in range(3)
)
_SECTIONS = (
    "pieces as (select corpus_id, transcript, length(transcript) as n, "
    + ", ".join(f"string_split_regex(transcript, '(?i){p}') as p{k}, regexp_extract_all(transcript, '(?i){p}') as m{k}" for k, p in enumerate(X.SECTION_PATTERNS))
    + f" from corpus), starts as (select corpus_id, transcript, case when n > 0 then cast(coalesce({_START_SQL}) as bigint) end as start from pieces)"
)
_U = _quoted(_LISTS["uncertainty"])
_T3 = f"with {_score_sql('doc_id', 'documents', 'text', _U)} select d.doc_id, case when text is null then null else len({_TOKENS.format('text')}) end as total_tokens_full, case when text is null then null else coalesce(c, 0) end as uncertainty_count_full, case when text is null then null else coalesce(x, 0) end as negation_excluded_full, round(coalesce(c, 0)::double / nullif(len({_TOKENS.format('text')}), 0)::double * 100, 9) as uncertainty_density_full from documents d left join hit h on d.doc_id = h.doc_id"
_MARKS = " ".join(f"when instr(transcript, '{m}') > 0 then substring(transcript, instr(transcript, '{m}') + {len(m)})" for m in X.PLAIN_MARKERS)
_WORDS9 = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"

_DEDUP = "dedup as (select * from (select *, row_number() over (partition by ticker, year, quarter order by coalesce(length(transcript), -1) desc, corpus_id) as rn from corpus where ticker is not null and year is not null and quarter is not null) where rn = 1)"
_COUNTS = ", ".join(f"count(*) filter (where t in ({_quoted(t)}) and negated = 0) as {c}" for c, t in _LISTS.items())
_BUILD = (
    f"with {_DEDUP}, {_SECTIONS.replace('from corpus)', 'from dedup)')}, parts as (select corpus_id, 'full' as part, transcript as body from dedup union all select corpus_id, 'qa', case when start is not null then substring(transcript, start + 1) end from starts), "
    f"tok as (select corpus_id, part, unnest({_TOKENS.format('body')}) as t, generate_subscripts({_TOKENS.format('body')}, 1) as i from parts), "
    f"neg as (select *, coalesce(max(case when t in ({_quoted(X.NEGATORS)}) then 1 else 0 end) over (partition by corpus_id, part order by i rows between 3 preceding and 1 preceding), 0) as negated from tok), "
    f"hit as (select corpus_id, part, count(*) as n, count(*) filter (where t in ({_U}) and negated = 1) as x, {_COUNTS} from neg group by corpus_id, part), "
    "f as (select p.corpus_id, p.part, case when body is not null then coalesce(n, 0) end as n, case when body is not null then coalesce(x, 0) end as x, "
    + ", ".join(f"case when body is not null then coalesce({c}, 0) end as {c}" for c in _LISTS)
    + " from parts p left join hit h on p.corpus_id = h.corpus_id and p.part = h.part), "
    "o as (select corpus_id, eps12mtrailing_qavg as e, case when lead(year * 4 + quarter) over w - (year * 4 + quarter) = 1 then lead(eps12mtrailing_qavg) over w end as nx from dedup window w as (partition by ticker order by year * 4 + quarter)) "
    "select d.ticker, d.year::bigint as year, d.quarter::bigint as quarter, s.start is not null as qa_isolated, a.n as total_tokens_full, b.n as total_tokens_qa, a.x as negation_excluded_full, b.x as negation_excluded_qa, "
    + ", ".join(f"{t}.{c} as {c}_count_{part}" for t, part in (("a", "full"), ("b", "qa")) for c in _LISTS)
    + ", round(nx, 6) as eps_ttm_next_q, round((nx - e) / nullif(abs(e), 0) * 100, 6) as growth from dedup d join starts s on d.corpus_id = s.corpus_id join f a on a.corpus_id = d.corpus_id and a.part = 'full' join f b on b.corpus_id = d.corpus_id and b.part = 'qa' join o on o.corpus_id = d.corpus_id"
)

QUERIES = {name: f for name, f in globals().items() if re.match(r"(?:t|j|pr|s)\d+_", name)}
ORACLE = {
    "s3_lexicons": " union all ".join(f"select '{c}' as category, len(l) as n_terms, md5(array_to_string(list_sort(l), ' ')) as terms_md5 from (select [{_quoted(t)}] as l)" for c, t in _LISTS.items()),
    "s2_feature_scores": _BUILD,
    "t1_tokens": f"select doc_id, len({_TOKENS.format('text')}) as n_tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) as tokens_md5 from documents",
    "t3_lexicon_score": _T3,
    "t4_density_by_type": f"select doc_type, sum(uncertainty_count_full)::bigint as hits, sum(total_tokens_full)::bigint as tokens, round(sum(uncertainty_count_full)::double / nullif(sum(total_tokens_full), 0)::double * 100, 9) as density from ({_T3}) s join documents d using (doc_id) group by doc_type",
    "t7_multi_category": "with tok as (select doc_id, unnest({0}) as t, generate_subscripts({0}, 1) as i from documents), neg as (select *, coalesce(max(case when t in ({1}) then 1 else 0 end) over (partition by doc_id order by i rows between 3 preceding and 1 preceding), 0) as negated from tok), hit as (select doc_id, {2}, count(*) filter (where t in ({3}) and negated = 1) as x from neg group by doc_id) select d.doc_id, case when text is null then null else len({0}) end as total_tokens_full, {4}, case when text is null then null else coalesce(x, 0) end as negation_excluded_full from documents d left join hit h on d.doc_id = h.doc_id".format(
        _TOKENS.format("text"),
        _quoted(X.NEGATORS),
        ", ".join(f"count(*) filter (where t in ({_quoted(t)}) and negated = 0) as {c}" for c, t in _LISTS.items()),
        _U,
        ", ".join(f"case when text is null then null else coalesce({c}, 0) end as {c}_count_full" for c in _LISTS),
    ),
    "j4_terms": "with lex as ("
    + " union all ".join(f"select '{c}' as category, unnest([{_quoted(t)}]) as term" for c, t in _LISTS.items())
    + f"), tok as (select unnest({_TOKENS.format('text')}) as term from documents) select category, term, count(*) as n from tok join lex using (term) group by all",
    "t5_section_start": f"with {_SECTIONS} select corpus_id, start from starts",
    "t6_section": f"with {_SECTIONS} select corpus_id, length(substring(transcript, start + 1)) as part_length, md5(substring(transcript, start + 1)) as part_md5 from starts",
    "t8_plain_section": f"with s as (select corpus_id, case {_MARKS} else transcript end as part from corpus) select corpus_id, length(part) as part_length, md5(part) as part_md5 from s",
    "t9_plain_density": f"select doc_id, round(len(list_filter({_WORDS9}, lambda w: w in ({_quoted(X.PLAIN_WORDS)})))::double / nullif(len({_WORDS9}), 0)::double * 100, 2) as density from documents",
    "t10_figures": "select doc_id, case "
    + " ".join(f"when regexp_matches(left(text, 5000), '(?i){p}') then try_cast(regexp_extract(left(text, 5000), '(?i){p}', 1) as double)" for p in X.FIGURE_PATTERNS)
    + " end as figure from documents",
    "pr17_usable": f"with {_SECTIONS}, parts as (select corpus_id, case when start is not null then substring(transcript, start + 1) end as part from starts), {_score_sql('corpus_id', 'parts', 'part', _U)} select p.corpus_id, case when len({_TOKENS.format('part')}) >= 500 then round(coalesce(c, 0)::double / len({_TOKENS.format('part')})::double * 100, 9) end as density from parts p left join hit h on p.corpus_id = h.corpus_id",
}

