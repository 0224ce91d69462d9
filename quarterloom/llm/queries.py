"""Queries of the llm operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.llm import garble, languages, leaks, survivors, tokenizer, truncation, turns
from quarterloom.sources import table

_TEXTS = (("corpus", "corpus_id"), ("recent_corpus", "recent_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("rec_table"), *(F.col(c) for c in df.columns))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_turns(spark, folder).select("recent_id", "turn_no", "speaker")


def p2_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with its cleaned speech."""
    return turns.speaker_turns(table(spark, folder, "recent_corpus"), table(spark, folder, "call_speakers"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.call_survivors(table(spark, folder, "corpus"), table(spark, folder, "call_feeds"))


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of every group, with its gaps filled field by field and its transcript."""
    corpus = table(spark, folder, "corpus")
    attributes = [c for c in corpus.columns if c not in (*survivors.CALL, "corpus_id", "feed", "loaded_at")]
    return survivors.with_transcripts(survivors.merged_records(corpus, table(spark, folder, "call_feeds"), attributes), corpus)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    recent = truncation.cut_records(table(spark, folder, "recent_corpus"), "recent_id", "transcript", "feed")
    cut = truncation.cut_records(table(spark, folder, "corpus"), "corpus_id", "transcript", "feed", recount=True)
    corpus, counted = truncation.with_counts(cut, table(spark, folder, "tech_uncertainty_features"), "feature_id", "corpus_id", "total_tokens_qa")
    return _union([_named("corpus", corpus), _named("recent_corpus", recent), _named("tech_uncertainty_features", counted)])


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden storage limits of each feed, by encoding."""
    return _union([_named(name, truncation.storage_limits(truncation.length_piles(table(spark, folder, name), "transcript", "feed"))) for name, _ in _TEXTS])


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How often each feed cuts."""
    out = []
    for name, key in _TEXTS:
        df = table(spark, folder, name)
        out.append(_named(name, truncation.cut_shares(df, key, "transcript", "feed", truncation.cut_records(df, key, "transcript", "feed"))))
    return _union(out)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _union([_named(name, garble.garbled_ids(table(spark, folder, name), key, "transcript")) for name, key in _TEXTS])


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected records with their text as far as it can be had."""
    return _union([_named(name, garble.garbled_records(table(spark, folder, name), key, "transcript")) for name, key in _TEXTS])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encoded(table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found with the items in several blocks, the way of item sets of any size."""
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"), block=50_000).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that leaked, into how many documents, and the largest part found."""
    found = leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    named = table(spark, folder, "eval_items").select("item_id", "task", "split")
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("max_share")).join(named, "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.label_errors(table(spark, folder, "documents"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's segments with language and confidence."""
    return languages.language_segments(table(spark, folder, "documents"))


QUERIES = {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}
ORACLE: dict[str, str] = {}
