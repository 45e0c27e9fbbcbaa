"""The corpus pipeline: five operators in turn over the documents, each stage working on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs`` as
they came, whatever further columns there are. Null or empty texts pass each stage by its operator's rules: the
classifier judges them like any text, language identification rejects them (they hold no letter), so later stages do
not see them. Documents without a key are kept by the group stage; rows repeated under one key are copies of one
document there, and one stays. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.bpe import load_ranks, round_trip
from geoloom.llm.bpe_query import VOCABULARY
from geoloom.llm.decontaminate import add_leaks
from geoloom.llm.jaccard import BROADCAST_KEYS, similar_groups
from geoloom.llm.langid import learn as learn_languages, predict
from geoloom.llm.quality import grade_texts, learn as learn_quality
from geoloom.llm.quality_query import GOOD, SURE, rating
from geoloom.llm.tables import stored, table

#: Least posterior probability of the predicted language.
LANGUAGE_SURE = 0.5


def _as_given(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are, more likely than not, sound and free of toxic language; the classifier learns from the
    rated ones among them."""
    model = learn_quality(docs, table(spark, sf_dir, "labels"), rating())
    graded = grade_texts(docs, model, GOOD, expected="_expected_grade", tail="_tail")
    return _as_given(graded.where(F.col("_tail") >= SURE), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names; those without a letter, or in no clear language, go."""
    found = predict(docs, *learn_languages(docs), out="_language", score="_sure")
    return _as_given(found.where((F.col("_language") != "und") & (F.col("_sure") >= LANGUAGE_SURE)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest key."""
    groups = stored(similar_groups(docs).select("doc_id", "component_id"), "groups")

    def by_key(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys

    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(by_key(gone), "doc_id", "left_anti")
    repeated = stored(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(
        "doc_id"), "repeated")
    if not repeated.isEmpty():
        once = kept.join(by_key(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(by_key(repeated), "doc_id", "left_anti").unionByName(once)
    return _as_given(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Items of one word decide nothing: any text may hold one by chance, and a
    single common word would take most of the corpus; ``op7_leaks`` with ``least_words=1`` reports them."""
    found = add_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks", least_words=2)
    return _as_given(found.where(F.size("_leaks") == 0), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it again."""
    ranks = load_ranks(public_tokenizers.path(VOCABULARY))
    given = docs.select("doc_id", "lang", "source", "text")
    both = round_trip(given, ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies),
          ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers, edit distances and merges have no SQL form; the tests compare every stage with brute force.
ORACLE_SQL = None
