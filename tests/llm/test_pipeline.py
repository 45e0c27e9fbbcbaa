"""Every stage of the pipeline against brute force on the stage's own input, and its defined cases."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import decontaminate
from geoloom.llm.bpe import load_ranks
from geoloom.llm.bpe_query import VOCABULARY
from geoloom.llm.decontaminate import closest
from geoloom.llm.words import word_hashes
from tests.llm.test_jaccard import plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = docs, out
        docs = out
    return seen


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_subsets(kept):
    for name, (given, out) in list(kept.items())[:-1]:
        assert out.columns == given.columns
        assert set(ids(out)) <= set(ids(given))
    assert out.count() > 100


def test_clean_documents_stay_and_poor_ones_go(spark, kept):
    given, out = kept["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stays = set(ids(out))
    good = ids(labels.where("quality = 1 AND toxic = 0").join(given, "doc_id"))
    poor = ids(labels.where("quality = 0").join(given, "doc_id"))
    assert sum(i in stays for i in good) / len(good) > 0.97
    assert sum(i in stays for i in poor) / len(poor) < 0.1
    given, out = kept["language"]
    assert ids(out) == ids(given.where("text RLIKE '\\\\p{L}'"))


def test_one_document_of_each_group(kept):
    given, out = kept["near_copies"]
    groups = plain_groups([tuple(r) for r in given.select("doc_id", "text").collect()])
    assert ids(out) == sorted(key for key, _, group in groups if key == group)


def test_leaks_go(spark, kept):
    given, out = kept["decontamination"]
    items = word_hashes(spark.read.parquet(f"{SF}/benchmark.parquet").toArrow()["text"])
    items = [items[0][a:b].tolist() for a, b in zip(items[1][:-1], items[1][1:])]
    table = given.select("doc_id", "text").toArrow()
    words, first = word_hashes(table["text"])
    clean = []
    for i, doc_id in enumerate(table["doc_id"].to_pylist()):
        mine = words[first[i]: first[i + 1]].tolist()
        if not any(closest(x, mine)[0] <= int(decontaminate.EDITS * len(x)) for x in items if len(x) >= decontaminate.MIN_WORDS):
            clean.append(doc_id)
    assert ids(out) == sorted(clean) and len(clean) < given.count()


def test_tokens(kept):
    given, out = kept["tokens"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=load_ranks(public_tokenizers.path(VOCABULARY)))
    want = {r.doc_id: own.encode_ordinary(r.text) for r in given.collect()}
    rows = out.collect()
    assert {r.doc_id: r.ids for r in rows} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_is_the_stages_in_turn(spark, kept):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept["tokens"][1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_defined_cases(spark):
    clean = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").orderBy("doc_id").limit(2).collect()]
    rows = [(1, clean[0], "en", None, 1, "x"), (2, clean[0], "en", None, 1, "x"), (2, clean[0], "en", None, 1, "x"),
            (3, None, None, None, None, "x"), (4, "", "en", None, 0, "x"), (None, clean[1], None, "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    out = corpus_pipeline.near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4]
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.language(spark, docs, SF).collect()) == [0, 1, 2, 2]
    assert corpus_pipeline.decontamination(spark, docs, SF).count() <= 6
    assert corpus_pipeline.tokens(spark, docs, SF).where(~F.col("round_trip")).count() == 0
