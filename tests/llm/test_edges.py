"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from strandlog.llm import raking
from strandlog.llm.compression_bands import compression_bands
from strandlog.llm.dart_minhash import near_classes
from strandlog.llm.hyperdim_lang import language_id
from strandlog.llm.imatch import imatch
from strandlog.llm.license_scan import license_scan
from strandlog.llm.quote_links import conversations_without_quotes, quote_links
from strandlog.llm.suffix_dedup import cut_repeats, repeats_digest
from strandlog.llm.toxic_lexicon import toxicity
from strandlog.llm.unigram_pieces import decode_documents, encode_documents, encoding_digest

LONG = "word another third " * 20_000
ROWS = [(1, None, "en", "a"), (2, "", None, "a"), (3, "one", "de", None), (4, LONG, "en", "b"), (4, LONG, "en", "b"), (None, "no id here", "en", "b"), (7, " \n\t ", None, None), (8, "ünïcode ▁ \u0000 🙂", "fr", "c")]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that the operators use inside.
CLASH = ("id", "key", "score", "text_a", "_part", "bands", "topic", "tokens", "n_bytes", "ids", "label", "weight", "lang_pred", "_sha", "_spans", "_body", "_id", "held", "_text", "_hash", "h", "fold", "prob", "_source", "sampled", "residual", "N_Words")


def labels_of(docs):
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


OPERATORS = {
    "near": near_classes, "imatch": imatch, "toxic": lambda d: toxicity(d, labels_of(d)), "bands": compression_bands, "rake": raking.mix, "lang": language_id,
    "suffix": repeats_digest, "pieces": encoding_digest, "license": license_scan,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    found = OPERATORS[name](docs).collect()
    assert len(found) == len(ROWS)
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []
    assert "doc_id" in found[0].asDict()
    a, b = (r for r in found if r["doc_id"] == 4)
    assert a == b or name == "imatch"  # there the next document of the first copy is the second


def test_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, key string, depth int"
    rows = [(1, 0, "u", None, "x", 1), (1, 0, "u", None, "x", 1), (None, 1, "u", "> a b c", "x", 1), (1, None, "a", "", "x", 1), (2, 1, None, "line one two\n" * 300, "x", 1)]
    assert quote_links(spark.createDataFrame(rows, schema)).count() == 5 == conversations_without_quotes(spark.createDataFrame(rows, schema)).count()
    assert quote_links(spark.createDataFrame([], schema)).count() == 0


def test_stages_with_clashing_names(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"some words of text number {k} and more of it " * 9, "en", "a", 3) for k in range(40)], SCHEMA + ", n_chars bigint")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.where("score <> 'x' OR _sha <> 'x' OR _body <> 'x' OR weight <> 'x'").count() == 0
    assert corpus_pipeline.encoding(spark, docs, str(tmp_path)).count() == 40


def test_stages_with_nulls_repeats_and_nothing(spark, tmp_path):
    import corpus_pipeline

    schema = SCHEMA + ", n_chars bigint"
    rows = [(*r, len(r[1] or "")) for r in ROWS] + [(4, "quite another text under an id that is there twice, with words enough", "en", "b", 9)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame(rows, schema), str(tmp_path)).count() <= len(rows)
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    # of the two equal rows one stays, the other text under their id stays too, and so does the row without an id
    assert sorted(r["text"][:5] for r in kept.where("doc_id = 4").collect()) == ["quite", "word "] and kept.where("doc_id IS NULL").count() == 1


def test_stage_forms(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = cut_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) and kept.where("doc_id = 1").first()["text"] is None
    assert kept.where("doc_id = 4").first()["text"] == ""
    back = decode_documents(encode_documents(docs))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert set(raking.mixed_documents(docs).columns) == set(docs.columns)
