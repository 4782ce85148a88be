"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import hyperdim_lang, raking
from strandlog.llm.common import free_name, shared_folder
from strandlog.llm.dart_minhash import near_classes
from strandlog.llm.suffix_dedup import cut_repeats
from strandlog.llm.unigram_pieces import encode_documents

#: A document goes if its language cannot be told, or if no language is as near as this. Texts that share no n-gram with a
#: prototype have cosines of standard deviation 1 / sqrt(DIMENSIONS) about 0; 4.5 of them are passed by chance in one of
#: 300,000 cases a language.
LEAST_NEAR = 4.5 / hyperdim_lang.DIMENSIONS**0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified, and puts it into lang; prototypes are learned from the same documents.

    Null texts and texts without a letter go. Rows that repeat or have no id are judged each."""
    use = ~F.coalesce(hyperdim_lang.held_out(docs["doc_id"]), F.lit(True))
    prototypes = hyperdim_lang.learn(docs, docs["text"], docs["lang"], use)
    columns = docs.columns
    body, name, near = (free_name(columns, c) for c in ("body", "told", "near"))
    told = hyperdim_lang.identify(docs.withColumn(body, docs["text"]), prototypes, body, keep=columns, out=(name, near))
    kept = told.where((F.col(name) != hyperdim_lang.UNDETERMINED) & (F.col(near) >= LEAST_NEAR))
    return kept.withColumn("lang", F.col(name).cast(docs.schema["lang"].dataType)).select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document with the least id; of rows with that id, one for each text.

    Rows without an id have no class and stay. A null text counts as empty."""
    own, first = free_name(docs.columns, "text_hash"), free_name(docs.columns, "first")
    kept_ids = near_classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias(first)).distinct()
    kept = docs.join(kept_ids, docs["doc_id"] == kept_ids[first], "left_semi")
    kept = kept.withColumn(own, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).dropDuplicates(["doc_id", own]).drop(own)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 200-byte string that occurs twice out of the texts. A document whose text had words and has none left goes.

    Null and empty texts stay as they are; so do rows that repeat, though equal texts of 200 bytes and more are cut whole."""
    old = free_name(docs.columns, "had_words")
    with_words = lambda c: F.coalesce(c.rlike(r"\S"), F.lit(False))
    cut = cut_repeats(docs.withColumn(old, with_words(docs["text"])))
    return cut.where(~F.col(old) | with_words(F.col("text"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that tokens meet the targets by source, language and topic.

    Documents without tokens lie in cells like others; a cell without tokens is not drawn. Nulls of a dimension are one value.
    Rows that share an id share their draw."""
    return raking.mixed_documents(docs, temperature=0.95)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids of every document. A null text has null ids and no tokens, an empty one no ids."""
    made = encode_documents(docs, keep=["doc_id", "source", "lang"])
    return made.select("doc_id", "source", "lang", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("encoding", encoding)]

#: Hypervectors, darts, ranks and Viterbi paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Between them, rows are written to the folder that all executors share; a stage's
    table is deleted when the next one is written, the last when the session's folder goes."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if k:
                delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
