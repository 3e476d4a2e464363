"""A corpus pipeline of five stages over documents.

Language identification rejects texts without a language, the n-gram Jaccard join keeps one document of each group of near
copies, the secret scan blanks out what it finds, mixing puts the rows in the order of the Pfair schedule (the files of its
result hold the slots one after another), and SentencePiece turns them into token ids.

Decisions are made for rows, not for ids. Defined results: a null text counts as empty, so language rejects it; a row with a null
id is kept or rejected by its own text, is in no group of near copies, and gets a place and ids like others; of rows that
repeat an id with different texts each has its own fate; rows that repeat id and text are one document, of which near_copies keeps one
row (if the id is not null); empty tables stay empty; columns of the input are kept whatever their names. Ties between near copies go to
the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language_id, mixing, secrets
from logloom.llm.ngram_join import Jaccard, jaccard_components, text_hash
from logloom.llm.queries import piece_model
from logloom.llm.sentencepiece_codec import encode_documents
from logloom.llm.shared import Scratch, cleared, free_name, wanted

#: A text is rejected whose language is unknown, or whose score is under this.
LEAST_LANGUAGE_SCORE = 0.25


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language."""
    found, lang, score = language_id.with_language(docs, language_id.fit_documents(docs))
    return found.where((F.col(lang) != language_id.UND) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id names the group."""
    scratch = Scratch(spark, "copies")
    groups = jaccard_components(docs, Jaccard(width=5, num=80, den=100))
    rows = scratch.keep(groups.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "rows")
    dropped = scratch.keep(rows.where("doc_id <> component_id").select("doc_id", "text_hash"), "dropped")
    hashed = free_name("text_hash", docs.columns)
    key = ["doc_id", hashed]
    left = wanted(docs.withColumn(hashed, text_hash(F.col("text"))), dropped.withColumnRenamed("text_hash", hashed), key, "left_anti")
    again = scratch.keep(rows.where("doc_id = component_id AND rows > 1").select("doc_id", "text_hash"), "again")
    if not (number := again.count()):
        return left.select(*docs.columns)
    again = again.withColumnRenamed("text_hash", hashed)
    once = wanted(left, again, key, "left_semi", number).dropDuplicates(key)
    return wanted(left, again, key, "left_anti", number).unionByName(once).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts blanked out."""
    scratch = Scratch(spark, "ledger")
    ledger = secrets.Ledger(spark, scratch.path("ledger"))
    ledger.update(docs)
    hits = scratch.keep(ledger.rows(secrets.RULES).where(F.size("spans") > 0).select("blob", "spans"), "hits")
    blob, spans, held = (free_name(c, docs.columns) for c in ("blob", "spans", "had_spans"))
    number = hits.agg(F.sum(F.size("spans") + 2)).first()[0] or 0
    joined = wanted(docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)), hits.toDF(blob, spans), [blob], "left", number)
    joined = joined.withColumn(held, F.col(spans).isNotNull()).withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans))))
    n_chars = F.when(F.col(held), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumn("n_chars", n_chars).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule."""
    return mixing.in_order(mixing.mix(docs), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    coded = encode_documents(docs, piece_model())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Language identification and tokenisation have no SQL form; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again, and what came before it is deleted."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with cleared():
            docs = scratch.keep(stage(spark, docs, sf_dir), name, as_it_is=True)
        if before:
            scratch.drop(before)
        before = name
    return docs
