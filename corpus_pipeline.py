"""From raw documents to packed training sequences: language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all documents its predecessor kept; all but the last return the columns of documents.

Defined results: documents without a letter (null or empty texts too), or of an ambiguous language, go in the first stage; of each
near-duplicate group the document of least doc_id stays (nulls last), whether or not ids are unique; texts with personal data are
rewritten and their n_chars counted anew; an empty table passes through all stages; extra columns are carried along whatever
their names, and dropped by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import tokenizer_path
from tessera.llm.common import materialize, table
from tessera.llm.language import identify, learn
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.pii import QUERY_KEY, replace_entities, surrogate_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents, and keeps those whose text is clearly of one of their languages."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"])
    said = identify(whole, learn(docs.select("text", "lang")), ["row"])
    return said.filter("lang_pred <> 'und' AND NOT ambiguous").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are numbered in a written table, so that each has a decision of its own, whatever its doc_id; of a group the least doc_id stays, nulls last, then the first number."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = materialize(docs.select(whole.alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    said = near_duplicates(rows.select(F.col("at").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("at"), F.col("component_id").alias("group"))
    said = said.join(rows.select("at", "row.doc_id"), "at")
    kept = said.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("least")).select("least.at")
    return rows.join(kept, "at", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the session's key; one who publishes a corpus sets it, as QUERY_KEY is known to all."""
    made = replace_entities(docs, surrogate_key(spark, QUERY_KEY))
    n_chars = F.when(F.col("n_entities") > 0, F.length("row.text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    return made.select(*[n_chars.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("personal_data", personal_data), ("packing", packing)]

#: No stage of language classifiers or of a genetic algorithm can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
