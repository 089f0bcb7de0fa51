"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir) to a DataFrame. run() writes a stage's rows as
Parquet into the shared folder and gives the next stage what it reads back, so a lost executor
costs the stage in hand at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup, mixing, packing, simhash, toxicity
from lumenframe.llm.common import materialize, table, unused

#: Nine tenths of the tokens stay; no document is repeated.
MIX = {"share": (9, 10), "max_epochs": 1}


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5. Null and empty texts have the score of a text without any term; repeated rows stay or go together; an empty table gives none."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "__score")
    return toxicity.score(docs, scorer, out=score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), the row with the largest doc_id; of repeated rows one. An empty table gives none."""
    return exact_dedup.deduplicate(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on five-word shingles, the row with the smallest doc_id (of a repeated id: the text of the smallest key).

    Rows are told apart by id and text, so an id with several texts loses only the copies among
    them. Rows without an id go like any other, after those with one. The keys that go are a
    written table, so Spark broadcasts it only while it is small.
    """
    groups = simhash.similar_documents(docs, words=5, similarity=0.8)
    going = materialize(groups.where(~F.col("kept")).select(F.col("doc_id").alias("id"), "key"), "near-copies")
    key = unused(docs, "__key")
    keyed = docs.withColumn(key, simhash.text_key())
    left = keyed.join(going, keyed["doc_id"].eqNullSafe(going["id"]) & (keyed[key] == going["key"]), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once; null languages and sources are leaves of their own. An empty table gives none."""
    return mixing.mixed_rows(docs, **MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens; null and empty texts are their end token. An empty table gives none."""
    return packing.pack(docs)


STAGES = [("toxicity", not_toxic), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("packing", packed)]

#: The label model, the fingerprints and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
