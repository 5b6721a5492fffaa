"""From raw documents to packed training sequences: quality rules, toxicity, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns the documents that stay, with
the columns of documents; the last one returns the pieces of the packed sequences. run() writes each stage's result as Parquet
in the shared folder and reads it as the next one's input.

A document is told by its doc_id and text; a null doc_id is a document like any other, and one doc_id may stand for several
texts. Rows that repeat both share their fate, until near duplicates leaves one row of them, empty texts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import common, decontam, jaccard, packing, quality, toxicity

#: Toxicity can't be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


#: The rows of a document: its doc_id, null as 0, and the hash of its text, which also tells a null doc_id from 0.
_KEY = ["_ink_id", "_ink_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_ink_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), "_ink_hash": common.row_hash(docs["doc_id"], docs["text"])})


def _keys(rows: DataFrame, name: str) -> DataFrame:
    """The keys of rows (doc_id, row_hash), written: so Spark knows their size and sends them to the texts only where that is small."""
    return common.materialize(rows.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("_ink_id"), F.col("row_hash").alias("_ink_hash")).distinct(), name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, "_ink_score")
    return scored.filter(~toxicity.rejected(model, F.col("_ink_score"), F.col("lang"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; of rows with its smallest doc_id the one of the smallest hash, and one of exact repeats."""
    begun = common.written()
    judged = common.materialize(jaccard.keep(docs), "pipeline-judged")
    common.release(begun, keep=1)
    common.drop_shuffles(spark)
    copies = _keys(judged.filter(~F.col("kept")), "pipeline-copies")
    repeated = _keys(judged.filter("kept").groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pipeline-repeated")
    single = _keyed(docs).join(copies, _KEY, "left_anti")
    if not repeated.isEmpty():
        order = Window.partitionBy(*_KEY).orderBy(F.xxhash64(*(docs[c] for c in docs.columns if c not in ("doc_id", "text"))))
        one = single.join(repeated, _KEY, "left_semi").withColumn("_ink_copy", F.row_number().over(order)).filter("_ink_copy = 1").drop("_ink_copy")
        single = single.join(repeated, _KEY, "left_anti").unionByName(one)
    return single.drop(*_KEY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark")).filter("contaminated")
    return _keyed(docs).join(_keys(hit, "pipeline-contaminated"), _KEY, "left_anti").drop(*_KEY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = common.read(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(begun, keep=1)
    return docs
