"""The corpus pipeline: quality rules, exact dedup, near dedup, secrets, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the
packed pieces.  ``ORACLE_SQL`` is None: the fitted label model and forest, XXH64 fingerprints and BPE are
beyond SQL, so the stages are tested against brute force.

Rows without an id pass the near-dedup stage, rows that repeat an id stay or go together there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import free_name
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.packing import pack, token_pieces
from folioscope.llm.quality_rules import quality_rules
from folioscope.llm.secret_scan import redact
from folioscope.llm.simhash import simhash_dedup
from folioscope.storage import materialise

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    out = free_name(docs.columns, "quality")
    return quality_rules(docs, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the largest id."""
    out = free_name(docs.columns, "exact")
    return exact_dedup(docs, keep="largest", carry=True, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays, that with the smallest id."""
    linked = simhash_dedup(docs)
    gone = linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; ``n_chars`` follows."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences."""
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER), limit=SEQUENCE_TOKENS), limit=SEQUENCE_TOKENS)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("secret_scan", secrets), ("best_fit_packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
