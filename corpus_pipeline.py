"""A corpus pipeline of the subpackage's operators, each stage over all that its predecessor kept.

Stages take and return the columns of ``documents``; the last returns the
encoded rows.  Every row is judged on its own, whether its doc_id is null,
repeated or unique.  Defined results: rows without words fail the quality
rules; a text that line dedup empties goes with its row, as all of it stands
elsewhere; of a group of near duplicates the row with the smallest doc_id stays
(rows without an id last, equal ids by a hash of their texts); extra columns
stay, whatever their names; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import byte_bpe, decontamination, line_dedup, ngram_jaccard, quality_rules
from strandweave.llm.queries import ranks_path
from strandweave.llm.shared import checkpoint, keyed, shared_folder, small
from strandweave.packaging import ship

#: No words but blanks and line ends.
BLANK = r"^[\x20\x09-\x0D]*$"


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the corpus policy keeps."""
    return quality_rules.filter_documents(docs)


def by_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; n_chars follows the text."""
    done = line_dedup.dedup(docs)
    n_gone = F.col(done.columns[-1])
    kept = done.where(~((n_gone > 0) & F.col("text").rlike(BLANK)))
    return kept.withColumn("n_chars", F.when(n_gone > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The keyed rows whose key is not in ``gone`` (doc)."""
    left = rows.alias("r").join(small(gone).alias("g"), F.expr("r.doc <=> g.doc"), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def by_ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays."""
    rows = keyed(docs)
    plain = rows.schema["doc"].dataType == docs.schema["doc_id"].dataType
    # rows with an id stay before rows without one
    key = F.col("doc") if plain else F.struct(F.col("doc.id").isNull().alias("last"), "doc")
    found = ngram_jaccard.components(rows.select(key.alias("doc"), "text"), n=5, p=4, q=5, id_col="doc")
    gone = found.where("NOT doc <=> component_id").select("doc" if plain else "doc.doc")
    return _without(rows, checkpoint(gone), docs.columns)


def by_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are contaminated by benchmark passages go."""
    rows = keyed(docs)
    found = decontamination.search(rows.select("doc", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="doc")
    return _without(rows, checkpoint(found.where(decontamination.contaminated()).select("doc")), docs.columns)


def by_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return byte_bpe.round_trip(docs, ranks_path())


STAGES = [
    ("quality rules", by_quality_rules),
    ("line dedup", by_line_dedup),
    ("n-gram Jaccard join", by_ngram_jaccard),
    ("benchmark decontamination", by_decontamination),
    ("byte-level BPE encoding and decoding", by_byte_bpe),
]
#: Byte-pair merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
