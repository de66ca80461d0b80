"""A training corpus from the documents table: quality, near duplicates, secrets, mixing, token ids."""

from __future__ import annotations

from decimal import Decimal

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import checkpoint, columns, documents, row_hash
from trackweave.llm.mixing import pareto_mix
from trackweave.llm.ngrams import ngram_components
from trackweave.llm.pieces import encode_pieces
from trackweave.llm.quality import quality
from trackweave.llm.secrets import redact_secrets, train_forest
from trackweave.operators.checkpoints import new_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as `quality` rates them.

    Null and empty texts are rated like others; repeated rows are kept or rejected alike; an empty table stays empty; extra columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", "text", "source", "lang")
    return quality(rows, labels).where("keep").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group that n-gram Jaccard links connect.

    Where ids are null or repeat, rows go by a key of id and hashes of the whole row instead: rows that share
    an id are told apart, those without one come after all others, and equal rows, which share the key, are
    one document. Texts without words are linked with nothing and all stay. An empty table stays empty; extra columns stay, whatever their names.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        others = ngram_components(docs).where("component_id <> doc_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*columns(docs))
    part = lambda seed: F.pmod(row_hash(docs, seed), F.lit(10**18)).cast("decimal(20,0)")
    high = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), part(1) + F.lit(Decimal(10**19)))
    # The row's own columns stay apart in a struct, so that no name clashes.
    keyed = docs.select(F.struct(*columns(docs)).alias("row"), "text", (high * F.lit(Decimal(10**18)) + part(0)).cast("decimal(38,0)").alias("key"))
    found = checkpoint(ngram_components(keyed, key="key"))
    worded = found.where("n_shingles > 0")
    others = worded.where("component_id <> key").select("key").distinct()
    repeated = worded.where("component_id = key").groupBy("key").count().where("count > 1").select("key")
    kept = keyed.join(others.union(repeated), "key", "left_anti").unionByName(keyed.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark, and n_chars (null for a null text) to match.

    Null and empty texts stay as they are; repeated rows stay repeated; an empty table stays empty; extra columns stay.
    """
    masked = redact_secrets(docs, train_forest())
    return masked.select(*[F.length("text").cast("long").alias(name) if name == "n_chars" else c for name, c in zip(docs.columns, columns(docs), strict=True)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, copies as rows of their own.

    Null and empty texts have no words and are never taken; a null source is one of its own; repeated rows and null ids are
    rows like others; an empty table stays empty; extra columns stay, whatever their names.
    """
    taken = pareto_mix(docs, rows=True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with begin and end, as little-endian unsigned 32-bit integers: doc_id, source, n_tokens, ids, round_trip.

    Null texts are encoded like empty ones, with a null round_trip; repeated rows stay repeated; an empty table stays empty; other columns are dropped.
    """
    rows = encode_pieces(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: what follows reads columns from there, and no stage is computed twice or again when executors are lost."""
    folder = new_folder(spark, "stage")
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
