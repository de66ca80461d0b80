"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import documents
from .fingerprint import edited_fingerprints
from .media import copies_report, edited, rendered
from .mixing import pareto_mix
from .ngrams import ngram_components
from .pieces import digest
from .pii import pseudonymise
from .quality import quality
from .resampling import importance_resample
from .secrets import find_secrets, train_forest
from .sharding import balanced_shards
from .tokens import token_counts
from .toxicity import toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=b"query key")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.select("doc_id", "p_doc", "p_host", "p_path", "p_quality", "keep")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images rendered from all vectors, searched for edited copies of every 50th."""
    images = rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    queries = edited(images.where("id % 50 = 0"))
    return copies_report(images, queries).withColumnRenamed("id", "vec_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir), train_forest())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_quality, op4_token_counts, op5_media, op6_fingerprints, op7_pieces, op8_sharding, op9_mixing, op10_secrets, op11_collocations, op12_toxicity, op13_resampling, pipeline)}

#: Steps of a WITH RECURSIVE: `crc` has the usual table of 256 remainders, from which SQL works a checksum out byte by byte.
CRC_TABLE = """step(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
  crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8)"""
#: The checksum of the bytes whose hexadecimal forms the list h holds, with the table in t.
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a // 256, t[(xor(a % 256, x) + 1)::INT])), 4294967295)::BIGINT"

#: DuckDB SQL of the operators that it can express; the others need hashes, tokenizers or models that it lacks.
ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  walk AS (SELECT doc_id AS id, doc_id AS at FROM documents UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.at)
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(w.at) AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN walk w ON w.id = d.doc_id GROUP BY ALL""",
    "op8_sharding": f"""WITH RECURSIVE {CRC_TABLE},
  sized AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
  summed AS (SELECT doc_id, size, {CRC_OF} AS text_crc32 FROM sized, crc),
  placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size / 2.0::DOUBLE AS middle, sum(size) OVER () AS total FROM summed),
  dealt AS (SELECT *, least(floor(middle * 8 / total), 7)::INT AS shard FROM placed)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id)::BIGINT - 1 AS slot, NULL::INT AS grown_shard FROM dealt""",
    "op11_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS p FROM documents),
  worded AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM pieces),
  grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, unnest(range(1, 6)) x(k))),
  f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
  total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  cuts AS (SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1 :], ' ') JOIN total ON total.lang = c.lang),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  within AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, unnest(range(2, 5)) x(m) WHERE m < k) GROUP BY ALL),
  placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM best LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR longer < a)
  SELECT * FROM placed WHERE rank <= 2000""",
    "op13_resampling": rf"""WITH RECURSIVE {CRC_TABLE},
  texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark),
  words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
  met AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM words) GROUP BY ALL),
  hashed AS (SELECT w, {CRC_OF} % 10000 AS b FROM (SELECT w, regexp_extract_all(hex(encode(w)), '..') AS h FROM (SELECT DISTINCT w FROM met)), crc),
  bucketed AS (SELECT doc_id, b, sum(c)::BIGINT AS c FROM met JOIN hashed USING (w) GROUP BY ALL),
  counts AS (SELECT b, coalesce(sum(c) FILTER (doc_id IS NOT NULL), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (doc_id IS NULL), 0)::DOUBLE AS t FROM bucketed GROUP BY b),
  gains AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
  weighed AS (SELECT doc_id, sum(c * gain)::BIGINT AS weight FROM bucketed JOIN gains USING (b) WHERE doc_id IS NOT NULL GROUP BY doc_id),
  scored AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words d LEFT JOIN weighed USING (doc_id) WHERE d.doc_id IS NOT NULL),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
  SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)""",
}
