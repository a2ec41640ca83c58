"""One query per operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import chat, flac, langid, minhash, mixing, packing, pii, secrets, spherical, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(embeddings: DataFrame) -> DataFrame:
    """A FLAC clip of each vector, since the test tables have no audio: its numbers twice over, at two volumes, 16 bits, blocks of 64 samples.
    Predictors and stereo modes change from clip to clip. Null vectors and ids have no clip; an empty vector, or one with a null or a part that is no number, has a clip without samples."""

    def make(batches):
        for b in batches:
            ids, out = b["vec_id"].values.astype(np.int64), [b""] * len(b)
            vectors = [np.asarray(e, np.float64) for e in b["embedding"]]
            vectors = [v if np.isfinite(v).all() else v[:0] for v in vectors]
            sizes = np.array([len(v) for v in vectors])
            for size, way in sorted(set(zip(sizes.tolist(), (ids % 16).tolist()))):
                rows = np.flatnonzero((sizes == size) & (ids % 16 == way))
                v = np.tile(np.stack([vectors[k] for k in rows]), (1, 2))
                x = np.clip(np.floor(np.stack([v * 8192, v * 4096], 2)), -32768, 32767).astype(np.int64)
                kind, order = (("fixed", 1), ("fixed", 2), ("lpc", 4), ("verbatim", 0))[way % 4]
                for k, data in zip(rows, flac.encode_clips(x, block=64, kind=kind, order=order, stereo=(0, 8, 9, 10)[way // 4])):
                    out[k] = data
            yield pd.DataFrame({"media_id": ids, "flac": out})

    return embeddings.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").mapInPandas(make, "media_id long, flac binary")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = flac.decode_media(clips(_table(spark, sf_dir, "embeddings")))
    return blocks.select(F.col("media_id").alias("vec_id"), "block", "first_sample", "n_samples", "channels", "bits", "rate", "crc_ok", F.hex("pcm").alias("pcm_hex"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_flac, op2_toxicity, op3_chat, op4_langid, op5_spherical, op6_minhash, op7_pii, op8_packing, op9_mixing, op10_secrets, pipeline)
}

_OP1 = """
WITH s AS (SELECT vec_id, embedding, unnest(range(2 * len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, i, CAST(floor(CAST(embedding[i % len(embedding) + 1] AS DOUBLE) * 8192) AS BIGINT) AS l, CAST(floor(CAST(embedding[i % len(embedding) + 1] AS DOUBLE) * 4096) AS BIGINT) AS r FROM s)
SELECT vec_id, CAST(i // 64 AS INTEGER) AS block, CAST(i // 64 * 64 AS BIGINT) AS first_sample, CAST(count(*) AS INTEGER) AS n_samples, 2 AS channels, 16 AS bits, 16000 AS rate, true AS crc_ok,
       string_agg(printf('%02X%02X%02X%02X', l & 255, (l >> 8) & 255, r & 255, (r >> 8) & 255), '' ORDER BY i) AS pcm_hex
FROM v GROUP BY vec_id, i // 64
"""

ORACLES: dict[str, str] = {"op1_flac": _OP1, "op3_chat": chat.ORACLE, "op5_spherical": spherical.ORACLE, "op6_minhash": minhash.ORACLE}
