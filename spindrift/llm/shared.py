"""Session helpers of the corpus operators: lineage cuts and bounded lists of hot keys."""

from __future__ import annotations

import ctypes
import re
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir; one of our own only in local mode, where none need be named (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder; later readers survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Texts can be long: Spark ends an Arrow batch at spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), so no
# setting of the caller's session is changed here.


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def hand_back() -> None:
    """Gives the system the memory that the allocators of this process hold and do not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)``; a task that ends hands back its memory.

    Workers wait beside the executor's heap for further tasks, each with what its largest task took, unless it is handed back.
    """
    def lean(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return rows.mapInArrow(lean, schema)


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each of the labels 0 and 1, those with the lowest hash of the key; one row per key (the lower label)."""
    rows = rows.groupBy(key).agg(F.min(label).alias(label))
    parts = [
        rows.where(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(per_class)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def hot_keys(counted: DataFrame, key: str, count: str, share: float = 0.001) -> list:
    """Keys that hold more than ``share`` of all rows; there can be no more than 1/share of them."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    least = max(10_000, int(total * share))
    return [r[0] for r in counted.where(F.col(count) > least).select(key).collect()]


def salted(rows: DataFrame, groups: DataFrame, key: str, hot: list, parts: int = 32, how: str = "inner") -> DataFrame:
    """rows joined with the one row of ``groups`` of their key; rows of the few hot keys meet ``parts`` copies of it."""
    if not hot:
        return rows.join(groups, key, how)
    is_hot = F.col(key).isin([F.lit(bytes(x)) if isinstance(x, bytearray) else x for x in hot])
    zero = F.lit(0).cast("long")
    left = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(parts).cast("long"))).otherwise(zero))
    right = groups.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(zero, F.lit(parts - 1).cast("long"))).otherwise(F.array(zero))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


#: Bits of a sieve: 2 MB.
SIEVE = 24


class Sieve:
    """Which of the keys (longs) may be among given ones: a bit per remainder.  It has one size whatever it holds, so it
    only spares work; what passes must still be joined."""

    def __init__(self, keys: DataFrame):
        at = F.col(keys.columns[0]).bitwiseAND((1 << SIEVE) - 1)
        words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(1 << (SIEVE - 6), np.int64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64((1 << SIEVE) - 1)
        return (self.sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def column(self, key: str):
        @F.pandas_udf("boolean")
        def passes(keys: pd.Series) -> pd.Series:
            return pd.Series(self.passes(keys.to_numpy(np.int64)))

        return passes(key)


def shield(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list]:
    """``docs`` with all columns but ``own`` under names no operator uses, and the columns that undo this."""
    names = {c: c if c in own else f"__x{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]
