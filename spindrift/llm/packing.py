"""Packing into length buckets that minimise padding.

Lengths are counted in tokens (words by default).  The global histogram of lengths is one grouped count;
a dynamic program over it chooses at most ``n_buckets`` upper boundaries so that padding every document
to its bucket's boundary wastes as few tokens as possible.  The histogram is exact at every length, so the
boundaries are the optimum.  It has one row per distinct length: L distinct lengths need at least L*L/2
tokens, in practice there are a few thousand, and the program is L log L a bucket.

Inside a bucket documents are ordered by a hash of their id and filled into batches of
max(1, token_budget // bucket length) rows.  The position in a bucket is found without sorting a bucket
in one task: rows are counted per (bucket, hash range), the counts are accumulated, and only rows of one
range are ranked together.

Defined results: null and empty texts have length 0 and a bucket like any other; a document longer than
the budget is a batch of its own; ties in length share a bucket; repeated rows are packed each by itself;
an empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

N_BUCKETS = 16
TOKEN_BUDGET = 8192
#: Rows of one hash range, on average; ranges of all buckets are ranked apart.
RANGE_ROWS = 100_000


def lengths(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and long n_tokens: the words of each whole text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("__text"))
            n = [np.zeros(0, np.int64)] + [textkit.Words(b, o, fold=False).counts for _, _, b, o in textkit.blocks(buf, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(n).astype(np.int64))], [*keep, "n_tokens"])

    return shared.in_arrow(docs.select(*keep, F.col("text").alias("__text")), run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long"]))


def boundaries(top: np.ndarray, count: np.ndarray, tokens: np.ndarray, n_buckets: int) -> list[int]:
    """Upper lengths of the buckets with least padding; of equally good choices the fewest buckets.

    top: the lengths, rising; count and tokens: documents and their tokens per length.
    Cost of lengths i..j in one bucket: top[j] * documents - tokens.  That cost has the quadrangle
    property, so optimal cuts rise with j and each layer is found by divide and conquer.
    """
    n = len(top)
    if not n:
        return []
    docs = np.concatenate(([0], np.cumsum(count.astype(np.int64))))
    toks = np.concatenate(([0], np.cumsum(tokens.astype(np.int64))))
    top = top.astype(np.int64)
    cost = lambda i, j: top[j - 1] * (docs[j] - docs[i]) - (toks[j] - toks[i])
    best = np.array([0, *[cost(0, j) for j in range(1, n + 1)]])
    cuts, layers = [np.zeros(n + 1, np.int64)], [best]
    for _ in range(1, min(n_buckets, n)):
        now, cut = best.copy(), cuts[-1] * 0 - 1
        todo = [(1, n, 0, n)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            value = best[i] + cost(i, mid)
            k = int(i[np.argmin(value)])
            now[mid], cut[mid] = value.min(), k
            todo += [(lo, mid - 1, a, k), (mid + 1, hi, k, b)]
        if now[n] >= best[n]:
            break
        best = now
        cuts.append(cut)
        layers.append(now)
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(top[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(rows: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, key: str = "doc_id") -> DataFrame:
    """``rows`` (with n_tokens) and bucket, bucket_len, batch_id ("bucket:number"), slot, padding."""
    rows = shared.materialize(rows)
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    top, count = (histogram.column(c).to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(top)
    top, count, total = top[order], count[order], int(count.sum())
    tops = boundaries(top, count, top * count, n_buckets)
    bucket = F.lit(0)
    for b in tops[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    ranges = max(1, -(-total // RANGE_ROWS))
    # The top 32 bits of an unsigned hash, cut into equal ranges: a range's number rises with the hash.
    order = F.shiftrightunsigned(F.xxhash64(key, F.lit("packing")), 32)
    placed = rows.withColumn("bucket", bucket).withColumn("__order", order).withColumn("__range", F.shiftrightunsigned(F.col("__order") * F.lit(ranges), 32).cast("int"))
    sizes = placed.groupBy("bucket", "__range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("bucket", "__range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("bucket", "__range").orderBy("__order", key)))
    position = F.col("__before") + F.col("__rank") - 1
    length = F.element_at(F.array(*[F.lit(int(t)).cast("long") for t in tops or [0]]), F.col("bucket") + 1)
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        ranked.join(before, ["bucket", "__range"])
        .withColumn("bucket_len", length)
        .withColumn("__at", position)
        .withColumn("batch_id", F.concat_ws(":", "bucket", F.floor(F.col("__at") / capacity)))
        .withColumn("slot", (F.col("__at") % capacity).cast("int"))
        .withColumn("padding", F.col("bucket_len") - F.col("n_tokens"))
        .drop("__order", "__range", "__before", "__rank", "__at")
    )


COLUMNS = ["doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding"]


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(lengths(shared.documents(spark, sf_dir), ["doc_id"])).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the batch and slot of every document."""
    return pack(lengths(docs, ["doc_id"])).select(*COLUMNS)
