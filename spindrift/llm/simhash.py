"""SimHash fingerprints of documents and of edited texts; all fingerprints within a Hamming radius.

A fingerprint has BITS = 128 bits.  Terms are the words of the A-Z-folded text, weighted by length (1 to
3), and pairs of neighbouring words (weight 4); each term's hash votes +weight or -weight on every bit,
and a bit is set when its sum is positive.  Likeness of two fingerprints is the cosine that their share
of differing bits stands for, cos(pi * differing / BITS), and 0 beyond a right angle.

Neighbour search uses block tables: the bits are cut into B blocks, a table for each, whose key is the
block.  Block k is given e_k errors so that the e_k + 1 sum up to radius + 1; two fingerprints within the
radius differ by at most e_k bits in some block k, so the one that is sought looks under its block with
every choice of at most e_k bits flipped.  A pair is reported by the first table that finds it only.
Equal fingerprints are one entry with a weight.

Edited texts need the next document by descending id.  Documents are cut into ranges of (id, hash of the
text), so many rows of one id or of none are spread as well (only rows equal in both share a range); a range's
first document is also given to the range before it, so each text is shuffled once and a task streams its
sorted rows holding two of them.

Defined results: null and empty texts have fingerprint zero and edit as empty; equal texts are alike (1),
so an empty text and its equally empty edit are too; ties in doc_id are ordered by a hash of the text, null
ids come last (with the id -2**63, by hash); a single document is its own next one.  Extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

BITS = 128
#: From distances of edited copies (README); at 6 blocks of 21 or 22 bits one error each.
RADIUS, BLOCKS = 11, 6
BUCKET_BYTES = 16 << 20


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(n_docs, 2) uint64: the fingerprint's lower and upper half."""
    words = textkit.Words(buf, offs)
    n_docs = len(offs) - 1
    out = np.zeros((n_docs, 2), np.uint64)
    if not len(words):
        return out
    hashes, doc, length = words.hashes(), words.docs(), words.end - words.start
    weight = np.minimum(3, 1 + length // 4)
    pair = textkit.mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    inside = doc[1:] == doc[:-1]
    # Words and pairs of a document next to each other: a pair sits behind its first word.
    terms, weights = np.empty(2 * len(hashes), np.uint64), np.zeros(2 * len(hashes), np.int64)
    terms[0::2], weights[0::2] = hashes, weight
    terms[1::2] = 0
    terms[1:-1:2], weights[1:-1:2] = pair, np.where(inside, 4, 0)
    first = words.first * 2
    total = np.bincount(np.repeat(doc, 2), weights=weights, minlength=n_docs)
    for half in (0, 1):
        h = terms if half == 0 else textkit.mix64(terms ^ np.uint64(0xA5A5A5A55A5A5A5A))
        votes = textkit.bit_votes(h, first, weights)
        out[:, half] = textkit.pack_bits(votes * 2 > total[:, None])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differing = np.bitwise_count(a ^ b).sum(1)
    return np.where(differing * 2 >= BITS, 0.0, np.cos(np.pi * differing / BITS))


def render(fp: np.ndarray) -> list[str]:
    return [f"{hi:016x}{lo:016x}" for lo, hi in fp.tolist()]


# --- the next document ------------------------------------------------------------------------

def _order():
    """(u, h): documents by descending id, null ids last, ties by a hash of the text, are sorted by both ascending."""
    u = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(2**63 - 1))
    return u.alias("u"), F.xxhash64("text").alias("h")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (bucket, guest, u, h, doc_id, text), so that within a bucket, sorted by guest, u and h,
    every row that is no guest is followed by the next document.

    Buckets are ranges of (u, h) of about BUCKET_BYTES; the driver sees the head of each: two numbers a bucket,
    which are sent to the executors as arrays.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = docs.select(*_order()).repartitionByRange(max(1, int(size // BUCKET_BYTES)), "u", "h")
    heads = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("u", "h")).alias("m")).select("m.u", "m.h").toArrow()
    us, hs = (heads.column(c).to_numpy() for c in ("u", "h"))
    rank = np.lexsort((hs, us))
    sent = docs.sparkSession.sparkContext.broadcast((us[rank], hs[rank]))

    @F.pandas_udf("bucket int, host int")
    def place(u: pd.Series, h: pd.Series) -> pd.DataFrame:
        us, hs = sent.value
        u, h = u.to_numpy(), h.to_numpy()
        # The last head at or before the row; among heads of one id their hashes tell.
        first, last = np.searchsorted(us, u, "left"), np.searchsorted(us, u, "right")
        at = last - 1
        for i in np.flatnonzero((last > first) & ((last - first > 1) | (h < hs[np.minimum(first, len(hs) - 1)]))).tolist():
            at[i] = first[i] + np.searchsorted(hs[first[i] : last[i]], h[i], "right") - 1
        leads = (us[at] == u) & (hs[at] == h)
        return pd.DataFrame({"bucket": at.astype(np.int32), "host": np.where(leads, (at - 1) % len(us), -1).astype(np.int32)})

    rows = docs.select(*_order(), "doc_id", "text").withColumn("p", place("u", "h"))
    home = F.struct(F.col("p.bucket").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(F.col("p.host").alias("bucket"), F.lit(1).alias("guest"))
    own = F.explode(F.when(F.col("p.host") >= 0, F.array(home, away)).otherwise(F.array(home)))
    return rows.select(own.alias("at"), "u", "h", "doc_id", "text").select("at.bucket", "at.guest", "u", "h", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points gives way to as many first ones of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lo long, hi long"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """SCHEMA of every document of docs (doc_id, text)."""
    placed = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ready = placed.repartition("bucket").sortWithinPartitions("bucket", "guest", "u", "h").drop("u", "h")

    def flush(rows):
        ids, texts, following = zip(*rows)
        changed = [edited(a, b) for a, b in zip(texts, following)]
        encoded = [x.encode() for x in (*texts, *changed, *following)]
        buf, offs = textkit.text_buffers(pa.array(encoded, pa.large_binary()))
        fp = np.concatenate([fingerprints(b, o) for _, _, b, o in textkit.blocks(buf, offs)])
        n = len(texts)
        own, edit, after = fp[:n], fp[n : 2 * n], fp[2 * n :]
        half = own.view(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in encoded[n : 2 * n]]),
            pa.array(render(own)), pa.array(render(edit)), pa.array(likeness(own, edit)), pa.array(likeness(own, after)), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lo", "hi"])

    def run(batches):
        held, rows, size = None, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for bucket, guest, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                    text = text or ""
                    if held is not None and held[0] == bucket:
                        rows.append((held[1], held[2], text))
                        size += len(held[2])
                        if size > textkit.BLOCK_BYTES:
                            yield flush(rows)
                            rows, size = [], 0
                    # Of guests only the first follows somebody.
                    held = None if guest else (bucket, doc_id, text)
        if rows:
            yield flush(rows)

    return ready.mapInArrow(run, SCHEMA)


# --- neighbours -------------------------------------------------------------------------------

def _masks(k: int, blocks: int) -> dict[str, int]:
    """The bits of block k in lo and in hi; a block may reach over both halves."""
    mask = (1 << BITS * (k + 1) // blocks) - (1 << BITS * k // blocks)
    return {"lo": mask & (2**64 - 1), "hi": mask >> 64}


def _long(x: int):
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _errors(radius: int, blocks: int) -> list[int]:
    """Errors allowed in each block; -1: no table."""
    each, rest = divmod(radius + 1, blocks)
    return [each - 1 + (k < rest) for k in range(blocks)]


def tables(rows: DataFrame, radius: int, blocks: int, look: bool) -> DataFrame:
    """rows once per table, with its number and key; with ``look`` once per key that finds all neighbours."""
    keys = []
    for k, errors in enumerate(_errors(radius, blocks)):
        mask = _masks(k, blocks)
        bits = range(BITS * k // blocks, BITS * (k + 1) // blocks)
        flips = [sum(1 << b for b in pick) for n in range(errors + 1 if look else min(1, errors + 1)) for pick in combinations(bits, n)]
        keys += [(k, flip & (2**64 - 1), flip >> 64, mask["lo"], mask["hi"]) for flip in flips]
    array = F.array(*[F.struct(F.lit(k).alias("table"), *[_long(x).alias(n) for n, x in zip(("flo", "fhi", "mlo", "mhi"), rest)]) for k, *rest in keys])
    own = [F.col(n).bitwiseAND(F.col(f"__k.m{n}")).bitwiseXOR(F.col(f"__k.f{n}")) for n in ("lo", "hi")]
    return rows.withColumn("__k", F.explode(array)).select(*rows.columns, F.col("__k.table").alias("table"), F.xxhash64("__k.table", *own).alias("key"))


def neighbours(sought: DataFrame, entries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(lo, hi, other_lo, other_hi, weight, differing) of all entries within the radius of each sought fingerprint.

    sought: distinct (lo, hi); entries: distinct (lo, hi, weight).  An entry equal to the sought one is included.
    """
    left = tables(sought.select("lo", "hi"), radius, blocks, True)
    right = tables(entries.select("lo", "hi", "weight"), radius, blocks, False).select(F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), "weight", "table", "key")
    # The sought side is many keys a row, which no measured size tells before it is exploded: never broadcast.
    pairs = left.hint("merge").join(right, ["table", "key"])
    x = {n: F.col(n).bitwiseXOR(F.col(f"other_{n}")) for n in ("lo", "hi")}
    near = pairs.withColumn("differing", F.bit_count(x["lo"]) + F.bit_count(x["hi"])).where(F.col("differing") <= radius)
    # The first table whose block has few enough errors reports the pair.
    first = F.lit(-1)
    for k, errors in reversed(list(enumerate(_errors(radius, blocks)))):
        own = sum((F.bit_count(x[n].bitwiseAND(_long(m))) for n, m in _masks(k, blocks).items()), F.lit(0))
        first = F.when(own <= errors, F.lit(k)).otherwise(first)
    return near.where(first == F.col("table")).select("lo", "hi", "other_lo", "other_hi", "weight", "differing")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and edits of all documents; n_within: for ids divisible by 100, how many other documents
    have a fingerprint within RADIUS bits (null for other ids)."""
    rows = shared.materialize(fingerprint_edits(shared.documents(spark, sf_dir)))
    entries = rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("weight"))
    sought = rows.where("doc_id % 100 = 0").select("lo", "hi").distinct()
    within = neighbours(sought, entries).groupBy("lo", "hi").agg((F.sum("weight") - 1).alias("n_within"))
    asked = rows.where("doc_id % 100 = 0").join(within, ["lo", "hi"], "left")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    others = rows.where("doc_id IS NULL OR doc_id % 100 <> 0").select(*columns, F.lit(None).cast("long").alias("n_within"))
    return asked.select(*columns, "n_within").unionByName(others)
