"""Exact dedup behind static binary-fuse filters.

Documents come in batches; every earlier batch is an immutable *snapshot*: a folder with its exact buckets
(digest, bytes, largest id, copies) and, per digest shard, one static 3-wise binary-fuse filter (about 9 bits
a key), written once and read ever after (``Store``).  Digests of a new batch are grouped among themselves
first, then screened by the filters of every snapshot: what all reject is new for certain and joins nothing;
only what a filter passes joins that snapshot's buckets.  Every group of equal digests is then checked byte
by byte.

Texts are equal when they are identical after lower-casing A-Z.  Of equal texts the row with the
largest doc_id stays (null ids come last).  With that id on several rows of a group, all of them have the same
keep_id and one is kept; these rows are alike in all that is returned, so it does not matter which.  Null counts as
empty, so null and empty texts are one group.  Further columns are ignored.  An empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

SHARD_KEYS = 500_000


# --- the filter -------------------------------------------------------------------------------

def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = textkit.mix64(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    base = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    one = (base + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    two = (base + np.uint64(2 * segment)) ^ (h & mask)
    return base.astype(np.int64), one.astype(np.int64), two.astype(np.int64)


def _prints(keys: np.ndarray, seed: int) -> np.ndarray:
    h = textkit.mix64(keys ^ np.uint64(seed + 0x51ED27))
    return ((h >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, table) of a filter over distinct 64-bit keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return 0, 0, 0, b""
    segment = min(1 << 18, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) if n > 1 else 2.0
    count = max(1, -(-int(n * factor + 8) // segment) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            count += max(1, count // 10)
        size = (count + 2) * segment
        at = np.stack(_slots(keys, seed, segment, count))
        load = np.bincount(at.reshape(-1), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.add.at(who, row, np.arange(n))  # a slot of load 1 holds the number of its only key
        order, done = [], np.zeros(n, bool)
        ready = np.flatnonzero(load == 1)
        while len(ready):
            ready = ready[load[ready] == 1]
            key, first = np.unique(who[ready], return_index=True)
            slot = ready[first]
            order.append((key, slot))
            done[key] = True
            gone = at[:, key].reshape(-1)
            np.subtract.at(load, gone, 1)
            np.subtract.at(who, gone, np.tile(key, 3))
            ready = np.unique(gone[load[gone] == 1])
        if done.all():
            table, prints = np.zeros(size, np.uint8), _prints(keys, seed)
            for key, slot in reversed(order):
                table[slot] = 0
                table[slot] = prints[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
            return seed, segment, count, table.tobytes()
    raise ValueError("no filter found")


def fuse_test(keys: np.ndarray, built: tuple[int, int, int, bytes]) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    seed, segment, count, blob = built
    keys = keys.astype(np.uint64)
    if not count:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8)
    a, b, c = _slots(keys, seed, segment, count)
    return _prints(keys, seed) == table[a] ^ table[b] ^ table[c]


# --- snapshots --------------------------------------------------------------------------------

BUCKETS = "digest binary, n_bytes long, keep_id long, group_size long"


class Store:
    """Immutable snapshots below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder, []

    def add(self, name: str, buckets: DataFrame) -> None:
        """Writes the exact buckets (BUCKETS, distinct digests) of a snapshot and its filters, once and for all."""
        buckets.select("digest", "n_bytes", "keep_id", "group_size").write.parquet(f"{self.folder}/{name}/buckets")
        stored = self.buckets(name)
        shards = max(1, -(-stored.count() // SHARD_KEYS))

        def build(group: pa.Table) -> pa.Table:
            seed, segment, count, blob = fuse_build(_keys(group.column("digest")))
            return pa.table({"shard": [group.column("shard")[0].as_py()], "shards": [shards], "seed": [seed], "segment": [segment], "count": [count], "blob": [blob]},
                            schema=pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("seed", pa.int64()), ("segment", pa.int64()), ("count", pa.int64()), ("blob", pa.binary())]))

        keyed = stored.select(_shard(shards).alias("shard"), "digest")
        keyed.groupBy("shard").applyInArrow(build, "shard int, shards int, seed long, segment long, count long, blob binary").write.parquet(f"{self.folder}/{name}/filters")
        self.names.append(name)

    def buckets(self, name: str) -> DataFrame:
        return self.spark.read.schema(BUCKETS).parquet(f"{self.folder}/{name}/buckets")

    def filters(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/filters")

    def screen(self, name: str, batch: DataFrame, size: int) -> DataFrame:
        """Those of ``batch`` (BUCKETS, ``size`` rows) that the snapshot may hold: all that it holds, and one in 256 others.

        A shard's filter meets the batch in pieces of about SHARD_KEYS digests, however large the batch is.
        """
        filters = self.filters(name)
        some = filters.select("shards").first()
        if some is None:
            return batch.limit(0)
        pieces = max(1, -(-size // (some.shards * SHARD_KEYS)))
        piece = F.pmod(F.xxhash64("digest", F.lit("piece")), F.lit(pieces)).cast("int")

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            own = left.select(["digest", "n_bytes", "keep_id", "group_size"])
            if not left.num_rows or not right.num_rows:
                return own.slice(0, 0)
            built = tuple(right.column(c)[0].as_py() for c in ("seed", "segment", "count", "blob"))
            return own.filter(pa.array(fuse_test(_keys(left.column("digest")), built)))

        keyed = batch.select(_shard(some.shards).alias("shard"), piece.alias("piece"), "digest", "n_bytes", "keep_id", "group_size")
        copies = filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        return keyed.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInArrow(probe, BUCKETS)


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _keys(column) -> np.ndarray:
    """The first eight bytes of each digest."""
    raw, offs = textkit.text_buffers(column)
    return raw.reshape(-1, 32)[:, :8].copy().view("<u8").reshape(-1).astype(np.uint64) if len(offs) > 1 else np.zeros(0, np.uint64)


# --- documents --------------------------------------------------------------------------------

def digests(docs: DataFrame, keep: list[str], folded: bool = False, only: shared.Sieve | None = None) -> DataFrame:
    """``keep`` columns, the SHA-256 of the folded text, its length in bytes; with ``folded`` also those bytes.

    ``only``: a sieve of digests; what it stops is left out.  A batch is worked off by blocks, so its texts are not held several times.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["digest binary", "n_bytes long"] + ["folded binary"] * folded)

    def run(batches):
        for batch in batches:
            for lo, hi, _, _ in textkit.blocks(*textkit.text_buffers(batch.column("__bytes"))):
                part = batch.slice(lo, hi - lo)
                # bytes.lower() changes A-Z only
                texts = [(x or b"").lower() for x in part.column("__bytes").to_pylist()]
                digest = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
                columns = [part.column(c) for c in keep] + [digest, pa.array([len(x) for x in texts], pa.int64())]
                columns += [pa.array(texts, pa.binary())] * folded
                out = pa.RecordBatch.from_arrays(columns, [*keep, "digest", "n_bytes", *["folded"] * folded])
                yield out if only is None else out.filter(pa.array(only.passes(_keys(digest))))

    return shared.in_arrow(docs.select(*keep, F.col("text").cast("binary").alias("__bytes")), run, schema)


def _sieve(groups: DataFrame) -> shared.Sieve:
    """Of the groups' digests, by their first eight bytes."""
    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column("digest")).view(np.int64))], ["key"])

    return shared.Sieve(groups.select("digest").mapInArrow(keys, "key long"))


def group_digests(rows: DataFrame, arrival, batches: int, store: Store | None = None) -> DataFrame:
    """BUCKETS over all rows (digest, n_bytes, doc_id); ``arrival``: number of the batch (0 first) that brings a row.

    Each batch is grouped by digest (pre-aggregated, so copies never travel), screened against the snapshots
    before it, and what is new in it becomes the next snapshot.  Nothing that is rejected takes part in a join.
    """
    spark = rows.sparkSession
    shared.ensure_checkpoint_dir(spark)
    store = store or Store(spark, f"{spark.sparkContext.getCheckpointDir()}/snapshots-{uuid.uuid4().hex}")
    own = shared.materialize(rows.groupBy("digest", "n_bytes", arrival.alias("__batch")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    sizes = {r["__batch"]: r["count"] for r in own.groupBy("__batch").count().collect()}
    again = None
    for k in range(batches):
        batch = own.where(F.col("__batch") == k).drop("__batch")
        met = None
        for name in store.names:
            maybe = store.screen(name, batch, sizes.get(k, 0))
            hits = maybe.join(store.buckets(name).select("digest"), "digest", "left_semi").withColumn("__name", F.lit(name))
            met = hits if met is None else met.unionByName(hits)
        if met is not None:
            met = shared.materialize(met)
            if not met.isEmpty():
                again = met if again is None else again.unionByName(met)
                batch = batch.join(met.select("digest"), "digest", "left_anti")
        store.add(str(len(store.names)), batch)
    out = None
    for name in store.names:
        buckets = store.buckets(name)
        if again is not None:
            more = again.where(F.col("__name") == name).groupBy("digest").agg(F.max("keep_id").alias("__keep"), F.sum("group_size").alias("__more"))
            buckets = buckets.join(more, "digest", "left").select(
                "digest", "n_bytes", F.greatest("keep_id", "__keep").alias("keep_id"), (F.col("group_size") + F.coalesce("__more", F.lit(0))).alias("group_size")
            )
        out = buckets if out is None else out.unionByName(buckets)
    return out


def _salted(rows: DataFrame, groups: DataFrame, hot: list, parts: int = 32, how: str = "inner") -> DataFrame:
    """rows joined with their group; rows of the few hot digests are spread over ``parts`` copies of its entry."""
    if not hot:
        return rows.join(groups, "digest", how)
    is_hot = F.col("digest").isin([F.lit(bytes(x)) for x in hot])
    zero = F.lit(0).cast("long")
    left = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(parts).cast("long"))).otherwise(zero))
    right = groups.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(zero, F.lit(parts - 1).cast("long"))).otherwise(F.array(zero))))
    return left.join(right, ["digest", "__salt"], how).drop("__salt")


def uneven(docs: DataFrame, groups: DataFrame, hot: list) -> DataFrame:
    """Digests whose documents are not all the same bytes.

    Texts of single documents do not travel, as far as the sieve tells; the others meet their group once, and a group whose
    smallest and largest text agree is even; both are partial aggregates, so copies do not travel again.
    """
    several = groups.where("group_size > 1").select("digest")
    texts = digests(docs.select("doc_id", "text"), ["doc_id"], True, _sieve(several)).drop("n_bytes")
    members = _salted(texts, several, hot)
    ends = members.groupBy("digest").agg(F.min("folded").alias("least"), F.max("folded").alias("most"))
    return ends.where("least <> most").select("digest")


def dedup(docs: DataFrame, arrival, batches: int, byte_check: bool = True, store: Store | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``arrival``: the number, below ``batches``, of the batch that brings a document.
    """
    rows = shared.materialize(digests(docs.select("doc_id", "text"), ["doc_id"]))
    groups = shared.materialize(group_digests(rows, arrival, batches, store))
    hot = shared.hot_keys(groups, "digest", "group_size")
    joined = _salted(rows.drop("n_bytes"), groups.select("digest", "keep_id", "group_size"), hot)
    if byte_check:
        odd = shared.materialize(uneven(docs, groups, hot))
        if not odd.isEmpty():
            joined = joined.join(odd, "digest", "left_anti").unionByName(_by_bytes(docs, odd).select(joined.columns))
    tie = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Several rows may carry the largest id: one of them is kept.
    group = [c for c in ("digest", "folded", "keep_id") if c in joined.columns]
    twins = joined.where(tie).groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    kept = tie
    if not twins.isEmpty():
        w = Window.partitionBy(*group).orderBy(F.lit(1))
        ranked = joined.where(tie).withColumn("__rank", F.row_number().over(w))
        joined = joined.where(~tie).withColumn("__rank", F.lit(0)).unionByName(ranked)
        kept = F.col("__rank") == 1
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _by_bytes(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """Documents of the ``odd`` digests, which form groups by their bytes: (doc_id, digest, keep_id, group_size)."""
    texts = shared.materialize(digests(docs.select("doc_id", "text"), ["doc_id"], folded=True).join(odd, "digest", "left_semi"))
    own = texts.groupBy("digest", "folded").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return texts.join(own, ["digest", "folded"]).select("doc_id", "digest", "keep_id", "group_size")


#: op3 and the stage take the documents as so many batches, by checksum of the id: two snapshots and the incoming one.
BATCHES = 3


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return dedup(docs, textkit.sql_crc_bucket("doc_id", BATCHES), BATCHES)


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def filter_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays, with its columns.

    Of several rows of one text with that id (or with none, where all ids are null) the one with the least hash of its
    text as written, then of its columns, stays.  Null and empty texts are one group; groups of equal digests are
    checked by their bytes.  Rows of different texts never stand for each other, whatever their ids.
    """
    docs, restore = shared.shield(docs)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = shared.materialize(digests(hashed, ["doc_id", "h"]))
    groups = shared.materialize(group_digests(rows, textkit.sql_crc_bucket("doc_id", BATCHES), BATCHES))
    hot = shared.hot_keys(groups, "digest", "group_size")
    odd = shared.materialize(uneven(docs, groups, hot))
    several = groups.where("group_size > 1").select("digest")
    copies = _salted(rows.select("doc_id", "h", "digest"), several, hot)
    if not odd.isEmpty():
        texts = digests(hashed, ["doc_id", "h"], True, _sieve(odd)).join(odd, "digest", "left_semi")
        copies = copies.join(odd, "digest", "left_anti").unionByName(texts.select("doc_id", "h", F.concat("digest", "folded").alias("digest")))
    copies = shared.materialize(copies.groupBy("digest", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")))
    # The largest id first, null ids last, then the least hash.
    best = copies.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("less"), "h")).alias("best"))
    judged = shared.salted(copies, best, "digest", hot)
    stays = F.bitwise_not("doc_id").eqNullSafe(F.col("best.less")) & (F.col("h") == F.col("best.h"))
    return settle(docs, judged.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "n", stays.alias("stays"))).select(*restore)


def settle(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without the judged rows (__id, __h: hash of the text, n: rows, stays) that do not stay, one of those that do.

    Rows that nothing was said about do not travel, as far as a sieve of the hashes tells.
    """
    act = shared.materialize(judged.where("NOT stays OR n > 1"))
    sieve = shared.Sieve(act.select("__h"))
    marked = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__maybe", sieve.column("__hash"))
    row = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    bound = marked.where("__maybe").join(act.where("NOT stays"), row, "left_anti")
    twins = act.where("stays").select("__id", "__h")
    if not twins.isEmpty():
        bound = bound.join(twins, row, "left_anti").unionByName(one_of(bound.join(twins, row, "left_semi"), ["doc_id", "__hash"]))
    return marked.where("NOT __maybe").unionByName(bound).drop("__hash", "__maybe")


def one_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of the rows of each group the one with the least hash of its columns (maps, which have none, aside)."""
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), F.xxhash64(*hashed)).alias("__r")).select(*by, "__r.*").select(rows.columns)
