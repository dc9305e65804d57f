import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import exact

SCHEMA = "doc_id long, text string, digest string, kept int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def rows_of():
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "A"), (4, "a"), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (None, "a"), (None, "only null"), (4, "a"), (4, "other text")]
    rows += [(10 + i, rng.choice(["same", "SAME", "two", f"own {i}"])) for i in range(200)]
    return [(i, t, "clash", 9) for i, t in rows]


def check(out, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[fold(t)].append(i)
    assert len(out) == len(rows)
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("hot", [False, True])
def test_groups(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(exact.shared, "hot_keys", lambda c, k, n, share=0: [r[0] for r in c.where("group_size > 3").select("digest").collect()])
    rows = rows_of()
    out = exact.dedup(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("doc_id") % 4, F.lit(1)), 4).collect()
    check(out, rows)


def test_three_snapshots(spark, tmp_path, monkeypatch):
    """What every filter rejects never joins, filters are written once per snapshot, and later batches read them."""
    texts = [f"own {i}" for i in range(3000)] + [f"own {i}" for i in range(0, 3000, 10)] + ["SAME"] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(exact, "SHARD_KEYS", 300)
    store, screened, joined = exact.Store(spark, str(tmp_path)), [], []
    probe, buckets = store.screen, store.buckets
    monkeypatch.setattr(store, "screen", lambda name, batch, size: screened.append((name, size, out := probe(name, batch, size).count())) or probe(name, batch, size))
    got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4, 4, store=store).collect()
    check(got, rows)
    assert store.names == ["0", "1", "2", "3"] and [n for n, *_ in screened] == ["0", "0", "1", "0", "1", "2"]
    assert [store.filters(n).count() for n in store.names] == [store.filters(n).first().shards for n in store.names] and store.filters("0").count() > 1
    # 300 texts come again; of the others a filter passes one in 256.
    for name, size, passed in screened:
        assert passed < 0.02 * size + 110
    stored = [buckets(n).select("digest") for n in store.names]
    assert sum(s.count() for s in stored) == len({fold(t) for t in texts})


def test_equal_digests_of_different_bytes(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "cc", "AA", "d", "e", "D", "bb"])]
    rows += [(None, "BB"), (None, "zz"), (7, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = F.rpad((F.length(F.coalesce("text", F.lit(""))) % 2).cast("string"), 32, "0").cast("binary")

    def digests(docs, keep, folded=False, only=None):
        out = docs.withColumns({"digest": weak, "n_bytes": F.length("text").cast("long"), "folded": F.lower("text").cast("binary")})
        return out.select(*keep, "digest", "n_bytes", *["folded"] * folded)

    monkeypatch.setattr(exact, "digests", digests)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.dedup(df, F.coalesce(F.col("doc_id") % 2, F.lit(0)), 2).collect())
    # Every digest's texts form groups of their own.
    assert got == sorted([
        ("0", "3", 2, False), ("3", "3", 2, True), ("1", "7", 4, False), ("7", "7", 4, True), ("7", "7", 4, False), ("None", "7", 4, False),
        ("2", "2", 1, True), ("4", "6", 2, False), ("6", "6", 2, True), ("5", "5", 1, True), ("None", "None", 1, True),
    ])
    kept = sorted((str(r.doc_id), r.text) for r in exact.filter_exact(spark, df, "").collect())
    assert kept == sorted([("3", "AA"), ("7", "bb"), ("2", "cc"), ("6", "D"), ("5", "e"), ("None", "zz")])


def test_empty_table(spark):
    assert exact.dedup(spark.createDataFrame([], SCHEMA), F.lit(0), 2).collect() == []
    assert exact.filter_exact(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_stage_keeps_one_of_each(spark):
    rows = rows_of()
    out = exact.filter_exact(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == ["doc_id", "text", "digest", "kept"]
    texts = [fold(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({fold(t) for _, t, *_ in rows})


@pytest.mark.parametrize("hot", [False, True])
def test_stage_with_repeated_and_null_ids(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(exact.shared, "hot_keys", lambda c, k, n, share=0: [r[0] for r in c.where("group_size > 2").select("digest").collect()])
    rows = [(None, "a", "x", 1), (None, "A", "y", 2), (None, "b", "x", 3), (7, "c", "x", 4), (7, "C", "y", 5), (7, "d", "x", 6), (5, "c", "x", 7), (None, None, "x", 8), (3, "", "x", 9), (3, "", "x", 9), (9, "e", "q", 1)]
    runs = []
    for part in (rows, rows[::-1]):
        out = exact.filter_exact(spark, spark.createDataFrame(part, SCHEMA).withColumn("m", F.create_map("digest", "kept")), "")
        assert out.columns == ["doc_id", "text", "digest", "kept", "m"]
        runs.append(sorted((str(r.doc_id), r.text, r.digest, r.kept) for r in out.collect()))
    assert runs[0] == runs[1]  # whichever way the rows come
    assert sorted((i, fold(t)) for i, t, *_ in runs[0]) == sorted([("None", "a"), ("None", "b"), ("7", "c"), ("7", "d"), ("3", ""), ("9", "e")])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    built = exact.fuse_build(np.concatenate([keys, keys[: n // 2]]))
    assert exact.fuse_test(keys, built).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert exact.fuse_test(others, built).mean() < 0.01
