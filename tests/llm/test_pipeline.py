import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from spindrift.llm import quality
from tests.llm.test_exact import fold
from tests.llm.test_models import text_of
from tests.llm.test_near import brute_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, text_of(rng, rng.randint(30, 120)) if i % 5 else " | ".join(text_of(rng, 40).split())) for i in range(160)]
    rows += [(500 + i, rows[i + 1][1].upper() if i % 2 else rows[i + 1][1]) for i in range(0, 40, 3)]
    for i in range(20):
        words = rows[7 * i + 1][1].split()
        rows.append((700 + i, " ".join([*words[:-1], "changed"])))
    rows += [(900, None), (901, "")]
    out = tmp_path_factory.mktemp("sf")
    docs = [(i, t, rng.choice(["en", "fr"]), f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), None) if last else stage(spark, docs, folder)
        if not last:
            assert docs.columns == columns, name
            docs = spark.createDataFrame(docs.collect(), before.schema)
        kept[name] = docs.collect()
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    good = {r.doc_id for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet"), model, ["doc_id"]).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept["quality"]} == good and 5 not in good and 1 in good
    best: dict[str, int] = {}
    for i in good:
        best[fold(rows[i].text)] = max(i, best.get(fold(rows[i].text), -1))
    exact = set(best.values())
    assert {r.doc_id for r in kept["exact dedup"]} == exact < good
    order = sorted(exact)
    roots = {order[k] for k in set(brute_classes([rows[i].text for i in order]))}
    near = {r.doc_id for r in kept["near dedup"]}
    # Every class keeps its smallest id; the stage's stated recall is 0.9, so a few copies may stay beside it.
    assert roots <= near and len(near - roots) <= 0.1 * (len(exact) - len(roots)) and len(roots) < len(exact)
    mixed = Counter(r.doc_id for r in kept["mixing"])
    assert set(mixed) == near and all(r == rows[r.doc_id] for r in kept["mixing"])
    assert Counter(r.doc_id for r in kept["packing"]) == mixed
    assert all(r.n_tokens == len((rows[r.doc_id].text or "").split()) <= r.bucket_len for r in kept["packing"])


def test_run_and_empty(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "n_tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


WORKER = """
import re, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from spindrift.llm import exact

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "true").getOrCreate()

def held(batches):
    list(batches)
    own = sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))
    most = int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read()).group(1))
    yield pa.RecordBatch.from_arrays([pa.array([own // 1024]), pa.array([most // 1024])], ["own", "most"])

def now():
    return tuple(spark.range(0, 1, 1, 1).mapInArrow(held, "own long, most long").first())

first = now()
docs = spark.range(0, 10000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 64).alias("text"))
for _ in range(2):
    exact.digests(docs, ["doc_id"], True).write.format("noop").mode("overwrite").save()
    print("MB", *first, *now())
"""


def test_worker_hands_its_memory_back():
    """A batch of 41 MB of texts: little stays with a worker that waits for its next task, and a task holds less than three copies."""
    root = str(Path(__file__).resolve().parents[2])
    said = subprocess.run([sys.executable, "-c", WORKER.format(root=root)], capture_output=True, text=True, timeout=300, check=True).stdout
    for line in re.findall(r"^MB (.*)$", said, re.M):
        own, most, own_after, most_after = map(int, line.split())
        assert own_after - own < 40, line
        assert most_after - most < 3 * 41, line
    assert "MB" in said
