"""Graph queries over edges (src, dst, kind) and nodes (id, file, name, …)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of an iterative plan in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, but as a Parquet table in that folder: for wide rows of which later readers need some columns only."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only in local mode, where none need be named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return sc.getCheckpointDir()


#: Rows that one task of a spread shuffle holds, about.
ROWS = 250_000


def tasks(spark: SparkSession, n_rows: int) -> int:
    """Tasks for so many rows: named to repartition, so that what one task holds does not grow with the input whatever the session says."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, kind, direction): every edge seen from both of its ends; duplicates stay."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", F.lit("in").alias("direction")))


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    rows = both_ways(edges)
    if direction != "both":
        rows = rows.where(F.col("direction") == direction)
    return rows.join(ids, "id")


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(id, depth, kind): nodes reached within ``hops``, seeds left out; kind is the least one at the first hop that finds a node."""
    links = both_ways(edges).select("id", "other", "kind")
    links = cut(links) if hops > 1 else links  # every hop reads them
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("kind", F.lit(None).cast("string"))
    frontier = seen.select("id")
    for depth in range(1, hops + 1):
        step = links.join(frontier, "id").groupBy(F.col("other").alias("id")).agg(F.min("kind").alias("kind"))
        fresh = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "kind"))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh.select("id")
    return seen.where("depth > 0")


#: Nodes of a frontier that is sent to all edges.
SMALL = 10_000
#: Share of a node's score that reaches its neighbours, in hundredths.
DECAY = 55


def explore(edges: DataFrame, anchors: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, score, hops, via, origin): anchors (id, score) spread along edges, 0.55 a hop, in thousandths of the best anchor.

    A node keeps the score of the hop that first reaches it, the largest of that hop, with the kind and the
    near end of the edge that brought it (of equal ones the least near end, then kind); anchors have neither.
    Scores are whole thousandths, rounded half up, so all engines agree.  Edges may repeat and are read once a hop: give
    a table, or what is cheap to make from one.  A small frontier, by its count, is sent to them, so they need not move.
    """
    links = both_ways(edges).select("id", "other", "kind")
    top = anchors.agg(F.max("score")).scalar()
    kind = edges.schema["src"].dataType
    seen = anchors.select("id", F.floor(F.col("score") / top * 1000 + 0.5).cast("long").alias("score"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(None).cast(kind).alias("origin"))
    seen = cut(seen)  # else every hop finds the anchors again
    frontier = seen
    for hop in range(1, rounds + 1):
        handed = F.expr(f"(score * {DECAY} + 50) div 100")
        best = F.min(F.struct((-handed).alias("less"), F.col("id").alias("origin"), F.col("kind").alias("via"))).alias("best")
        near = frontier.select("id", "score")
        near = F.broadcast(near) if near.count() <= SMALL else near
        spread = links.join(near, "id").groupBy(F.col("other").alias("id")).agg(best)
        fresh = cut(spread.join(seen.select("id"), "id", "left_anti").select("id", (-F.col("best.less")).alias("score"), F.lit(hop).alias("hops"), "best.via", "best.origin"))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def discovered_files(found: DataFrame, nodes: DataFrame, top: int = 12) -> DataFrame:
    """(file, score, hops): sum of scores and least hops per file."""
    rows = found.join(nodes.select("id", "file"), "id")
    out = rows.groupBy("file").agg(F.sum("score").alias("score"), F.min("hops").alias("hops"))
    return out.orderBy(F.desc("score"), "file").limit(top)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming): distinct neighbours each way, from two grouped tables, not a fan-out."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    both = out.join(into, "id", "full_outer")
    return both.select("id", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 12) -> DataFrame:
    rows = nodes.select("id", "file").join(degrees(edges), "id", "left").na.fill(0, ["outgoing", "incoming"])
    return rows.orderBy(F.desc(F.col("outgoing") + F.col("incoming")), F.desc("incoming"), F.desc("outgoing"), "id").limit(top)


def file_hotspots(nodes: DataFrame, edges: DataFrame, top: int | None = 12) -> DataFrame:
    """(file, incoming, outgoing): distinct far-end symbols per file."""
    files = nodes.select("id", "file")
    into = edges.join(files, edges["dst"] == files["id"]).select("file", "src").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("incoming"))
    out = edges.join(files, edges["src"] == files["id"]).select("file", "dst").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("outgoing"))
    rows = nodes.select("file").distinct().join(into, "file", "left").join(out, "file", "left").na.fill(0, ["incoming", "outgoing"])
    return rows if top is None else rows.orderBy(F.desc(F.col("incoming") + F.col("outgoing")), F.desc("incoming"), "file").limit(top)


ENTRY_NAMES = ("app", "handler", "main", "run", "serve")
ENTRY_FILES = ("app.py", "cli.py", "server.py")


def entry_points(nodes: DataFrame, edges: DataFrame, is_entry, order: list[str], top: int = 12) -> DataFrame:
    """Nodes that nobody calls and that look like an entry, with their number of outgoing edges."""
    called = edges.where("kind = 'calls'").select(F.col("dst").alias("id")).distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"))
    rows = nodes.where(is_entry).join(called, "id", "left_anti").join(out, "id", "left").na.fill(0, ["outgoing"])
    return rows.orderBy(F.desc("outgoing"), *order).limit(top)


def looks_like_entry(name, file):
    out = name.isin(*ENTRY_NAMES)
    for suffix in ENTRY_FILES:
        out = out | file.endswith(suffix)
    return out


def dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, id): distinct callers, from other files, of what a file defines."""
    files = nodes.select("id", "file")
    rows = edges.where("kind = 'calls'").join(files.select(F.col("id").alias("dst"), "file"), "dst")
    rows = rows.join(files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src")
    return rows.where("src_file <> file").select("file", F.col("src").alias("id")).distinct()


def touching(nodes: DataFrame, edges: DataFrame, wanted) -> DataFrame:
    """Distinct (src, dst, kind) with the files of both ends, of which at least one is ``wanted`` (a predicate on a file column)."""
    files = nodes.select("id", "file")
    rows = edges.join(files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src")
    rows = rows.join(files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return rows.where(wanted(F.col("src_file")) | wanted(F.col("dst_file"))).select("src", "dst", "kind", "src_file", "dst_file").distinct()


def risks(callers: DataFrame) -> DataFrame:
    """callers with risk_score and risk_level; columns callers, tests, high, medium."""
    score = T.risk_score(F.col("callers"), F.col("tests"), F.col("high"), F.col("medium"))
    return callers.withColumn("risk_score", score.cast("long")).withColumn("risk_level", T.risk_level(F.col("risk_score")))


def first_seen(rows: DataFrame, key: str, arrival: str, limit: int) -> DataFrame:
    """First row per key by arrival, then the first ``limit``."""
    w = Window.partitionBy(key).orderBy(arrival)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy(arrival).limit(limit)
