"""Run logs and checks: summaries, memory, similarity, co-changes, reconciliation, schema and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import graph, retrieval

EVENT_SCHEMA = "run_id string, seq int, t double, kind string, data map<string, string>"


def summarize(events: DataFrame) -> DataFrame:
    """One row per run of EVENT_SCHEMA events: counts by kind, model calls and latency, checks, the last outcome."""
    number = lambda key: F.coalesce(F.expr(f"try_cast(data['{key}'] AS double)"), F.lit(0.0))
    is_check, is_call, is_end = F.col("kind") == "check", F.col("kind") == "model_call", F.col("kind") == "outcome"
    kinds = events.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("event_counts"))
    rows = events.groupBy("run_id").agg(
        F.round(F.max("t"), 3).alias("duration_s"),
        F.count_if(is_call).alias("model_calls"), F.round(F.coalesce(F.sum(F.when(is_call, number("latency"))), F.lit(0.0)), 3).alias("model_latency_s"),
        F.count_if(is_check).alias("checks"), F.count_if(is_check & (F.lower(F.expr("data['ok']")) == "true")).alias("checks_passed"),
        F.max_by(F.when(is_end, F.col("data")), F.when(is_end, F.col("seq"))).alias("__end"),
    )
    end = F.col("__end")
    return rows.join(kinds, "run_id").select(
        "run_id", "duration_s", "event_counts", "model_calls", "model_latency_s", "checks", "checks_passed",
        F.coalesce(F.lower(end["resolved"]) == "true", F.lit(False)).alias("resolved"), F.coalesce(end["won_by"], F.lit("")).alias("won_by"),
        F.coalesce(F.expr("try_cast(__end['attempts'] AS int)"), F.lit(0)).alias("attempts"),
        F.when(F.coalesce(end["files"], F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(end["files"], ",")).alias("files"),
    )


def memory_stats(runs: DataFrame) -> DataFrame:
    """One row: runs, resolved, resolved_rate, avg_attempts_on_win."""
    n, won = F.count(F.lit(1)), F.count_if(F.col("resolved"))
    return runs.agg(
        n.alias("runs"), won.alias("resolved"), F.when(n > 0, F.round(won / n, 3)).alias("resolved_rate"),
        F.round(F.avg(F.when(F.col("resolved") & (F.col("attempts") != 0), F.col("attempts"))), 2).alias("avg_attempts_on_win"),
    )


def wins_by_layer(runs: DataFrame) -> DataFrame:
    return runs.where("resolved").groupBy("won_by").agg(F.count(F.lit(1)).alias("wins"))


def co_changes(members: DataFrame, run: str, item: str, min_count: int = 2, n_rows: int | None = None) -> DataFrame:
    """(a, b, count) of items that go together in at least ``min_count`` runs, a < b; members: (run, item).

    Tasks are set by the number of members (n_rows, if it is known or bounded), so that none holds more as they grow.
    """
    n = graph.tasks(members.sparkSession, members.count() if n_rows is None else n_rows)
    runs = members.select(run, item).where(F.col(run).isNotNull()).repartition(n, run).groupBy(run).agg(F.array_sort(F.collect_set(item)).alias("all"))
    # Item by item with those after it: a run of very many is never held as all its pairs.
    first = runs.select(F.posexplode("all").alias("at", "a"), "all")
    pairs = first.select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
    return pairs.repartition(n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)


def similar(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, top: int = 3) -> DataFrame:
    """(query, key, similarity, rank): Jaccard overlap of the distinct terms, above 0, the best ``top``."""
    a = retrieval.posted(queries, query_key, {query_text: 1}).select(query_key, "term", F.col("n_terms").alias("__na"))
    b = retrieval.posted(docs, key, {text: 1}).select(key, "term", F.col("n_terms").alias("__nb"))
    rows = b.join(a, "term").groupBy(query_key, key, "__na", "__nb").agg(F.count(F.lit(1)).alias("__both"))
    rows = rows.select(query_key, key, F.round(F.col("__both") / (F.col("__na") + F.col("__nb") - F.col("__both")), 6).alias("similarity"))
    w = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, status): missing, unexpected, mismatch or ok; both sides (key, total)."""
    left = expected.select(key, F.col("total").alias("expected"), F.lit(True).alias("__l"))
    right = actual.select(key, F.col("total").alias("actual"), F.lit(True).alias("__r"))
    rows = left.join(right, key, "full_outer")
    status = F.when(F.col("__l").isNull(), "unexpected").when(F.col("__r").isNull() | F.col("actual").isNull(), "missing").when(F.col("expected") != F.col("actual"), "mismatch").otherwise("ok")
    return rows.select(key, "expected", "actual", status.alias("status"))


def best_candidate(verdicts: DataFrame, group: str, index: str) -> DataFrame:
    """The candidate of most signal, then ok, score, fewest errors, then the first."""
    top = F.max_by(F.struct(*verdicts.columns), F.struct("signal", "ok", "score", -F.col("n_errors"), -F.col(index))).alias("v")
    return verdicts.groupBy(group).agg(top).select("v.*")


def stuck(attempts: DataFrame, group: str, order: list[str], signal: str, streak: int = 2) -> DataFrame:
    """(group, stuck_at): the first attempt at which ``streak`` signals in a row are zero (position from 1)."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = attempts.withColumn("__n", F.row_number().over(w))
    zero = F.col(signal) <= 0
    run = zero
    for k in range(1, streak):
        run = run & F.coalesce(F.lag(zero.cast("int"), k).over(w) == 1, F.lit(False))
    return rows.withColumn("__run", run).where("__run").groupBy(group).agg(F.min("__n").cast("long").alias("stuck_at"))


def coverage(expected: DataFrame, found: DataFrame, group: str, item: str) -> DataFrame:
    """(group, expected, hits, score): expected items that were found."""
    hit = found.select(group, item).distinct().withColumn("__hit", F.lit(1))
    rows = expected.select(group, item).distinct().join(hit, [group, item], "left")
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("hits"))
    return out.withColumn("score", F.col("hits") / F.col("expected"))


def schema_errors(record: str, required: dict[str, str]):
    """array<string> of what is wrong with a JSON record: not a record, missing keys, values of another type."""
    kinds = {"integer": "BIGINT", "number": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN"}
    text = F.col(record)
    fields = F.from_json(text, "map<string,string>")
    checks = []
    for key, kind in required.items():
        value = F.element_at(fields, key)
        has = F.coalesce(F.array_contains(F.map_keys(fields), key), F.lit(False))
        wrong = F.lit(False) if kind == "string" else F.expr(f"try_cast(from_json(`{record}`, 'map<string,string>')['{key}'] AS {kinds[kind]})").isNull()
        checks.append(F.when(~has, F.lit(f"missing key: {key}")).when(value.isNull() | wrong, F.lit(f"{key} is no {kind}")))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return F.when(fields.isNull(), F.array(F.lit("not a record"))).otherwise(errors)
