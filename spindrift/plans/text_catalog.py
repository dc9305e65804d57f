"""Named queries over messy text and run logs: replies that follow from the driver tables, with known readings."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse
from spindrift.functions import text as T
from spindrift.operators import graph, runs
from spindrift.operators.graph import cut
from spindrift.plans import corpus, memory
from spindrift.plans.catalog import _CANDIDATES, _SUMMARY, _verdicts, query, terms_sql
from spindrift.plans.corpus import table
from spindrift.sources import repo


def _said(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def _pick(of, *choices):
    """A text by the remainder of a number; ``{n}`` in it is the number."""
    out = F.lit(None).cast("string")
    for k, c in enumerate(choices):
        out = F.when(of % len(choices) == k, F.replace(F.lit(c), F.lit("{n}"), of.cast("string"))).otherwise(out)
    return out


def _udf(f, kind: str):
    """A function of one text as an Arrow-batched column function."""
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in texts], dtype=object)

    return run


# --- replies ----------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'done ' || conv_id WHEN 1 THEN 'tail ' || turn ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations""")
def reasoning_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without their reasoning: closed, only closed, only opened."""
    text, turn = F.col("text"), F.col("turn")
    reply = F.when(turn % 3 == 0, F.concat(F.lit("<think>"), text, F.lit("</think> done "), F.col("conv_id").cast("string"))).when(
        turn % 3 == 1, F.concat(text, F.lit("</think>tail "), turn.cast("string"))).otherwise(F.concat(F.lit(" "), text, F.lit(" <think>")))
    return _said(spark, sf_dir).select("conv_id", "turn", T.strip_reasoning(reply).alias("answer"))


@query("""SELECT conv_id, turn, 'src/m' || turn || '.py' AS path, CASE WHEN turn % 2 = 0 THEN 'x = 1' ELSE 'x = (' END || chr(10) AS code, turn % 2 = 0 AS compiles FROM conversations
UNION ALL SELECT conv_id, turn, 'notes/' || turn || '.txt', 'all {' || chr(10), false FROM conversations""")
def reply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that replies propose, and whether they compile."""
    fence = "```"
    reply = _pick(F.col("turn"), *[f"Sure.\nFILE: src/m{{n}}.py\n{fence}python\n{code}\n{fence}\nand\nFILE:  notes/{{n}}.txt \n{fence}\nall {{\n{fence}" for code in ("x = 1", "x = (")])
    rows = _said(spark, sf_dir).select("conv_id", "turn", F.explode(T.file_blocks(reply)).alias("b")).select("conv_id", "turn", "b.path", "b.code")
    return rows.withColumn("compiles", parse.compile_udf()("path", "code").isNull())


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'search_code' WHEN 1 THEN 'plan' WHEN 2 THEN 'read_file' WHEN 3 THEN 'b' END AS tool,
CASE turn % 5 WHEN 0 THEN 'query=q' || turn || ';top=3' WHEN 1 THEN 'task=t' || turn WHEN 2 THEN 'n=2;path=a' || turn || '.py' WHEN 3 THEN 'k=' || turn END AS args FROM conversations""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool a reply names: an object, a fenced one, a call, the last of two objects, none."""
    reply = _pick(
        F.col("turn"), '{"tool": "search_code", "args": {"query": "q{n}", "top": 3}}', 'So:\n```json\n{"name": "plan", "arguments": {"task": "t{n}"}}\n``` ok', 'I call read_file(path="a{n}.py", n=2).',
        '{"tool": "a"} no, {"action": "b", "input": {"k": "{n}"}}', "Nothing {n} to do.",
    )
    call = parse.tool_call_udf()(reply)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("c.args"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _said(spark, sf_dir).select("conv_id", "turn", call.alias("c")).select("conv_id", "turn", "c.tool", pairs.alias("args"))


_STEP = "array<struct<index: int, title: string, detail: string, kind: string, target: string>>"


@query("""SELECT conv_id, turn, 1::BIGINT AS place, CASE turn % 4 WHEN 0 THEN 'Edit ' || turn WHEN 1 THEN 'One' WHEN 2 THEN 'Solo' ELSE 'the task' END AS title,
CASE turn % 4 WHEN 0 THEN 'Edit ' || turn WHEN 1 THEN 'd' || turn WHEN 2 THEN 'Solo' ELSE 'the task' END AS detail, CASE turn % 4 WHEN 1 THEN 'investigate' ELSE 'edit' END AS kind,
CASE turn % 4 WHEN 0 THEN 'f.py' WHEN 1 THEN 't' || turn ELSE '' END AS target FROM conversations
UNION ALL SELECT conv_id, turn, 2, 'Step 2', '', 'edit', 'g.py' FROM conversations WHERE turn % 4 = 0""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of plan replies: an array, an object that holds one, a single step, no plan at all."""
    reply = _pick(
        F.col("turn"), 'Plan: [{"title": "Edit {n}", "file": "f.py"}, {"target": "g.py"}]', '{"steps": [{"title": "One", "detail": "d{n}", "kind": "investigate", "target": "t{n}"}]}', '{"title": "Solo", "n": {n}}', "None {n}.",
    )
    steps = _udf(lambda t: parse.plan_steps(t, "the task"), _STEP)(reply)
    rows = _said(spark, sf_dir).select("conv_id", "turn", F.explode(steps).alias("s"))
    return rows.select("conv_id", "turn", F.col("s.index").cast("long").alias("place"), "s.title", "s.detail", "s.kind", "s.target")


@query("""SELECT conv_id, turn, turn % 4 < 2 AS ran, CASE turn % 4 WHEN 0 THEN 12 WHEN 1 THEN turn END::BIGINT AS passed, CASE turn % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END::BIGINT AS failed FROM conversations""")
def test_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test logs read: failures, success, no tests, another exit code."""
    log = _pick(F.col("turn"), "= 3 failed, 12 passed in 0.1s =", "{n} passed", "no tests ran in 0.01s", "5 passed")
    text = F.col("turn") % 4
    out = _said(spark, sf_dir).select("conv_id", "turn", log.alias("log"), F.when(text == 0, 1).when(text == 3, 2).otherwise(0).alias("code"))

    @F.pandas_udf("ran boolean, passed long, failed long")
    def both(logs: pd.Series, codes: pd.Series) -> pd.DataFrame:
        got = [parse.test_summary(x, int(c)) for x, c in zip(logs, codes)]
        return pd.DataFrame({"ran": [g["ran"] for g in got], "passed": pd.array([g["passed"] for g in got], "Int64"), "failed": pd.array([g["failed"] for g in got], "Int64")})

    return out.select("conv_id", "turn", both("log", "code").alias("r")).select("conv_id", "turn", "r.ran", "r.passed", "r.failed")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN turn END AS a FROM conversations")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON object in a reply; none where there is no object or it is broken."""
    reply = _pick(F.col("turn"), 'pre {"a": {n}, "b": {"c": 1}} post', '{"a": {n}}', '{"a": {n}')
    read = _udf(lambda t: (parse.first_object(t) or {}).get("a"), "long")
    return _said(spark, sf_dir).select("conv_id", "turn", read(reply).alias("a"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'error' WHEN 2 THEN 'true' WHEN 3 THEN 'false' ELSE 'x' || event_id END AS value FROM events""")
def arguments_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as integer, number, boolean and string."""
    kinds = ("integer", "number", "boolean", "boolean", "string")

    @F.pandas_udf("string")
    def coerced(ids: pd.Series, texts: pd.Series) -> pd.Series:
        def one(i, t):
            try:
                return json.dumps(parse.coerce("x", kinds[i % 5], t)).strip('"')
            except parse.ArgumentError:
                return "error"

        return pd.Series([one(i, t) for i, t in zip(ids, texts)])

    return table(spark, sf_dir, "events").select("event_id", coerced("event_id", _pick(F.col("event_id"), "{n}", "x{n}", "Yes", "no", "x{n}")).alias("value"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'search_code' WHEN 1 THEN 'get_context' WHEN 3 THEN 'plan' END AS tool FROM events")
def tools_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely written tool names."""
    known = ["search_code", "get_context", "inspect_code", "plan"]
    return table(spark, sf_dir, "events").select("event_id", _udf(lambda t: parse.closest(t, known), "string")(_pick(F.col("event_id"), "serch_code", "getcontext", "xyzzy", "plan")).alias("tool"))


@query("""SELECT conv_id, turn, '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || turn || chr(10) || '+c' || turn || chr(10) AS diff FROM conversations""")
def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn").cast("string")
    side = lambda c: F.concat(F.lit(f"a\n{c}"), n, F.lit("\n"))
    return _said(spark, sf_dir).select("conv_id", "turn", parse.diff_udf()(F.lit("m.py"), side("b"), side("c")).alias("diff"))


@query("SELECT doc_id, coalesce(length(text) > 400, false) AS truncated, substr(text, 1, 400) AS preview FROM documents WHERE text IS NOT NULL")
def observations_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.clip(F.col("text"), 400).alias("c")).select("doc_id", "c.truncated", "c.preview")


@query("SELECT conv_id, turn, turn % 5 = turn % 3 OR turn % 4 = 0 AS hit FROM conversations")
def plan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a plan names a file by path, base name or stem."""
    n = F.col("turn")
    said = F.concat(F.lit("Change mod"), (n % 5).cast("string"), F.when(n % 4 == 0, F.concat(F.lit(" and src/mod"), (n % 3).cast("string"), F.lit(".py"))).otherwise(""), F.lit(" first"))
    return _said(spark, sf_dir).select("conv_id", "turn", T.mentions_file(said, F.concat(F.lit("src/mod"), (n % 3).cast("string"), F.lit(".py"))).alias("hit"))


# --- verdicts, run logs, memory ----------------------------------------------------------------


@query(f"""WITH {_CANDIDATES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN -1e0 ELSE round(signal + CASE l_suppkey % 3 WHEN 0 THEN 15e-2 WHEN 1 THEN -5e-2 * (l_partkey % 4) ELSE 0e0 END, 3) END AS score FROM s""")
def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution signals with a critique as tie-break; candidates without files score -1."""
    satisfies = F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False)
    score = T.verdict_score(F.col("signal"), F.when(F.col("l_linenumber") == 7, 0).otherwise(1), satisfies, F.col("l_partkey") % 4)
    return _verdicts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY ALL ORDER BY event_id LIMIT 50")
def first_seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user, the earliest 50."""
    return graph.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 50)


_KIND = "CASE event_type WHEN 'click' THEN 'check' WHEN 'view' THEN 'model_call' WHEN 'purchase' THEN 'outcome' ELSE event_type END"


@query(f"SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT user_id) AS runs, sum(event_id)::BIGINT AS seqs, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS latency FROM events GROUP BY ALL")
def trace_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log events written as JSON lines and read again; lines that are no records are passed over."""
    events = cut(corpus.trace(spark, sf_dir))
    folder = f"{spark.sparkContext.getCheckpointDir()}/trace-{uuid.uuid4().hex}"
    repo.write_events(events, folder)
    spark.createDataFrame([("not a record",), ("",), ('{"run_id": "x"}',)], "value string").coalesce(1).write.mode("append").text(folder)
    value = F.expr("cast(data['latency'] AS decimal(18,2))")
    return repo.read_events(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"), F.sum("seq").alias("seqs"), F.round(F.sum(value).cast("double"), 2).alias("latency"))


@query(f"WITH {_SUMMARY} SELECT won_by, resolved, count(*) AS runs, sum(checks)::BIGINT AS checks, sum(attempts)::BIGINT AS attempts FROM s GROUP BY ALL")
def summaries_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries written and read again."""
    summaries = cut(runs.summarize(corpus.trace(spark, sf_dir)))
    folder = f"{spark.sparkContext.getCheckpointDir()}/summaries-{uuid.uuid4().hex}"
    repo.write_summaries(summaries, folder)
    stored = spark.read.schema(summaries.schema).json(folder)
    return stored.groupBy("won_by", "resolved").agg(F.count(F.lit(1)).alias("runs"), F.sum("checks").alias("checks"), F.sum("attempts").cast("long").alias("attempts"))


@query("""SELECT 'p' || l_partkey AS file, count(DISTINCT o_orderkey) AS commits FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY ALL""")
def commits_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported history (orders as commits, parts as files), read and counted by file."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file")).groupBy("o_orderkey").agg(F.array_sort(F.collect_set("file")).alias("files"))
    history = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(members, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("commit"), F.col("o_orderpriority").alias("message"), "files")
    history = cut(history)
    path = f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}"
    history.write.json(path)
    return repo.read_commits(spark, path).select("commit", F.explode("files").alias("file")).groupBy("file").agg(F.count_distinct("commit").alias("commits"))


_TASK = "repair the slow parser of module3"


@query(f"""WITH {_SUMMARY}, tk AS (SELECT run_id, 'repair module' || (run_id::BIGINT % 5) || ' parser ' || CASE WHEN run_id::BIGINT % 2 = 0 THEN 'fast' ELSE 'slow run' || (run_id::BIGINT % 7) END AS task FROM s),
tt AS (SELECT run_id, task, list_distinct({terms_sql('task')}) AS own, list_distinct({terms_sql(chr(39) + _TASK + chr(39))}) AS q FROM tk),
j AS (SELECT run_id, task, round(len(list_intersect(own, q)) / (len(own) + len(q) - len(list_intersect(own, q)))::DOUBLE, 6) AS similarity FROM tt WHERE len(list_intersect(own, q)) > 0),
rk AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, run_id) AS rank FROM j)
SELECT run_id, task, similarity, rank, resolved, won_by, attempts FROM rk JOIN s USING (run_id) WHERE rank <= 3""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The past runs whose tasks are most like a new one, with how they ended."""
    summaries = cut(runs.summarize(corpus.trace(spark, sf_dir)))
    n = F.col("run_id").cast("long")
    task = F.concat(F.lit("repair module"), (n % 5).cast("string"), F.lit(" parser "), F.when(n % 2 == 0, "fast").otherwise(F.concat(F.lit("slow run"), (n % 7).cast("string"))))
    found = memory.similar_runs(summaries, summaries.select("run_id", task.alias("task")), _TASK)
    return found.select("run_id", "task", "similarity", "rank", "resolved", "won_by", F.col("attempts").cast("long").alias("attempts"))
