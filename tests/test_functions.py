import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import parse
from spindrift.functions import text as T
from spindrift.operators import budget, graph, lines, runs


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return row.select(*columns).first()


def test_split_lines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "x\x0cy\u2028z", "é\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == {t: t.splitlines() for t in texts}


@pytest.mark.parametrize("line, role", [
    ("", "blank"), ("  # x", "comment"), ("import a", "import"), ("from a import b", "import"), ("@x", "decorator"), ("async def f():", "definition"), ("class A:", "definition"), ("else:", "control_flow"),
    ("try:", "control_flow"), ("return 1", "return"), ("a = f(x)", "assignment"), ("a == b", "expression"), ("f(x)", "call_or_expression"), ("x == f(", "call_or_expression"), ("pass", "expression"), ("importx", "expression"),
])
def test_roles(spark, line, role):
    assert one(spark, T.line_role(F.col("t")), t=line)[0] == role


@pytest.mark.parametrize("line, no, codes", [
    ("x" * 121, 1, ["long_line"]), ("x" * 120, 1, []), ("# todo x", 1, ["todo"]), ("y = 'TODO'", 1, []), ("  print(x)", 1, ["debug_print"]), ("x = eval(y)", 1, ["dynamic_exec"]), ("x = 'eval(y)'", 1, []),
    ("except:", 1, ["broad_except"]), ("except Exception:", 1, ["broad_except"]), ("except ValueError:", 1, []), ("API_KEY = 'x'", 1, ["possible_secret"]), ("secret_terms = ['x']", 1, []), ("token = 5", 1, []),
    ("password: = \"x\"", 1, ["possible_secret"]), ("assert False", 1, ["assert_false"]), ("#!/bin/sh", 1, ["non_python_shebang"]), ("#!/bin/sh", 2, []), ("#!/usr/bin/python", 1, []),
])
def test_rules(spark, line, no, codes):
    assert one(spark, T.finding_codes(F.col("t"), F.col("n")), t=line, n=no)[0] == codes


def test_long_quoted_strings_need_no_stack(spark):
    assert one(spark, T.finding_codes(F.col("t"), F.lit(2)), t="x = '" + "a\\'" * 200_000 + "'")[0] == ["long_line"]


def test_terms(spark):
    got = one(spark, T.terms(F.col("t")), t="HTTPServer_run the userID2 _x größe")[0]
    assert got == ["http", "server", "run", "httpserver_run", "user", "id", "2", "userid2", "x", "_x", "gr", "gr", "e", "e"]
    assert one(spark, T.terms(F.col("t")), t=None)[0] == []


@pytest.mark.parametrize("rel, out", [("a/b.py", "/r/a/b.py"), ("./a//b", "/r/a/b"), ("a/../b", "/r/b"), ("..", None), ("a/../../b", None), ("/etc/x", None), ("C:/x", None), ("", None), (".", "/r"), ("a/../..", None), ("../r/a", None)])
def test_safe_path(spark, rel, out):
    assert one(spark, T.safe_path(F.lit("/r"), F.col("t")), t=rel)[0] == out


def test_reasoning_and_blocks(spark):
    strip = lambda t: one(spark, T.strip_reasoning(F.col("t")), t=t)[0]
    assert strip("<think>a\nb</think> c ") == "c" and strip("a</think>b") == "b" and strip("c") == "c" and strip("<think>c") == "c"
    got = one(spark, T.file_blocks(F.col("t")), t="FILE: a.py \n```python\nx = 1\n```\nand\nFILE: b/c.js\n```\ny\n```")[0]
    assert [(b.path, b.code) for b in got] == [("a.py", "x = 1\n"), ("b/c.js", "y\n")]


def test_signals(spark):
    f = lambda *v: one(spark, T.exec_signal(*[F.lit(x) for x in v]), t="")[0]
    assert f(False, True, True, True) == 0 and f(True, True, True, True) == 3 and f(True, True, False, False) == 0.25 and one(spark, T.exec_signal(F.lit(True), F.lit(False), F.lit(False), F.lit(None).cast("boolean")), t="")[0] == 1
    assert one(spark, T.verdict_score(F.lit(1.0), F.lit(0), F.lit(True), F.lit(0)), t="")[0] == -1
    assert one(spark, T.verdict_score(F.lit(1.0), F.lit(1), F.lit(False), F.lit(2)), t="")[0] == 0.9
    assert one(spark, T.risk_level(T.risk_score(F.lit(9), F.lit(9), F.lit(9), F.lit(9))), t="")[0] == "high"


def test_parsers():
    assert parse.balanced_objects('a {"b": {"c": 1}} } {d}') == ['{"b": {"c": 1}}', "{d}"]
    assert parse.tool_call('{"tool": "a"} then {"name": "b", "arguments": {"x": 1}}') == {"tool": "b", "args": {"x": 1}}
    assert parse.tool_call('go(x="a, b", y=2)') == {"tool": "go", "args": {"x": "a, b", "y": "2"}}
    assert parse.tool_call("nothing") is None and parse.tool_call(None) is None
    steps = parse.plan_steps('sure: [{"title": "t", "kind": "investigate", "target": "f"}, 3]', "task")
    assert steps == [{"index": 1, "title": "t", "detail": "t", "kind": "investigate", "target": "f"}]
    assert parse.plan_steps('{"steps": [{"title": "u"}]}', "task")[0]["title"] == "u" and parse.plan_steps("?", "task")[0]["title"] == "task"
    assert parse.test_summary("2 passed, 1 failed", 1) == {"ran": True, "passed": 2, "failed": 1}
    assert not parse.test_summary("no tests ran", 5)["ran"] and not parse.test_summary("", 0)["ran"]
    assert parse.closest("serch", ["search", "plan"]) == "search" and parse.closest("zzz", ["search"]) is None
    assert parse.compile_error("a.py", "x = (") and parse.compile_error("a.py", "x = 1") is None and parse.compile_error("a.js", "{") == "unbalanced braces" and parse.compile_error("a.js", " ") == "empty file"
    assert "+b\n" in parse.unified_diff("f", "a\n", "b\n")
    with pytest.raises(parse.ArgumentError):
        parse.coerce("n", "integer", "x")


def test_parser_columns(spark):
    df = spark.createDataFrame([("a.py", "x=1", '{"tool": "t", "args": {"k": 2}}'), ("b.py", "x=", "none")], "p string, c string, t string")
    rows = df.select(parse.tool_call_udf()("t").alias("t"), parse.compile_udf()("p", "c").alias("e"), parse.diff_udf()("p", F.lit("x\n"), "c").alias("d")).collect()
    assert rows[0].t.tool == "t" and rows[0].t.args == {"k": "2"} and rows[0].e is None and rows[1].t.tool is None and rows[1].e and "-x" in rows[0].d


@pytest.mark.parametrize("n", [0, 1, 12, 13, 21, 22, 100])
def test_chunk_cover(spark, n):
    spans = [(s.start, s.end) for s in one(spark, lines.chunk_spans(F.col("n"), 12, 3), n=n)[0]]
    assert sorted({i for s, e in spans for i in range(s, e + 1)}) == list(range(1, n + 1))
    assert all(b[0] == a[1] - 2 for a, b in zip(spans, spans[1:])) and all(e - s < 12 for s, e in spans)


def test_owner_of_long_spans(spark):
    spans = spark.createDataFrame([("f", "all", 1, 1000), ("f", "in", 100, 300), ("f", "tie", 100, 300), ("f", "dot", 150, 150)], "file string, owner string, s long, e long")
    points = spark.createDataFrame([("f", i) for i in (1, 99, 100, 150, 300, 301, 1000, 1001)] + [("g", 5)], "file string, at long")
    got = {(r.file, r.at): r.owner for r in lines.owners(points, spans, ["file"], "at", "s", "e", "owner").collect()}
    assert got == {("f", 1): "all", ("f", 99): "all", ("f", 100): "in", ("f", 150): "dot", ("f", 300): "in", ("f", 301): "all", ("f", 1000): "all", ("f", 1001): None, ("g", 5): None}


def test_budgets(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([50, 70, 40, 60, 10, 1], 1)], "g string, rank long, c int")
    assert [r["rank"] for r in budget.greedy_skip(rows, ["g"], "c", 100).orderBy("rank").collect()] == [1, 3, 5]
    assert [r["rank"] for r in budget.greedy_break(rows, ["g"], "c", 100).orderBy("rank").collect()] == [1]
    items = spark.createDataFrame([("a", "edit", 1, 90), ("a", "quality", 1, 5), ("a", "periphery", 1, 5), ("a", "periphery", 2, 5)], "g string, section string, at int, c int")
    kept = {(r.section, r["at"]) for r in budget.trim(items, ["g"], "c", ["periphery", "quality"], "at", 100).where("kept").collect()}
    assert kept == {("edit", 1), ("quality", 1), ("periphery", 1)}
    assert budget.trim(items, ["g"], "c", ["periphery", "quality"], "at", 1).where("kept").collect()[0].section == "edit"


def test_expansion(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "inherits"), ("e", "b", "inherits"), ("a", "a", "calls")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    got = {r.id: (r.depth, r.kind) for r in graph.expand(edges, seeds, 2).collect()}
    assert got == {"b": (1, "calls"), "c": (2, "calls"), "e": (2, "inherits")}
    assert graph.expand(edges, seeds, 9).count() == 4


def test_runs(spark):
    events = [("r", 1, 0.5, "check", {"ok": "false"}), ("r", 2, 1.0, "model_call", {"latency": "0.25"}), ("r", 3, 1.5, "check", {"ok": "True"}), ("r", 4, 2.0, "outcome", {"resolved": "true", "won_by": "repair", "attempts": "2", "files": "a,b"}), ("s", 1, 0.0, "note", {})]
    df = runs.summarize(spark.createDataFrame(events, runs.EVENT_SCHEMA))
    got = {r.run_id: r for r in df.collect()}
    assert got["r"].checks == 2 and got["r"].checks_passed == 1 and got["r"].resolved and got["r"].files == ["a", "b"] and got["r"].attempts == 2 and got["r"].model_latency_s == 0.25
    assert got["s"].won_by == "" and not got["s"].resolved and got["s"].event_counts == {"note": 1}
    stats = runs.memory_stats(df).first()
    assert (stats.runs, stats.resolved, stats.resolved_rate, stats.avg_attempts_on_win) == (2, 1, 0.5, 2.0)
    assert runs.memory_stats(df.limit(0)).first().runs == 0
    records = spark.createDataFrame([('{"name": "x", "age": 3}',), ('{"age": "y"}',), ("[1]",), (None,)], "r string")
    assert [r[0] for r in records.select(runs.schema_errors("r", {"name": "string", "age": "integer"})).collect()] == [[], ["missing key: name", "age is no integer"], ["not a record"], ["not a record"]]


def test_stream_matches_batch(spark, tmp_path):
    from spindrift.streaming import trace

    rows = [{"run_id": f"r{i % 3}", "seq": i, "t": float(i), "kind": "check" if i % 2 else "note", "data": {"ok": str(i % 4 == 1)}, "at": f"2024-01-01T00:{i:02d}:00"} for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows[:20])) + "\n\nnot json\n")
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, rows[20:])))
    query = trace.counts(trace.read(spark, str(tmp_path / "in")).where("kind IS NOT NULL")).writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.run_id, str(r.window.start), r.kind): (r.n, r.passed) for r in spark.table("counted").collect()}
    batch = spark.read.schema(trace.STREAM_SCHEMA).json(str(tmp_path / "in")).where("kind IS NOT NULL")
    want = {(r.run_id, str(r.window.start), r.kind): (r.n, r.passed) for r in trace.counts(batch).collect()}
    assert got and got.items() <= want.items() and all(k[1] < "2024-01-01 00:30" for k in got)
