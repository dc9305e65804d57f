from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import runs
from spindrift.plans import memory, render
from spindrift.sources import repo
from spindrift.sources.runlog import RunLog


def log(run, ticks, outcome):
    clock = iter(ticks)
    out = RunLog(run, lambda: next(clock))
    out.phase("start")
    out.model_call(0.12345, "plan")
    out.check(False, 0.5, 1)
    out.repair("x" * 900)
    out.check(True, 2.0, 2)
    out.outcome(**outcome)
    return out


def test_log_memory_and_hint(spark, tmp_path):
    folder = str(tmp_path / "runs")
    logs = [
        log("a", range(10), {"resolved": True, "won_by": "repair", "attempts": 2, "files": ["auth.py", "api.py"]}),
        log("b", range(10), {"resolved": True, "won_by": "repair", "attempts": 1, "files": ["api.py", "auth.py"]}),
        log("c", range(10), {"resolved": False, "files": ["x.py"]}),
    ]
    first = logs[0].close(spark, folder)
    assert first["run_id"] == "a" and first["checks"] == 2 and first["checks_passed"] == 1 and first["model_latency_s"] == 0.123 and first["files"] == ["auth.py", "api.py"]
    for x in logs[1:]:
        x.close(spark, folder)
    (tmp_path / "runs" / "broken.json").write_text("\nnot json\n")
    events = repo.read_events(spark, folder)
    assert events.count() == 18 and max(len(r.data.get("feedback", "")) for r in events.collect()) == 500
    summaries = runs.summarize(events)
    stats = runs.memory_stats(summaries).first()
    assert (stats.runs, stats.resolved, stats.resolved_rate, stats.avg_attempts_on_win) == (3, 2, 0.667, 1.5)
    assert [(r.won_by, r.wins) for r in runs.wins_by_layer(summaries).collect()] == [("repair", 2)]
    tasks = spark.createDataFrame([("a", "fix the login limiter"), ("b", "fix login page"), ("c", "draw a chart")], "run_id string, task string")
    got = memory.recall(summaries, tasks, "login limiter breaks")
    assert [s["task"] for s in got["similar_tasks"]] == ["fix the login limiter", "fix login page"]
    assert got["suggested_files"] == ["api.py", "auth.py"] and got["suggested_approach"] == "repair" and got["co_changes"] == [{"files": ["api.py", "auth.py"], "count": 2}]
    assert memory.hint(summaries, tasks, "login").startswith("## Past runs") and memory.hint(summaries, tasks, "zzz") == ""
    assert "model_call" in render.timeline([r.asDict() for r in events.where("run_id = 'a'").collect()])


def test_plan_names_files(spark):
    df = spark.createDataFrame([("edit src/api.py", "src/api.py"), ("edit api", "src/api.py"), ("edit auth", "src/api.py")], "t string, f string")
    assert [r[0] for r in df.select(T.mentions_file(F.col("t"), F.col("f"))).collect()] == [True, True, False]
