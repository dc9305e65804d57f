"""What past runs suggest for a new task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import runs
from spindrift.plans import render


def similar_runs(summaries: DataFrame, tasks: DataFrame, task: str, top: int = 3) -> DataFrame:
    """Summaries of the runs whose task (run_id, task) shares most terms with this one."""
    asked = summaries.sparkSession.createDataFrame([(0, task)], "__q int, __text string")
    near = runs.similar(asked, "__q", "__text", tasks, "run_id", "task", top).drop("__q")
    return near.join(tasks, "run_id").join(summaries, "run_id").orderBy("rank")


def recall(summaries: DataFrame, tasks: DataFrame, task: str, top: int = 3) -> dict:
    """Similar tasks, the files and the approach of those that were solved, and files that change together."""
    rows = similar_runs(summaries, tasks, task, top).collect()
    solved = [r for r in rows if r.resolved]
    count = lambda items: sorted({x: items.count(x) for x in items}.items(), key=lambda p: (-p[1], p[0]))
    files, ways = count([f for r in solved for f in r.files]), count([r.won_by for r in solved])
    together = runs.co_changes(summaries.where("resolved").select("run_id", F.explode("files").alias("file")), "run_id", "file")
    return {
        "similar_tasks": [{"task": r.task, "resolved": r.resolved, "won_by": r.won_by, "files": r.files, "similarity": round(r.similarity, 3)} for r in rows],
        "suggested_files": [f for f, _ in files[:5]], "suggested_approach": ways[0][0] if ways else None,
        "co_changes": [{"files": [r.a, r.b], "count": r["count"]} for r in together.orderBy(F.desc("count"), "a", "b").limit(50).collect()],
    }


def hint(summaries: DataFrame, tasks: DataFrame, task: str) -> str:
    got = recall(summaries, tasks, task)
    return render.hint(got["similar_tasks"], got["suggested_files"], got["suggested_approach"])
