"""python -m spindrift.cli COMMAND …: the questions of an index on the command line, answers as JSON or Markdown."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions import parse
from spindrift.operators import retrieval, runs
from spindrift.plans import context, loops, render
from spindrift.sources import repo


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spindrift")
    out.add_argument("--index", help="folder of the stored index")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> None:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        for o, default in options.items():
            sub.add_argument("--" + o.replace("_", "-"), default=default, type=type(default) if default is not None else str)

    command("index", "root")
    command("stats", "root")
    command("search", "root", "query", top=8)
    command("impact", "root", file=None, symbol=None, hops=2)
    command("inspect", "root", file=None, symbol=None)
    command("context", "root", "task", budget=8000, format="json")
    command("attention", "root", "task")
    command("explore", "root", "task", rounds=2)
    command("rank-lines", "root", "file", "query", top=5)
    command("plan", "root", "task")
    command("tool", "root", "call")
    command("tools", "root")
    command("verify", "path")
    command("trace", "folder")
    command("memory", "folder")
    return out


def answer(spark: SparkSession, args: argparse.Namespace) -> object:
    if args.command == "verify":
        with open(args.path, encoding="utf-8") as f:
            return {"error": parse.compile_error(args.path, f.read())}
    if args.command == "trace":
        return render.timeline([r.asDict() for r in repo.read_events(spark, args.folder).collect()])
    if args.command == "memory":
        summaries = runs.summarize(repo.read_events(spark, args.folder))
        return repo.to_json_rows(runs.memory_stats(summaries))[0] | {"wins_by_layer": {r.won_by: r.wins for r in runs.wins_by_layer(summaries).collect()}}
    index = repo.open_index(spark, args.root, args.index, reindex=args.command == "index")
    if args.command == "rank-lines":
        return retrieval.rank_lines(index.lines.where(F.col("file") == args.file), args.query, args.top)
    if args.command == "tool":
        call = parse.tool_call(args.call)
        return loops.index_tools(index).run(call["tool"], call["args"]) if call else {"error": "no tool call"}
    if args.command == "tools":
        return loops.index_tools(index).specs()
    if args.command == "context":
        found = context.get_context(index, args.task, args.budget)
        return found if args.format == "json" else render.dossier(found)
    return {
        "index": lambda: {n: index.tables[n].count() for n in repo.TABLES},
        "stats": lambda: context.stats(index),
        "search": lambda: context.search_code(index, args.query, args.top),
        "impact": lambda: context.impact(index, args.file, args.symbol, args.hops),
        "inspect": lambda: context.inspect(index, args.file, args.symbol),
        "attention": lambda: context.attention(index, args.task),
        "explore": lambda: context.explore(index, args.task, args.rounds),
        "plan": lambda: context.graph_plan(context.get_context(index, args.task)),
    }[args.command]()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    got = answer(spark, args)
    print(got if isinstance(got, str) else json.dumps(got, indent=2, default=str))


if __name__ == "__main__":
    main()
