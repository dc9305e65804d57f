"""The questions asked of an index: search, inspection, impact, exploration, statistics, context under a budget.

Searches and joins run as DataFrame plans; only their top-k rows reach the driver, where the budgeted
selection walks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import budget, graph, lines, retrieval
from spindrift.sources.repo import Index

COUNTED = ("symbols", "files", "edges", "imports", "chunks", "lines", "quality_findings")
SYMBOL = ("id", "qualname", "name", "kind", "file", "start_line", "end_line", "signature", "docstring")


def estimate(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def one_line(row) -> str:
    text = (row.docstring or "").strip()
    return text.split("\n")[0] if text else row.signature


def is_test(file: str, name: str) -> bool:
    low = file.lower()
    return "test" in low.rpartition("/")[2] or "/tests/" in low or name.startswith("test_")


def _rows(df: DataFrame) -> list:
    return df.collect()


# --- lookups ----------------------------------------------------------------------------------


def symbol_by_name(index: Index, qualname: str):
    """Exact qualified name, else the shortest that ends in it."""
    rows = index.symbols.where((F.col("qualname") == qualname) | F.col("qualname").endswith("." + qualname))
    return rows.orderBy(F.desc(F.col("qualname") == qualname), F.length("qualname"), "id").first()


def find_symbol(index: Index, name: str, limit: int = 20) -> DataFrame:
    q = F.col("qualname")
    rows = index.symbols.where((F.col("name") == name) | (q == name) | q.endswith("." + name))
    return rows.orderBy(F.desc(F.col("name") == name), F.length(q), "id").limit(limit)


def find_definition(index: Index, name: str):
    return find_symbol(index, name, 1).first()


def document_symbols(index: Index, file: str) -> DataFrame:
    return index.symbols.where(F.col("file") == file).orderBy("start_line", "id")


def workspace_symbols(index: Index, text: str, limit: int = 30) -> DataFrame:
    """Substring search over names, case-insensitive, the shortest first."""
    like = F.lit(text.lower())
    rows = index.symbols.where(F.lower("qualname").contains(like) | F.lower("name").contains(like))
    return rows.orderBy(F.length("qualname"), "id").limit(limit)


def linked(index: Index, ids: list[int], direction: str = "both") -> DataFrame:
    """Symbols next to any of a few ids: (of, ekind, direction, symbol columns)."""
    ends = graph.both_ways(index.edges).where(F.col("id").isin(ids))
    if direction != "both":
        ends = ends.where(F.col("direction") == direction)
    far = ends.select(F.col("id").alias("of"), F.col("other").alias("id"), F.col("kind").alias("ekind"), "direction")
    return far.join(index.symbols, "id")


def references(index: Index, qualname: str, direction: str = "in") -> DataFrame:
    """Who refers to a symbol ("in"), or what it calls ("out")."""
    own = symbol_by_name(index, qualname)
    ids = [own.id] if own else [-1]
    return linked(index, ids, direction).select("qualname", "file", F.col("ekind").alias("kind"), "signature", "start_line")


def findings(index: Index, file: str | None = None, symbol_id: int | None = None, limit: int = 100) -> DataFrame:
    rows = index.quality_findings
    if symbol_id is not None:
        rows = rows.where(F.col("symbol_id") == symbol_id)
    elif file is not None:
        rows = rows.where(F.col("file") == file)
    return rows.orderBy(T.severity_rank(F.col("severity")), "file", "line_no", "code").limit(limit)


def file_source(index: Index, file: str) -> str:
    """The stored text; without a file row the sources of its symbols."""
    row = index.files.where(F.col("file") == file).select("source").first()
    if row:
        return row.source
    return "\n\n".join(r.source for r in _rows(document_symbols(index, file)))


def _overlap(rows: DataFrame, file: str, start: int, end: int) -> DataFrame:
    return rows.where((F.col("file") == file) & ~((F.col("end_line") < start) | (F.col("start_line") > end)))


def inspect(index: Index, file: str | None = None, symbol: str | None = None, start_line: int | None = None, end_line: int | None = None, radius: int = 2) -> dict:
    """A symbol with its surroundings, a range of a file, or a file's outline."""
    if symbol:
        own = symbol_by_name(index, symbol)
        if own is None:
            return {"ok": False, "error": f"symbol not found: {symbol}"}
        window = lines.line_window(index.lines.where(F.col("file") == own.file), own.start_line, own.end_line, radius)
        return {
            "ok": True, "symbol": {k: own[k] for k in SYMBOL} | {"one_line_summary": one_line(own)},
            "lines": [r.asDict() for r in _rows(window.orderBy("line_no"))],
            "neighbors": [{"qualname": r.qualname, "file": r.file, "kind": r.ekind, "signature": r.signature} for r in _rows(linked(index, [own.id]).orderBy("direction", "id"))],
            "quality_findings": [r.asDict() for r in _rows(findings(index, symbol_id=own.id, limit=50))],
            "chunks": [r.asDict() for r in _rows(_overlap(index.chunks, own.file, own.start_line, own.end_line).orderBy("start_line"))],
        }
    if not file:
        return {"ok": False, "error": "name a file or a symbol"}
    if start_line is not None:
        last = end_line if end_line is not None else start_line
        window = lines.line_window(index.lines.where(F.col("file") == file), start_line, last, radius).orderBy("line_no")
        found = findings(index, file=file).where(F.col("line_no").between(max(1, start_line - radius), last + radius))
        return {"ok": True, "file": file, "lines": [r.asDict() for r in _rows(window)], "quality_findings": [r.asDict() for r in _rows(found)]}
    row = index.files.where(F.col("file") == file).select("line_count", "tokens").first()
    return {
        "ok": True, "file": file, "line_count": row.line_count if row else 0, "tokens": row.tokens if row else 0,
        "symbols": [{k: r[k] for k in SYMBOL} for r in _rows(document_symbols(index, file))],
        "chunks": [r.asDict() for r in _rows(index.chunks.where(F.col("file") == file).drop("text").orderBy("start_line"))],
        "quality_findings": [r.asDict() for r in _rows(findings(index, file=file))],
    }


# --- search -----------------------------------------------------------------------------------


def symbol_hits(index: Index, query: str, top: int = 12) -> DataFrame:
    """symbols with score and rank, from the stored postings."""
    return retrieval.symbol_search(index.symbols, query, top, post=index.symbol_terms, code=index.code_terms)


def chunk_hits(index: Index, query: str, top: int = 12) -> DataFrame:
    """chunks with score and rank, from the stored postings; file and symbol names count twice."""
    asked = index.chunks.sparkSession.createDataFrame([(0, query)], "__q int, __text string")
    docs = index.chunks.select("id", retrieval.chunk_document().alias("__doc"))
    hits = retrieval.chunk_search(docs, asked, "id", "__doc", "__q", "__text", top, index.chunk_terms, index.code_terms, sorted(index.code_terms()(query))).drop("__q")
    return index.chunks.join(hits, "id").orderBy("rank")


def file_hits(index: Index, query: str, top: int = 8) -> DataFrame:
    depth = max(24, 6 * top)
    return retrieval.file_rollup(symbol_hits(index, query, depth), chunk_hits(index, query, depth), "file", top=top).orderBy("rank")


def search_code(index: Index, query: str, top: int = 8) -> dict:
    """Symbols, chunks (their first 12 lines) and files that fit a query."""
    symbols = symbol_hits(index, query, top).orderBy("rank")
    chunks = chunk_hits(index, query, top)
    return {
        "query": query,
        "symbols": [{k: r[k] for k in SYMBOL[1:]} | {"score": r.score, "one_line_summary": one_line(r)} for r in _rows(symbols)],
        "chunks": [{"file": r.file, "start_line": r.start_line, "end_line": r.end_line, "score": r.score, "symbols": r.symbols, "preview": "\n".join(r.text.split("\n")[:12])} for r in _rows(chunks)],
        "files": [{"file": r.file, "score": r.score} for r in _rows(file_hits(index, query, top))],
    }


# --- graph ------------------------------------------------------------------------------------


def explore(index: Index, task: str, rounds: int = 2, anchors: int = 8, limit: int = 40) -> list[dict]:
    """Symbols found by search and from there along edges, the best first, with the edge that led to each."""
    seeds = graph.cut(symbol_hits(index, task, anchors).select("id", "score"))  # a few rows that every hop asks for
    if seeds.isEmpty():
        return []
    found = graph.explore(index.edges, seeds, rounds).orderBy(F.desc("score"), "hops", "id").limit(limit)
    names = index.symbols.select("id", "qualname", "file")
    rows = _rows(found.join(names, "id").join(names.select(F.col("id").alias("origin"), F.col("qualname").alias("from")), "origin", "left").orderBy(F.desc("score"), "hops", "id"))
    return [{"qualname": r.qualname, "file": r.file, "score": r.score / 1000, "hops": r.hops, "via": r.via, "origin": r["from"], "reason": "retrieval anchor" if r.hops == 0 else f"{r.via} edge of {r['from']}"} for r in rows]


def impact(index: Index, file: str | None = None, symbol: str | None = None, hops: int = 2) -> dict:
    """What a change of a symbol or file may touch, and how risky it looks."""
    if symbol:
        own = symbol_by_name(index, symbol)
        if own is None:
            return {"ok": False, "error": f"symbol not found: {symbol}"}
        seeds, target = index.symbols.where(F.col("id") == own.id), {"type": "symbol", "symbol": own.qualname, "file": own.file, "start_line": own.start_line, "end_line": own.end_line}
        found, chunks = findings(index, symbol_id=own.id, limit=50), _overlap(index.chunks, own.file, own.start_line, own.end_line)
    elif file:
        seeds, target = index.symbols.where(F.col("file") == file), {"type": "file", "file": file}
        found, chunks = findings(index, file=file, limit=50), index.chunks.where(F.col("file") == file)
    else:
        return {"ok": False, "error": "name a file or a symbol"}
    ids = seeds.select("id")
    reached = graph.expand(index.edges, ids, hops).select("id").join(index.symbols, "id")
    near = graph.neighbors(index.edges, ids).select(F.col("other").alias("id"), F.col("kind").alias("ekind"), "direction").distinct().join(index.symbols, "id")
    callers = near.where("ekind = 'calls' AND direction = 'in'")
    callees = near.where("ekind = 'calls' AND direction = 'out'")
    around = callers.select(*SYMBOL).unionByName(callees.select(*SYMBOL)).unionByName(reached.select(*SYMBOL)).dropDuplicates(["id"])
    tests = around.where(T.is_test_anywhere(F.col("file"), F.col("name")))
    signals = found.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    one = lambda df, name: df.agg(F.count_distinct("id")).scalar().alias(name)
    risk = graph.risks(signals.select(one(callers, "callers"), one(tests, "tests"), "high", "medium")).first()
    compact = lambda df: [{k: r[k] for k in ("qualname", "file", "kind", "signature", "start_line", "end_line")} for r in _rows(df.dropDuplicates(["id"]).orderBy("id").limit(30))]
    files = around.select("file").unionByName(seeds.select("file")).distinct().orderBy("file").limit(50)
    return {
        "ok": True, "target": target,
        "risk": {"level": risk.risk_level, "score": risk.risk_score, "direct_callers": risk.callers, "relevant_tests": risk.tests, "quality_high": risk.high, "quality_medium": risk.medium},
        "direct_callers": compact(callers), "direct_callees": compact(callees), "inheritance_neighbors": compact(near.where("ekind = 'inherits'")),
        "relevant_tests": compact(tests), "touched_files": [r.file for r in _rows(files)], "expanded_neighbors": compact(reached),
        "chunks": [r.asDict() for r in _rows(chunks.drop("text").orderBy("start_line").limit(12))], "quality_findings": [r.asDict() for r in _rows(found)],
    }


def stats(index: Index) -> dict:
    """Counts, hubs, entry points and hotspots."""
    out: dict = {name: index.tables[name].count() for name in COUNTED}
    records = lambda df: [r.asDict() for r in _rows(df)]
    s, e = index.symbols, index.edges
    entry = graph.entry_points(s, e, graph.looks_like_entry(F.col("name"), F.col("file")), ["file", "start_line"])
    return out | {
        "by_kind": {r.kind: r["count"] for r in _rows(s.groupBy("kind").count().orderBy("kind"))},
        "largest_files": records(s.groupBy("file").agg(F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("symbols"), "file").limit(12)),
        "hubs": records(graph.hubs(s, e).join(s.select("id", "qualname"), "id").select("qualname", "file", "outgoing", "incoming").orderBy(F.desc(F.col("outgoing") + F.col("incoming")), F.desc("incoming"), "qualname")),
        "entrypoints": records(entry.select("qualname", "file", "signature", "outgoing")),
        "quality_hotspots": records(lines.hotspots(index.quality_findings)), "dependency_hotspots": records(graph.file_hotspots(s, e)),
    }


#: What a reader of the manifest may want next, the tool of plans/loops that gives it, and its arguments.
NEXT = (
    ("code for a question", "search_code", {"query": "{task}", "top": 10}),
    ("a symbol in full", "inspect_code", {"symbol": "the name behind a symbol handle"}),
    ("a range of lines", "inspect_code", {"file": "the path behind a file handle", "start_line": 1, "end_line": 80}),
    ("what a change touches", "analyze_impact", {"symbol": "a name", "file": "or a path"}),
    ("what to read for an edit", "get_context", {"task": "{task}", "token_budget": "{budget}"}),
)
WITHOUT_TASK = "entry points, architecture, dependencies, risk and tests"


def attention(index: Index, task: str | None = None, token_budget: int = 8000) -> dict:
    """A map of the whole index in handles, not a dump of it: coverage, architecture, what fits a task, and how to go on."""
    query, numbers = task or WITHOUT_TASK, stats(index)
    symbols = _rows(symbol_hits(index, query, 24).orderBy("rank"))
    chunks = _rows(chunk_hits(index, query, 16))
    files = {r["file"]: {"handle": f"file:{r['file']}", **r} for r in numbers["dependency_hotspots"]}
    for r in numbers["largest_files"]:
        files.setdefault(r["file"], {"handle": f"file:{r['file']}", **r})
    fill = lambda v: {"{task}": task or "a task", "{budget}": token_budget}.get(v, v)
    return {
        "ok": True, "mode": "handles", "task": task, "token_budget": token_budget, "coverage": {k: numbers[k] for k in COUNTED if k != "imports"},
        "architecture": {k: numbers[k] for k in ("entrypoints", "hubs", "dependency_hotspots", "quality_hotspots")},
        "attention": {
            "symbols": [{"handle": f"symbol:{r.qualname}", **{k: r[k] for k in SYMBOL[1:]}, "one_line_summary": one_line(r), "score": r.score} for r in symbols],
            "chunks": [{"handle": f"chunk:{r.id}", "file": r.file, "lines": [r.start_line, r.end_line], "tokens": r.tokens, "score": r.score, "symbols": r.symbols, "quality_summary": ",".join(r.quality_summary)} for r in chunks],
            "files": list(files.values())[:32],
        },
        "navigation": [{"need": need, "tool": tool, "input": {k: fill(v) for k, v in args.items()}} for need, tool, args in NEXT],
        "handles": {"symbol": "symbol:QUALNAME", "file": "file:PATH", "chunk": "chunk:ID, a file and its lines", "lines": "lines:PATH:FIRST-LAST"},
    }


# --- context under a budget -------------------------------------------------------------------

EDIT, PERIPHERY, TESTS = 0.60, 0.30, 0.10
#: Share of the best file's score that a file to edit has at least.
NEAR = 0.5


def excerpt(index: Index, file: str, source: str, first: list[int], limit: int) -> tuple[str, int, list[str]]:
    """A file's head and, symbol by symbol, what fits; a signature at least."""
    parts = [f"# Part of {file}; the rest does not fit."]
    for line in source.splitlines()[:80]:
        s = line.strip()
        if s and not s.startswith(("#", "from ", "import ")):
            break
        parts.append(line)
    rows = _rows(document_symbols(index, file))
    wanted = {i: n for n, i in enumerate(first)}
    rows.sort(key=lambda r: wanted.get(r.id, len(wanted)))
    names: list[str] = []
    for r in rows:
        head = f"\n# --- {r.qualname} lines {r.start_line}-{r.end_line} ---"
        whole, short = f"{head}\n{r.source.rstrip()}", f"{head}\n{r.signature}\n# {one_line(r)}"
        if estimate("\n".join([*parts]) + whole) <= limit:
            parts.append(whole)
            names.append(r.qualname)
            continue
        if not names and estimate("\n".join(parts) + short) <= limit:
            parts.append(short)
            names.append(r.qualname)
        break
    text = "\n".join(parts).rstrip() + "\n"
    return text, estimate(text), names


def _taken(spark, items: list, cost, limit: int, how=budget.greedy_skip) -> tuple[list, int]:
    """The items that a fold of operators/budget takes under a limit, in order, and what they cost."""
    if not items:
        return [], 0
    rows = spark.createDataFrame([(0, n, int(cost(x))) for n, x in enumerate(items)], "g int, rank long, cost long")
    got = _rows(how(rows, ["g"], "cost", limit).select("rank", "used"))
    return [items[n] for n in sorted(r.rank for r in got)], max((r.used for r in got), default=0)


def get_context(index: Index, task: str, token_budget: int = 8000, max_files: int = 3) -> dict:
    """What to read for a task: files to edit, their surroundings, tests, findings, chunks and edges, within the budget."""
    spark = index.symbols.sparkSession
    out: dict = {"task": task, "token_budget": token_budget, "notes": [], "files_to_edit": [], "ranked_symbols": [], "periphery": [], "relevant_tests": [], "quality_signals": [], "relevant_chunks": [], "dependency_edges": []}
    seeds = _rows(symbol_hits(index, task, 24).orderBy("rank"))
    if not seeds:
        return out | {"fits_in": 0, "budget": {}, "notes": ["nothing in the index fits the task"]}
    words = sorted({r[0] for r in spark.range(1).select(F.explode(T.terms(F.lit(task)))).collect()})
    q = F.array(*[F.lit(w) for w in words])
    top = index.symbols.where(F.col("id").isin([r.id for r in seeds[:10]])).select("id", retrieval.matched_terms(q, F.concat_ws(" ", "qualname", "signature", "docstring", "source")).alias("m"))
    matched = {r.id: r.m for r in _rows(top)}
    out["ranked_symbols"] = [{"qualname": r.qualname, "file": r.file, "kind": r.kind, "signature": r.signature, "score": r.score, "matched_terms": matched.get(r.id, []), "why": f"rank {r.rank} of the search"} for r in seeds[:10]]

    # Files to edit: good ones by roll-up, tests only when asked for.
    wants_tests = bool({"test", "tests", "pytest", "spec"} & set(words))
    hits = file_hits(index, task, 12)
    ranked = [r.file for r in _rows(hits) if wants_tests or not is_test(r.file, "")]
    near = {r.file for r in _rows(budget.near_best(hits.withColumn("g", F.lit(0)), ["g"], "score", [F.col("rank")], NEAR))}
    order = [f for f in ranked if f in near] or ranked[:1]
    order = order or list(dict.fromkeys(r.file for r in seeds if wants_tests or not is_test(r.file, r.name)))
    hits_of = {f: [r.id for r in seeds if r.file == f] for f in order}
    limits = {"edit_files": int(token_budget * EDIT), "periphery": int(token_budget * PERIPHERY), "tests": int(token_budget * TESTS), "quality_signals": max(80, int(token_budget * 0.05)), "relevant_chunks": max(120, int(token_budget * 0.10))}
    used = dict.fromkeys(limits, 0)
    chosen: list[str] = []
    for file in order:
        if len(chosen) >= max_files:
            break
        source, mode, names = file_source(index, file), "full", []
        tokens, room = estimate(source), max(300, limits["edit_files"] - used["edit_files"])
        if tokens > room:
            source, tokens, names = excerpt(index, file, source, hits_of.get(file, []), room)
            mode = "excerpt"
            out["notes"].append(f"excerpt of {file} to stay within the budget for files")
        if chosen and used["edit_files"] + tokens > limits["edit_files"]:
            continue
        out["files_to_edit"].append({"path": file, "full_source": source, "tokens": tokens, "mode": mode, "included_symbols": names})
        chosen.append(file)
        used["edit_files"] += tokens

    # Findings near those files: per file up to the first that does not fit.
    names_of = {r.id: r.qualname for r in _rows(index.symbols.where(F.col("file").isin(chosen)).select("id", "qualname"))}
    cost_of = lambda s: estimate(f"{s['file']} {s['line_no']} {s['severity']} {s['code']} {s['message']} {s['symbol'] or ''}")
    for file in chosen:
        near_by = [{"file": r.file, "line_no": r.line_no, "severity": r.severity, "code": r.code, "message": r.message, "symbol": names_of.get(r.symbol_id)} for r in _rows(findings(index, file=file, limit=12))]
        fit, cost = _taken(spark, near_by, cost_of, limits["quality_signals"] - used["quality_signals"], budget.greedy_break)
        out["quality_signals"] += fit
        used["quality_signals"] += cost

    for r in _rows(chunk_hits(index, task, 12)):
        if r.file in chosen:
            continue
        text = r.text if estimate(r.text) <= limits["relevant_chunks"] else "\n".join(r.text.splitlines()[:40])
        if used["relevant_chunks"] + estimate(text) <= limits["relevant_chunks"]:
            out["relevant_chunks"].append({"file": r.file, "start_line": r.start_line, "end_line": r.end_line, "tokens": estimate(text), "score": r.score, "symbols": r.symbols, "quality_summary": ",".join(r.quality_summary), "text": text})
            used["relevant_chunks"] += estimate(text)

    # Around the files: seeds first, then one hop.
    centre = index.symbols.where(F.col("file").isin(chosen)).select("id")
    if centre.isEmpty():
        centre = spark.createDataFrame([(r.id,) for r in seeds], "id long")
    expanded = _rows(graph.expand(index.edges, centre, 1).select("id", F.col("kind").alias("ekind")).join(index.symbols.drop("source"), "id").orderBy("id"))
    score_of = {r.id: r.score for r in seeds}
    relation = {"calls": "caller/callee", "inherits": "inheritance"}
    around = {r.id: (r, "related", r.score) for r in seeds if r.file not in chosen and not is_test(r.file, r.name)}
    for r in expanded:
        if r.file not in chosen and not is_test(r.file, r.name):
            around.setdefault(r.id, (r, relation.get(r.ekind, "graph-neighbor"), score_of.get(r.id, 0.0) + 0.75))
    item = lambda r, rel: {"qualname": r.qualname, "file": r.file, "signature": r.signature, "one_line_summary": one_line(r), "relation": rel}
    weight = lambda x: estimate(x["signature"] + x["one_line_summary"]) + 4
    ordered = [item(r, rel) for r, rel, _ in sorted(around.values(), key=lambda x: -x[2])]
    out["periphery"], used["periphery"] = _taken(spark, ordered, weight, limits["periphery"])
    tests = list({r.id: item(r, "test") for r in [*seeds, *expanded] if is_test(r.file, r.name)}.values())
    out["relevant_tests"], used["tests"] = _taken(spark, tests, weight, limits["tests"])

    names = index.symbols.select("id", "file", "qualname", "start_line")
    touching = graph.touching(names, index.edges, lambda f: f.isin(chosen))
    named = touching.join(names.select(F.col("id").alias("src"), F.col("qualname").alias("from"), "start_line"), "src").join(names.select(F.col("id").alias("dst"), F.col("qualname").alias("to")), "dst")
    rows = _rows(named.orderBy("kind", "src_file", "start_line", "src", "dst").select("from", "to", "kind"))
    out["dependency_edges"] = list({(r["from"], r["to"], r["kind"]): r.asDict() for r in rows}.values())
    edge_cost = lambda e: estimate(f"{e['from']} {e['kind']} {e['to']}") + 2
    used["dependency_edges"] = sum(map(edge_cost, out["dependency_edges"]))

    # Over the budget after all: what matters least goes first, from its end.
    total = sum(used.values())
    # (section, its entry of the budget, what an item that goes gives back)
    sections = (
        ("periphery", "periphery", weight), ("relevant_tests", "tests", weight), ("quality_signals", "quality_signals", lambda s: cost_of(s | {"symbol": None})),
        ("relevant_chunks", "relevant_chunks", lambda c: c["tokens"]), ("dependency_edges", "dependency_edges", edge_cost),
    )
    if total > token_budget:
        items = [(0, name, n, int(price(x))) for name, _, price in sections for n, x in enumerate(out[name])]
        rest = (0, "rest", 0, total - sum(i[3] for i in items))
        rows = budget.trim(spark.createDataFrame([rest, *items], "g int, section string, at long, tokens long"), ["g"], "tokens", [s[0] for s in sections], "at", token_budget)
        gone = _rows(rows.where("NOT kept"))
        for name, key, _ in sections:
            lost = [r for r in gone if r.section == name]
            back = sum(r.tokens for r in lost)
            out[name] = out[name][: len(out[name]) - len(lost)]
            total, used[key] = total - back, max(0, used[key] - back)
            out["notes"] += [f"trimmed {name}"] * len(lost)
    if total > token_budget:
        out["notes"].append("the files to edit alone exceed the budget")
    out["fits_in"] = total
    out["stats"] = {name: index.tables[name].count() for name in COUNTED}
    out["symbol_count"] = out["stats"]["symbols"]
    out["budget"] = {k: {"used": n, "limit": limits.get(k, "included")} for k, n in used.items()} | {"remaining": max(0, token_budget - total)}
    return out


def graph_plan(context: dict, limit: int = 6) -> list[dict]:
    """One step per file to edit."""
    return [{"index": n, "title": f"Edit {f['path']}", "kind": "edit", "target": f["path"]} for n, f in enumerate(context["files_to_edit"][:limit], 1)]
