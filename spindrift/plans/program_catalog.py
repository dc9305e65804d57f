"""Named queries over the derived program: extraction, resolution, search, inspection, impact, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import extract, graph, retrieval
from spindrift.plans import context, program
from spindrift.plans.catalog import FOUND_SQL, ROLE_SQL, query, terms_sql
from spindrift.plans.program import CHUNK, OVERLAP
from spindrift.sources import repo

P = "WITH " + program.SQL
_ST = ", st AS (SELECT *, regexp_replace(txt, '^\\s+|\\s+$', '', 'g') AS s FROM pl)"
_FOUND = _ST + FOUND_SQL[FOUND_SQL.index(",\nmasked AS"):].replace("doc_id, ", "")
_OWN = ", own AS (SELECT l.file, line_no, arg_min(id, (end_line - start_line, start_line)) AS owner FROM pl l JOIN ps s ON s.file = l.file AND line_no BETWEEN start_line AND end_line GROUP BY ALL)"
_CHUNKS = f""", pn AS (SELECT file, count(*) AS n FROM pl GROUP BY ALL),
pw AS (SELECT file, n, unnest(range(0, 1 + ceil(greatest(0, n - {CHUNK}) / {CHUNK - OVERLAP}e0)::BIGINT)) * {CHUNK - OVERLAP} + 1 AS start_line FROM pn),
pspan AS (SELECT file, start_line, least(n, start_line + {CHUNK - 1}) AS end_line FROM pw),
pc AS (SELECT c.file, c.start_line, c.end_line, string_agg(txt, chr(10) ORDER BY line_no) AS text FROM pspan c JOIN pl l ON l.file = c.file AND line_no BETWEEN c.start_line AND c.end_line GROUP BY ALL),
pcs AS (SELECT c.file, c.start_line, string_agg(qualname, ',' ORDER BY qualname) AS symbols FROM pspan c JOIN ps s ON s.file = c.file AND NOT (c.end_line < s.start_line OR c.start_line > s.end_line) GROUP BY ALL),
pcf AS (SELECT c.file, c.start_line, string_agg(DISTINCT code, ',' ORDER BY code) AS flags FROM pspan c JOIN found l ON l.file = c.file AND line_no BETWEEN c.start_line AND c.end_line GROUP BY ALL),
chunk AS (SELECT row_number() OVER (ORDER BY pc.file, pc.start_line) AS id, pc.*, (length(text) // 4)::BIGINT AS quarter, coalesce(symbols, '') AS symbols, coalesce(flags, '') AS flags FROM pc LEFT JOIN pcs USING (file, start_line) LEFT JOIN pcf USING (file, start_line))"""


# --- extraction -------------------------------------------------------------------------------


def _extracted(spark, sf_dir):
    return extract.extract(program.files(spark, sf_dir))


@query(P + " SELECT file, qualname, name, kind, start_line, end_line, signature, docstring FROM ps")
def program_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files in five languages."""
    long = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return extract.symbol_rows(_extracted(spark, sf_dir)).select("file", "qualname", "name", "kind", *long, "signature", "docstring")


@query(P + " SELECT src, ref, kind FROM pr")
def program_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and bases as they are written."""
    return extract.references(extract.symbol_rows(_extracted(spark, sf_dir)), ("qualname",)).withColumnRenamed("src_name", "src")


@query(P + " SELECT file, module, name, alias FROM pi")
def program_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(_extracted(spark, sf_dir)).select("file", "module", "name", "alias")


@query(P + " SELECT file, (SELECT count(*) FROM pl WHERE pl.file = pf.file) AS line_count, greatest(1, length(source) // 4)::BIGINT AS tokens FROM pf")
def program_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.file_table(_extracted(spark, sf_dir)).select("file", "line_count", "tokens")


@query(P + " SELECT DISTINCT src, dst, kind FROM pe")
def edge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as edges: exact and suffix names, self, aliases, the own module, terminal names; without loops and repeats."""
    index = program.index(spark, sf_dir)
    names = index.symbols.select("id", "qualname")
    rows = index.edges.join(names.select(F.col("id").alias("src"), F.col("qualname").alias("s")), "src").join(names.select(F.col("id").alias("dst"), F.col("qualname").alias("d")), "dst")
    return rows.select(F.col("s").alias("src"), F.col("d").alias("dst"), "kind")


# --- lines, findings, chunks ------------------------------------------------------------------


@query(P + _ST + _OWN + f" SELECT st.file, st.line_no, {ROLE_SQL} AS role, qualname AS owner FROM st LEFT JOIN own USING (file, line_no) LEFT JOIN ps ON ps.id = owner")
def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and innermost symbol of every line."""
    index = program.index(spark, sf_dir)
    return index.lines.join(index.symbols.select(F.col("id").alias("owner_symbol_id"), F.col("qualname").alias("owner")), "owner_symbol_id", "left").select("file", "line_no", "role", "owner")


@query(P + _FOUND + _OWN + " SELECT found.file, found.line_no, severity, code, qualname AS symbol FROM found LEFT JOIN own USING (file, line_no) LEFT JOIN ps ON ps.id = owner")
def program_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings with the symbol that holds them."""
    index = program.index(spark, sf_dir)
    names = index.symbols.select(F.col("id").alias("symbol_id"), F.col("qualname").alias("symbol"))
    return index.quality_findings.join(names, "symbol_id", "left").select("file", "line_no", "severity", "code", "symbol")


@query(P + _FOUND + _CHUNKS + " SELECT file, start_line, end_line, greatest(1, quarter) AS tokens, symbols, flags FROM chunk")
def program_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the symbols they reach and the rules broken in them."""
    rows = program.index(spark, sf_dir).chunks
    return rows.select("file", "start_line", "end_line", "tokens", F.array_join("symbols", ",").alias("symbols"), F.array_join("quality_summary", ",").alias("flags"))


# --- search -----------------------------------------------------------------------------------

TASK = "visit customer 17 rate of nation open_door token"
_Q = f"qt AS (SELECT unnest({terms_sql(chr(39) + TASK + chr(39))}) AS term), q AS (SELECT term, count(*) AS qc FROM qt GROUP BY ALL), ql AS (SELECT list(term) AS q, count(*) AS nq FROM q)"
_TEXT = ", sym AS (SELECT ps.*, (SELECT string_agg(replace(txt, '  # TODO', ''), chr(10) ORDER BY line_no) FROM pl WHERE pl.file = ps.file AND line_no BETWEEN start_line AND end_line) AS source FROM ps)"


def _bm25_sql(name: str, docs: str, parts: list[tuple[str, int]]) -> str:
    """CTEs ending in {name}(id, bm25, matched) of the one query q."""
    union = " UNION ALL ".join(f"SELECT id, unnest({terms_sql(f'coalesce({c}, {chr(39) * 2})')}) AS term, {w} AS w FROM {docs}" for c, w in parts)
    return f""", {name}_p AS (SELECT id, term, sum(w) AS tf FROM ({union}) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY ALL), {name}_dl AS (SELECT id, sum(tf) AS dl FROM {name}_p GROUP BY ALL),
{name}_one AS (SELECT (SELECT count(*) FROM {docs}) AS n, ((SELECT sum(dl) FROM {name}_dl) + (SELECT count(*) FROM {docs}) - (SELECT count(*) FROM {name}_dl))::DOUBLE / (SELECT count(*) FROM {docs}) AS avg_dl),
{name} AS (SELECT id, count(*) AS matched, sum(qc * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 2.4e0) / (tf + 1.4e0 * (1e0 - 0.72e0 + 0.72e0 * dl / avg_dl))) AS bm25
  FROM {name}_p JOIN q USING (term) JOIN {name}_df USING (term) JOIN {name}_dl USING (id), {name}_one GROUP BY ALL)"""


_FIELDS = " + ".join(f"{w}e0 * len(list_intersect(list_distinct({terms_sql(f)}), q)) / nq" for f, w in retrieval.FIELD_WEIGHTS.items())
_SEARCH = _TEXT + ", " + _Q + _bm25_sql("sb", "sym", list(retrieval.DOCUMENT_WEIGHTS.items())) + f""",
sscore AS (SELECT sym.id, file, qualname, name, round((coalesce(bm25, 0e0) + {_FIELDS}
  + 2e-1 * len(list_filter(string_split(lower('{TASK}'), ' '), lambda w: length(w) >= 4 AND (contains(lower(file), w) OR contains(lower(qualname), w) OR contains(lower(signature), w)))))
  * (1e0 + coalesce(matched, 0) / nq::DOUBLE), 6) AS score FROM sym LEFT JOIN sb USING (id), ql),
shit AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sscore WHERE score > 0)"""
_CSEARCH = ", cdoc AS (SELECT id, file, start_line, concat_ws(' ', file, file, replace(symbols, ',', ' '), replace(symbols, ',', ' '), replace(flags, ',', ' '), text) AS doc FROM chunk)" + _bm25_sql("cb", "cdoc", [("doc", 1)]) + """,
chit AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, file, start_line, round(bm25 * (1e0 + matched / nq::DOUBLE), 6) AS score FROM cb JOIN cdoc USING (id), ql))"""


@query(P + _SEARCH + " SELECT qualname, score, rank FROM shit WHERE rank <= 20")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best symbols for a task: weighted fields, boosts for fields and substrings, coverage."""
    return context.symbol_hits(program.index(spark, sf_dir), TASK, 20).select("qualname", "score", "rank")


@query(P + _FOUND + _CHUNKS + _SEARCH + _CSEARCH + " SELECT file, start_line, score, rank FROM chit WHERE rank <= 12")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.chunk_hits(program.index(spark, sf_dir), TASK, 12).select("file", "start_line", "score", "rank")


_ROLLUP = """, part AS (SELECT file, score / pow(rank, 35e-2) AS p FROM shit WHERE rank <= 48 UNION ALL SELECT file, 65e-2 * score / pow(rank, 35e-2) FROM chit WHERE rank <= 48),
fhit AS (SELECT *, row_number() OVER (ORDER BY score DESC, file) AS rank FROM (SELECT file, round(sum(p), 6) AS score FROM part GROUP BY ALL))"""


@query(P + _FOUND + _CHUNKS + _SEARCH + _CSEARCH + _ROLLUP + " SELECT file, score, rank FROM fhit WHERE rank <= 8")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from their symbols and chunks."""
    return context.file_hits(program.index(spark, sf_dir), TASK, 8).select("file", "score", "rank")


# --- lookups ----------------------------------------------------------------------------------


@query(P + """, w AS (SELECT unnest(['rate_3', 'n2.rate_2', 'Nation1', 'geo.n1.Nation1.log', 'log', 'nothing']) AS asked),
hit AS (SELECT asked, qualname, row_number() OVER (PARTITION BY asked ORDER BY qualname = asked DESC, length(qualname), id) AS r FROM w JOIN ps ON qualname = asked OR ends_with(qualname, '.' || asked))
SELECT asked, qualname FROM hit WHERE r = 1""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by exact or dotted-suffix name."""
    index = program.index(spark, sf_dir)
    found = [(w, context.symbol_by_name(index, w)) for w in ("rate_3", "n2.rate_2", "Nation1", "geo.n1.Nation1.log", "log", "nothing")]
    return spark.createDataFrame([(w, r.qualname) for w, r in found if r], "asked string, qualname string")


@query(P + """, h AS (SELECT *, row_number() OVER (ORDER BY name = 'log' DESC, length(qualname), id) AS r FROM ps WHERE name = 'log' OR qualname = 'log' OR ends_with(qualname, '.log'))
SELECT qualname, file, signature, r AS place FROM h WHERE r <= 20""")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by name, the shortest first."""
    rows = context.find_symbol(program.index(spark, sf_dir), "log").select("qualname", "file", "signature").collect()  # at most 20
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows, 1)], "qualname string, file string, signature string, place long")


@query(P + " SELECT qualname, start_line, signature FROM ps WHERE file = 'geo/n4.py'")
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.document_symbols(program.index(spark, sf_dir), "geo/n4.py").select("qualname", F.col("start_line").cast("long").alias("start_line"), "signature")


@query(P + " SELECT qualname, file FROM ps WHERE contains(lower(qualname), 'ation1') OR contains(lower(name), 'ation1') ORDER BY length(qualname), id LIMIT 30")
def symbols_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.workspace_symbols(program.index(spark, sf_dir), "Ation1").select("qualname", "file")


@query(P + """ SELECT 'in' AS direction, s.qualname, s.file, pe.kind, s.signature, s.start_line FROM pe JOIN ps s ON s.qualname = src WHERE dst = 'geo.n2.rate_2'
UNION ALL SELECT 'out', s.qualname, s.file, pe.kind, s.signature, s.start_line FROM pe JOIN ps s ON s.qualname = dst WHERE src = 'geo.n2.rate_2'""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to a symbol, and what it calls."""
    index = program.index(spark, sf_dir)
    sides = [context.references(index, "geo.n2.rate_2", d).withColumn("direction", F.lit(d)) for d in ("in", "out")]
    return sides[0].unionByName(sides[1]).withColumn("start_line", F.col("start_line").cast("long"))


@query(P + _FOUND + _OWN + """, f AS (SELECT found.*, owner FROM found LEFT JOIN own USING (file, line_no))
SELECT 'file' AS asked, line_no, code FROM f WHERE file = 'shop/c7.py' UNION ALL SELECT 'symbol', line_no, code FROM f JOIN ps ON ps.id = owner WHERE qualname = 'geo.n1.twice_1'""")
def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a file and of a symbol, the worst first."""
    index = program.index(spark, sf_dir)
    own = context.symbol_by_name(index, "geo.n1.twice_1")
    rows = context.findings(index, file="shop/c7.py").withColumn("asked", F.lit("file")).unionByName(context.findings(index, symbol_id=own.id).withColumn("asked", F.lit("symbol")))
    return rows.select("asked", "line_no", "code")


# --- inspection, impact, exploration, statistics -----------------------------------------------


@query(P + _FOUND + _OWN + _CHUNKS + """, me AS (SELECT * FROM ps WHERE qualname = 'geo.n1.Nation1')
SELECT 'line' AS section, l.line_no AS place, l.txt AS what FROM me JOIN pl l ON l.file = me.file AND line_no BETWEEN me.start_line - 2 AND me.end_line + 2
UNION ALL SELECT 'neighbor', 0, o.qualname || ' ' || pe.kind FROM pe JOIN ps o ON o.qualname = dst WHERE src = 'geo.n1.Nation1'
UNION ALL SELECT 'neighbor', 0, o.qualname || ' ' || pe.kind FROM pe JOIN ps o ON o.qualname = src WHERE dst = 'geo.n1.Nation1'
UNION ALL SELECT 'finding', found.line_no, code FROM me JOIN own ON own.owner = me.id JOIN found ON found.file = own.file AND found.line_no = own.line_no
UNION ALL SELECT 'chunk', c.start_line, c.symbols FROM me JOIN chunk c ON c.file = me.file AND NOT (c.end_line < me.start_line OR c.start_line > me.end_line)
UNION ALL SELECT 'outline', start_line, signature FROM ps WHERE file = 'lib/s3.rb'
UNION ALL SELECT 'size', (SELECT count(*) FROM pl WHERE file = 'lib/s3.rb'), (SELECT greatest(1, length(source) // 4)::VARCHAR FROM pf WHERE file = 'lib/s3.rb')
UNION ALL SELECT 'range', line_no, code FROM found WHERE file = 'shop/c7.py' AND line_no BETWEEN 14 AND 18""")
def inspect_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol with its surroundings, a file's outline, the findings of a range."""
    index = program.index(spark, sf_dir)
    one, file, part = context.inspect(index, symbol="geo.n1.Nation1"), context.inspect(index, file="lib/s3.rb"), context.inspect(index, file="shop/c7.py", start_line=16, end_line=16)
    rows = [("line", r["line_no"], r["text"]) for r in one["lines"]] + [("neighbor", 0, f"{r['qualname']} {r['kind']}") for r in one["neighbors"]]
    rows += [("finding", r["line_no"], r["code"]) for r in one["quality_findings"]] + [("chunk", r["start_line"], ",".join(r["symbols"])) for r in one["chunks"]]
    rows += [("outline", r["start_line"], r["signature"]) for r in file["symbols"]] + [("size", file["line_count"], str(file["tokens"]))] + [("range", r["line_no"], r["code"]) for r in part["quality_findings"]]
    return spark.createDataFrame(rows, "section string, place long, what string")


_LINKS = ", bw AS (SELECT s.id AS id, d.id AS other, pe.kind, 'out' AS direction FROM pe JOIN ps s ON s.qualname = src JOIN ps d ON d.qualname = dst UNION ALL SELECT d.id, s.id, pe.kind, 'in' FROM pe JOIN ps s ON s.qualname = src JOIN ps d ON d.qualname = dst)"


def _impact_sql(name: str, seeds: str, found: str) -> str:
    return f""", {name}_s AS (SELECT * FROM ps WHERE {seeds}),
{name}_1 AS (SELECT DISTINCT other AS id FROM bw WHERE id IN (SELECT id FROM {name}_s) AND other NOT IN (SELECT id FROM {name}_s)),
{name}_2 AS (SELECT id FROM {name}_1 UNION SELECT other FROM bw WHERE id IN (SELECT id FROM {name}_1) AND other NOT IN (SELECT id FROM {name}_s)),
{name}_n AS (SELECT DISTINCT other AS id, kind, direction FROM bw WHERE id IN (SELECT id FROM {name}_s)),
{name}_a AS (SELECT id FROM {name}_2 UNION SELECT id FROM {name}_n WHERE kind = 'calls'),
{name} AS (SELECT (SELECT count(DISTINCT id) FROM {name}_n WHERE kind = 'calls' AND direction = 'in') AS callers,
  (SELECT count(*) FROM {name}_a JOIN ps USING (id) WHERE contains(lower(file), 'test') OR starts_with(name, 'test_')) AS tests,
  (SELECT count(*) FROM {found} AND severity = 'high') AS high, (SELECT count(*) FROM {found} AND severity = 'medium') AS medium,
  (SELECT string_agg(file, ',' ORDER BY file) FROM (SELECT DISTINCT file FROM (SELECT file FROM {name}_a JOIN ps USING (id) UNION SELECT file FROM {name}_s) ORDER BY file LIMIT 50)) AS files)"""


_FO = ", fo AS (SELECT found.*, qualname FROM found LEFT JOIN own USING (file, line_no) LEFT JOIN ps ON ps.id = owner)"


@query(P + _FOUND + _OWN + _FO + _LINKS + _impact_sql("i1", "qualname = 'geo.n1.rate_1'", "fo WHERE qualname = 'geo.n1.rate_1'") + _impact_sql("i2", "file = 'shop/c10.py'", "fo WHERE file = 'shop/c10.py'") + """,
i AS (SELECT 'geo.n1.rate_1' AS target, * FROM i1 UNION ALL SELECT 'shop/c10.py', * FROM i2)
SELECT target, callers, tests, high, medium, files, least(100, 10 * callers + 6 * tests + 25 * high + 12 * medium) AS score,
CASE WHEN least(100, 10 * callers + 6 * tests + 25 * high + 12 * medium) >= 70 THEN 'high' WHEN least(100, 10 * callers + 6 * tests + 25 * high + 12 * medium) >= 35 THEN 'medium' ELSE 'low' END AS level FROM i""")
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, tests, findings, files and risk of a change to a symbol and to a file."""
    index, rows = program.index(spark, sf_dir), []
    for target, asked in (("geo.n1.rate_1", {"symbol": "geo.n1.rate_1"}), ("shop/c10.py", {"file": "shop/c10.py"})):
        got = context.impact(index, **asked)
        r = got["risk"]
        rows.append((target, r["direct_callers"], r["relevant_tests"], r["quality_high"], r["quality_medium"], ",".join(got["touched_files"]), r["score"], r["level"]))
    return spark.createDataFrame(rows, "target string, callers long, tests long, high long, medium long, files string, score long, level string")


@query(P + _SEARCH + _LINKS + """, l AS (SELECT DISTINCT id, other, kind FROM bw),
h0 AS (SELECT id, floor(score / (SELECT max(score) FROM shit) * 1000 + 5e-1)::BIGINT AS score, 0 AS hops, '' AS via, NULL::BIGINT AS origin FROM shit WHERE rank <= 8),
h1 AS (SELECT other AS id, max((score * 55 + 50) // 100) AS score, 1 AS hops, arg_min(kind, (-((score * 55 + 50) // 100), l.id, kind)) AS via, arg_min(l.id, (-((score * 55 + 50) // 100), l.id, kind)) AS origin FROM l JOIN h0 USING (id) WHERE other NOT IN (SELECT id FROM h0) GROUP BY ALL),
h2 AS (SELECT other AS id, max((score * 55 + 50) // 100) AS score, 2 AS hops, arg_min(kind, (-((score * 55 + 50) // 100), l.id, kind)) AS via, arg_min(l.id, (-((score * 55 + 50) // 100), l.id, kind)) AS origin FROM l JOIN h1 USING (id) WHERE other NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1) GROUP BY ALL),
ex AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2), k AS (SELECT ex.*, row_number() OVER (ORDER BY score DESC, hops, id) AS r FROM ex)
SELECT ps.qualname, ps.file, score / 1000e0 AS score, hops::BIGINT AS hops, CASE WHEN hops = 0 THEN 'retrieval anchor' ELSE via || ' edge of ' || o.qualname END AS reason FROM k JOIN ps USING (id) LEFT JOIN ps o ON o.id = origin WHERE r <= 40""")
def explore_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols reached from the best hits of a task, with the edge and the origin of each."""
    rows = context.explore(program.index(spark, sf_dir), TASK)
    return spark.createDataFrame([(r["qualname"], r["file"], r["score"], r["hops"], r["reason"]) for r in rows], "qualname string, file string, score double, hops long, reason string")


@query(P + _FOUND + _CHUNKS + _LINKS + """, deg AS (SELECT id, count(DISTINCT other) FILTER (direction = 'out') AS o, count(DISTINCT other) FILTER (direction = 'in') AS i FROM bw GROUP BY ALL),
hub AS (SELECT ps.id, qualname, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM ps LEFT JOIN deg USING (id) ORDER BY coalesce(o, 0) + coalesce(i, 0) DESC, coalesce(i, 0) DESC, coalesce(o, 0) DESC, ps.id LIMIT 12),
big AS (SELECT file, count(*) AS n FROM ps GROUP BY ALL ORDER BY n DESC, file LIMIT 12),
hot AS (SELECT file, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) AS n FROM found GROUP BY ALL ORDER BY h DESC, m DESC, n DESC, file LIMIT 12),
dep AS (SELECT ps.file, count(DISTINCT other) FILTER (direction = 'in') AS i, count(DISTINCT other) FILTER (direction = 'out') AS o FROM ps LEFT JOIN bw USING (id) GROUP BY ALL ORDER BY i + o DESC, i DESC, ps.file LIMIT 12)
SELECT 'count' AS section, 'symbols' AS name, (SELECT count(*) FROM ps) AS value UNION ALL SELECT 'count', 'files', (SELECT count(*) FROM pf) UNION ALL SELECT 'count', 'edges', (SELECT count(*) FROM (SELECT DISTINCT * FROM pe))
UNION ALL SELECT 'count', 'imports', (SELECT count(*) FROM pi) UNION ALL SELECT 'count', 'chunks', (SELECT count(*) FROM chunk) UNION ALL SELECT 'count', 'lines', (SELECT count(*) FROM pl) UNION ALL SELECT 'count', 'quality_findings', (SELECT count(*) FROM found)
UNION ALL SELECT 'kind', kind, count(*) FROM ps GROUP BY ALL UNION ALL SELECT 'largest', file, n FROM big UNION ALL SELECT 'hub', qualname, o * 100000 + i FROM hub
UNION ALL SELECT 'hotspot', file, h * 10000 + m * 100 + n FROM hot UNION ALL SELECT 'dependency', file, i * 100000 + o FROM dep""")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, kinds, largest files, hubs and hotspots."""
    got = context.stats(program.index(spark, sf_dir))
    rows = [("count", k, v) for k, v in got.items() if isinstance(v, int)] + [("kind", k, v) for k, v in got["by_kind"].items()]
    rows += [("largest", r["file"], r["symbols"]) for r in got["largest_files"]] + [("hub", r["qualname"], r["outgoing"] * 100000 + r["incoming"]) for r in got["hubs"]]
    rows += [("hotspot", r["file"], r["high"] * 10000 + r["medium"] * 100 + r["total"]) for r in got["quality_hotspots"]] + [("dependency", r["file"], r["incoming"] * 100000 + r["outgoing"]) for r in got["dependency_hotspots"]]
    return spark.createDataFrame(rows, "section string, name string, value long")


@query(P + _LINKS + """ SELECT qualname, file, signature, count(DISTINCT o.other) AS outgoing FROM ps LEFT JOIN bw o ON o.id = ps.id AND o.direction = 'out'
WHERE ps.id NOT IN (SELECT id FROM bw WHERE direction = 'in' AND kind = 'calls') AND (name LIKE 'test\\_%' ESCAPE '\\' OR ends_with(file, '.rb')) GROUP BY ALL""")
def uncalled_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols of tests and Ruby files that nobody calls."""
    index = program.index(spark, sf_dir)
    is_entry = F.col("name").startswith("test_") | F.col("file").endswith(".rb")
    return graph.entry_points(index.symbols, index.edges, is_entry, ["file", "start_line"], top=2**30).select("qualname", "file", "signature", "outgoing")


@query(P + _FOUND + _CHUNKS + _SEARCH + _CSEARCH + _LINKS + """, big AS (SELECT file, count(*) AS n FROM ps GROUP BY ALL ORDER BY n DESC, file LIMIT 12),
dep AS (SELECT ps.file, count(DISTINCT other) FILTER (direction = 'in') AS i, count(DISTINCT other) FILTER (direction = 'out') AS o FROM ps LEFT JOIN bw USING (id) GROUP BY ALL ORDER BY i + o DESC, i DESC, ps.file LIMIT 12)
SELECT 'symbol:' || qualname AS handle, score FROM shit WHERE rank <= 24 UNION ALL SELECT 'chunk:' || id, score FROM chit WHERE rank <= 16
UNION ALL SELECT 'file:' || file, i + o FROM dep UNION ALL SELECT 'file:' || file, n FROM big WHERE file NOT IN (SELECT file FROM dep)""")
def attention_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of what to look at for a task: symbols, chunks, files."""
    got = context.attention(program.index(spark, sf_dir), TASK)["attention"]
    rows = [(r["handle"], float(r["score"])) for k in ("symbols", "chunks") for r in got[k]] + [(r["handle"], float(r["incoming"] + r["outgoing"] if "incoming" in r else r["symbols"])) for r in got["files"]]
    return spark.createDataFrame(rows, "handle string, score double")


# --- the stored index -------------------------------------------------------------------------


@query(P + _FOUND + _CHUNKS + """ SELECT 'symbols' AS name, count(*) AS n, sum(length(signature))::BIGINT AS size FROM ps UNION ALL SELECT 'edges', count(*), NULL FROM (SELECT DISTINCT * FROM pe) UNION ALL SELECT 'imports', count(*), sum(length(module))::BIGINT FROM pi
UNION ALL SELECT 'files', count(*), sum(length(source))::BIGINT FROM pf UNION ALL SELECT 'lines', count(*), sum(length(txt))::BIGINT FROM pl UNION ALL SELECT 'chunks', count(*), sum(length(text))::BIGINT FROM chunk
UNION ALL SELECT 'quality_findings', count(*), sum(length(code))::BIGINT FROM found UNION ALL SELECT 'meta', 1, 1""")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written to the shared folder, its version read, and every table loaded again."""
    index = program.index(spark, sf_dir)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    repo.save(index, folder)
    stored = repo.load(spark, folder)
    texts = {"symbols": "signature", "imports": "module", "files": "source", "lines": "text", "chunks": "text", "quality_findings": "code"}
    out = spark.createDataFrame([("meta", 1, int(repo.meta(spark, folder, "version") == repo.VERSION))], "name string, n long, size long")
    for name in ("symbols", "edges", "imports", "files", "lines", "chunks", "quality_findings"):
        size = F.sum(F.length(texts[name])) if name in texts else F.lit(None).cast("long")
        out = out.unionByName(stored.tables[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), size.alias("size")))
    return out
