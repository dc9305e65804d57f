"""The named queries over the driver tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import budget, graph, lines, retrieval, runs
from spindrift.plans import corpus
from spindrift.plans.corpus import EDGES_SQL, FILES_SQL, NODES_SQL, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts --------------------------------------------------------------------------------

LINES_SQL = f"""
f AS ({FILES_SQL}),
cutl AS (SELECT doc_id, file, string_split(source, chr(10)) AS a FROM f WHERE source <> ''),
cut2 AS (SELECT doc_id, file, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM cutl),
lines AS (SELECT doc_id, file, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS txt FROM cut2),
st AS (SELECT *, regexp_replace(txt, '^\\s+|\\s+$', '', 'g') AS s FROM lines)
"""
ROLE_SQL = """
CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '#') THEN 'comment'
 WHEN starts_with(s, 'import ') OR starts_with(s, 'from ') THEN 'import' WHEN starts_with(s, '@') THEN 'decorator'
 WHEN starts_with(s, 'def ') OR starts_with(s, 'async def ') OR starts_with(s, 'class ') THEN 'definition'
 WHEN starts_with(s, 'if ') OR starts_with(s, 'elif ') OR starts_with(s, 'else:') OR starts_with(s, 'for ') OR starts_with(s, 'while ')
   OR starts_with(s, 'try:') OR starts_with(s, 'except ') OR starts_with(s, 'finally:') OR starts_with(s, 'with ')
   OR starts_with(s, 'match ') OR starts_with(s, 'case ') THEN 'control_flow'
 WHEN starts_with(s, 'return ') THEN 'return' WHEN contains(s, '=') AND NOT contains(s, '==') THEN 'assignment'
 WHEN contains(s, '(') OR ends_with(s, ')') THEN 'call_or_expression' ELSE 'expression' END
"""
FOUND_SQL = LINES_SQL + """,
masked AS (SELECT *, regexp_replace(s, '''([^''\\\\]|\\\\.)*''|"([^"\\\\]|\\\\.)*"', '""', 'g') AS code,
  CASE WHEN contains(s, '=') THEN lower(s[:instr(s, '=') - 1]) END AS lhs, CASE WHEN contains(s, '=') THEN s[instr(s, '=') + 1:] END AS rhs FROM st),
found AS (
 SELECT doc_id, file, line_no, 'info' AS severity, 'long_line' AS code FROM masked WHERE length(txt) > 120
 UNION ALL SELECT doc_id, file, line_no, 'info', 'todo' FROM masked WHERE contains(lower(code), 'todo') OR contains(lower(code), 'fixme')
 UNION ALL SELECT doc_id, file, line_no, 'info', 'debug_print' FROM masked WHERE starts_with(s, 'print(')
 UNION ALL SELECT doc_id, file, line_no, 'high', 'dynamic_exec' FROM masked WHERE contains(code, 'eval(') OR contains(code, 'exec(')
 UNION ALL SELECT doc_id, file, line_no, 'medium', 'broad_except' FROM masked WHERE starts_with(s, 'except:') OR starts_with(s, 'except Exception:')
 UNION ALL SELECT doc_id, file, line_no, 'high', 'possible_secret' FROM masked WHERE (contains(lhs, 'api_key') OR contains(lhs, 'secret') OR contains(lhs, 'token') OR contains(lhs, 'password'))
   AND NOT regexp_matches(regexp_replace(lhs, '[:\\s]+$', ''), '(terms|names|keys)$') AND (contains(rhs, '''') OR contains(rhs, '"'))
 UNION ALL SELECT doc_id, file, line_no, 'medium', 'assert_false' FROM masked WHERE contains(code, 'assert False')
 UNION ALL SELECT doc_id, file, line_no, 'info', 'non_python_shebang' FROM masked WHERE line_no = 1 AND starts_with(s, '#!') AND NOT contains(s, 'python')
)
"""
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def terms_sql(source: str) -> str:
    """An expression: list of the terms of a text."""
    return f"""list_filter(flatten(list_transform(regexp_extract_all({source}, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: list_append(
      list_transform(regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)), lower(t)))),
      lambda x: x NOT IN ({STOP_SQL}))"""


POST_SQL = f"""
f AS ({FILES_SQL}),
dt AS (SELECT doc_id, unnest({terms_sql('source')}) AS term FROM f),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY ALL),
one AS (SELECT (SELECT count(*) FROM f) AS n, ((SELECT sum(dl) FROM dl) + (SELECT count(*) FROM f) - (SELECT count(*) FROM dl))::DOUBLE / (SELECT count(*) FROM f) AS avg_dl),
qt AS (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qc FROM qt GROUP BY ALL),
qs AS (SELECT item_id, count(*) AS q_terms FROM q GROUP BY ALL),
hits AS (
  SELECT item_id, doc_id, q_terms, count(*) AS matched,
    sum(qc * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 2.4e0) / (tf + 1.4e0 * (1e0 - 0.72e0 + 0.72e0 * dl / avg_dl))) AS bm25
  FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id) JOIN qs USING (item_id), one GROUP BY ALL),
scored AS (SELECT item_id, doc_id, round(bm25 * (1e0 + matched / q_terms::DOUBLE), 6) AS score FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""

# --- lines, findings, chunks ------------------------------------------------------------------


def _lines(spark, sf_dir):
    return lines.explode_lines(corpus.files(spark, sf_dir), "file")


@query(f"WITH {LINES_SQL} SELECT file, line_no, length(txt) AS n_chars, {ROLE_SQL} AS role FROM st")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("file", "line_no", F.length("text").cast("long").alias("n_chars"), "role")


@query(f"WITH {LINES_SQL} SELECT {ROLE_SQL} AS role, count(*) AS n FROM st GROUP BY ALL")
def line_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FOUND_SQL} SELECT file, line_no, severity, code FROM found")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.findings(_lines(spark, sf_dir)).select("file", "line_no", "severity", "code")


@query(f"""WITH {FOUND_SQL} SELECT file, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) AS total
FROM found GROUP BY ALL ORDER BY high DESC, medium DESC, total DESC, file LIMIT 12""")
def quality_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.hotspots(lines.findings(_lines(spark, sf_dir)))


@query(f"""WITH {FOUND_SQL} SELECT file, line_no, severity, code FROM found
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, file, line_no, code LIMIT 100""")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.findings(_lines(spark, sf_dir)).select("file", "line_no", "severity", "code")
    return found.orderBy(T.severity_rank(F.col("severity")), "file", "line_no", "code").limit(100)


CHUNKS_SQL = LINES_SQL + """,
n AS (SELECT file, count(*) AS n FROM lines GROUP BY ALL),
w AS (SELECT file, n, unnest(range(0, 1 + ceil(greatest(0, n - 12) / 9e0)::BIGINT)) * 9 + 1 AS start_line FROM n),
spans AS (SELECT file, start_line, least(n, start_line + 11) AS end_line FROM w)
"""


@query(f"""WITH {CHUNKS_SQL} SELECT s.file, start_line, end_line,
  CASE WHEN length(string_agg(txt, chr(10) ORDER BY line_no)) = 0 THEN 0 ELSE greatest(1, length(string_agg(txt, chr(10) ORDER BY line_no)) // 4) END::BIGINT AS tokens
FROM spans s JOIN lines l ON l.file = s.file AND line_no BETWEEN start_line AND end_line GROUP BY s.file, start_line, end_line""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 12 lines that overlap by 3, as the texts are short."""
    return lines.chunks(corpus.files(spark, sf_dir), size=12, overlap=3).select("file", "start_line", "end_line", "tokens")


@query(f"""WITH {FOUND_SQL}, n AS (SELECT file, count(*) AS n FROM lines GROUP BY ALL),
w AS (SELECT file, n, unnest(range(0, 1 + ceil(greatest(0, n - 12) / 9e0)::BIGINT)) * 9 + 1 AS start_line FROM n),
spans AS (SELECT file, start_line, least(n, start_line + 11) AS end_line FROM w)
SELECT s.file, start_line, end_line, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS flags
FROM spans s LEFT JOIN found l ON l.file = s.file AND line_no BETWEEN start_line AND end_line GROUP BY s.file, start_line, end_line""")
def chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.chunks(corpus.files(spark, sf_dir), size=12, overlap=3).select("file", "start_line", "end_line", F.array_join("quality_summary", ",").alias("flags"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


# --- retrieval --------------------------------------------------------------------------------


@query(f"WITH {POST_SQL} SELECT doc_id, term, tf FROM post")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(corpus.files(spark, sf_dir), "doc_id", "source")


@query(f"WITH {POST_SQL} SELECT term, df, round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)), 6) AS idf FROM df, one")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.files(spark, sf_dir)
    df = retrieval.postings(docs, "doc_id", "source").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.round(retrieval.idf(F.col("df"), docs.agg(F.count(F.lit(1))).scalar()), 6).alias("idf"))


@query(f"WITH {POST_SQL} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark text."""
    found = retrieval.chunk_search(corpus.files(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "source", "item_id", "text", top=10)
    return found.select("item_id", "doc_id", "score", "rank")


FIELD_QUERY = "steel part anodized economy Brand Small large bolt"
_FIELD_TERMS = f"(SELECT list_distinct({terms_sql(chr(39) + FIELD_QUERY + chr(39))}))"


@query(f"""WITH qt AS (SELECT {_FIELD_TERMS} AS q),
s AS (SELECT p_partkey, round(1.75e0 * len(list_intersect(q, {terms_sql('p_name')})) / len(q) + 1.25e0 * len(list_intersect(q, {terms_sql('p_brand')})) / len(q)
  + 1e0 * len(list_intersect(q, {terms_sql('p_type')})) / len(q)
  + 2e-1 * len(list_filter(string_split(lower('{FIELD_QUERY}'), ' '), lambda w: length(w) >= 4 AND (contains(lower(p_name), w) OR contains(lower(p_type), w)))), 6) AS boost FROM part, qt)
SELECT p_partkey, boost FROM s WHERE boost > 0""")
def field_boost_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and substring boosts of every part for one query."""
    q = F.array_distinct(T.terms(F.lit(FIELD_QUERY)))
    fields = {"p_name": 1.75, "p_brand": 1.25, "p_type": 1.0}
    boost = retrieval.field_boost(q, fields) + retrieval.substring_boost(F.lit(FIELD_QUERY), [F.col("p_name"), F.col("p_type")])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(boost, 6).alias("boost")).where("boost > 0")


@query(f"""WITH {POST_SQL}, hit AS (SELECT item_id, f.file[:instr(f.file, '/') - 1] AS folder, score, rank FROM ranked JOIN f USING (doc_id) WHERE rank <= 24),
folders AS (SELECT item_id, folder, round(sum(score * 65e-2 / pow(rank, 35e-2)), 6) AS score FROM hit GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, folder) AS rank FROM folders)
SELECT item_id, folder, score, rank FROM r WHERE rank <= 8""")
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files: their score from the 24 best documents of every benchmark text."""
    docs = corpus.files(spark, sf_dir)
    found = retrieval.chunk_search(docs, table(spark, sf_dir, "benchmark"), "doc_id", "source", "item_id", "text", top=24)
    hits = found.join(docs.select("doc_id", F.substring_index("file", "/", 1).alias("folder")), "doc_id")
    return retrieval.file_rollup(hits.limit(0), hits, "folder", "item_id", top=8).select("item_id", "folder", "score", "rank")


LINE_QUERY = "licensed under the terms of token and password thanea eriner"


@query(f"""WITH {LINES_SQL}, q AS (SELECT list_distinct({terms_sql(chr(39) + LINE_QUERY + chr(39))}) AS q),
t AS (SELECT file, line_no, list_distinct({terms_sql('txt')}) AS own, q FROM lines, q)
SELECT file, line_no, round(len(list_intersect(own, q)) / (1e0 + len(own) * 5e-2), 6) AS score FROM t WHERE len(list_intersect(own, q)) > 0""")
def line_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.line_scores(_lines(spark, sf_dir), LINE_QUERY).select("file", "line_no", F.round("score", 6).alias("score"))


@query(f"""WITH {POST_SQL}, best AS (SELECT item_id, doc_id FROM ranked WHERE rank <= 3),
m AS (SELECT item_id, doc_id, term FROM best JOIN q USING (item_id) JOIN post USING (doc_id, term)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY term) AS r FROM m)
SELECT item_id, doc_id, string_agg(term, ',' ORDER BY term) AS matched FROM k WHERE r <= 12 GROUP BY ALL""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = corpus.files(spark, sf_dir), table(spark, sf_dir, "benchmark")
    best = retrieval.chunk_search(docs, asked, "doc_id", "source", "item_id", "text", top=3)
    rows = best.join(docs, "doc_id").join(asked.select("item_id", F.col("text").alias("__q")), "item_id")
    terms = retrieval.matched_terms(F.array_distinct(T.terms(F.col("__q"))), F.col("source"))
    return rows.select("item_id", "doc_id", F.array_join(terms, ",").alias("matched"))


# --- lookups ----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.' || replace(p_type, ' ', '_') AS qualname FROM part)
SELECT p_partkey, qualname, length(qualname) AS n FROM s WHERE qualname = 'bolt.SMALL' OR ends_with(qualname, '.bolt.SMALL') ORDER BY qualname = 'bolt.SMALL' DESC, n, p_partkey LIMIT 20""")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact or dotted-suffix match, exact first, then the shortest."""
    name = F.concat(F.translate("p_name", " ", "."), F.lit("."), F.translate("p_type", " ", "_"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("qualname")).withColumn("n", F.length("qualname").cast("long"))
    wanted = "bolt.SMALL"
    return rows.where((F.col("qualname") == wanted) | F.col("qualname").endswith("." + wanted)).orderBy(F.desc(F.col("qualname") == wanted), "n", "p_partkey").limit(20)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDG%' OR p_type ILIKE '%WIDG%' ORDER BY length(p_name), p_partkey LIMIT 30")
def workspace_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%WIDG%") | F.col("p_type").ilike("%WIDG%"))
    return rows.select("p_partkey", "p_name").orderBy(F.length("p_name"), "p_partkey").limit(30)


@query(f"WITH {LINES_SQL} SELECT file, line_no, length(txt) AS n_chars FROM lines WHERE line_no BETWEEN 3 AND 9")
def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_window(_lines(spark, sf_dir), 5, 7, radius=2).select("file", "line_no", F.length("text").cast("long").alias("n_chars"))


_SPAN = "date_diff('day', DATE '1992-01-01', {})"
_BOUNDS = """o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS s FROM orders)"""


@query(f"""WITH {_BOUNDS} SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM o a JOIN o b USING (o_custkey)
WHERE NOT (a.s + 30 < b.s OR a.s > b.s + 30) AND a.o_orderkey < b.o_orderkey""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders whose 30 days overlap."""
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    side = lambda p: table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias(f"{p}_key"), day.alias(f"{p}_s"), (day + 30).alias(f"{p}_e"))
    both = lines.overlapping(side("left"), side("right"), "o_custkey", "left_s", "left_e", "right_s", "right_e")
    return both.where("left_key < right_key").select("left_key", "right_key")


OWNER_SPANS = [(f"{n}{k}", n, k * w, k * w + w - 1 - (n == "month")) for n, w in (("month", 30), ("quarter", 90), ("year", 360)) for k in range(1, 3600 // w)]
_SPANS_SQL = "spans(name, s, e) AS (VALUES " + ", ".join(f"('{n}', {s}, {e})" for n, _, s, e in OWNER_SPANS) + ")"


@query(f"""WITH {_BOUNDS}, {_SPANS_SQL},
best AS (SELECT o_orderkey, arg_min(name, (e - spans.s, spans.s)) AS owner FROM o JOIN spans ON o.s BETWEEN spans.s AND e GROUP BY ALL)
SELECT o_orderkey, owner FROM o LEFT JOIN best USING (o_orderkey)""")
def smallest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of nested day ranges that holds an order's date; none for the first and the gap days."""
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    points = table(spark, sf_dir, "orders").select(F.lit("calendar").alias("file"), "o_orderkey", day.alias("s"))
    spans = spark.createDataFrame([("calendar", n, s, e) for n, _, s, e in OWNER_SPANS], "file string, owner string, start long, end long")
    return lines.owners(points, spans, ["file"], "s", "start", "end", "owner").select("o_orderkey", "owner")


# --- graph ------------------------------------------------------------------------------------

BOTH_SQL = f"""e AS ({EDGES_SQL}), nd AS ({NODES_SQL}),
b AS (SELECT src AS id, dst AS other, kind, 'out' AS direction FROM e UNION ALL SELECT dst, src, kind, 'in' FROM e)"""


@query(f"WITH {BOTH_SQL} SELECT id, kind, direction, count(*) AS n, min(other) AS first, max(other) AS last FROM b GROUP BY ALL")
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.both_ways(corpus.edges(spark, sf_dir))
    return rows.groupBy("id", "kind", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"), F.max("other").alias("last"))


@query(f"""WITH {BOTH_SQL},
h1 AS (SELECT other AS id, min(kind) AS kind, 1 AS depth FROM b WHERE id = 'r1' AND other <> 'r1' GROUP BY ALL),
h2 AS (SELECT other AS id, min(b.kind) AS kind, 2 AS depth FROM b JOIN h1 USING (id) WHERE other <> 'r1' AND other NOT IN (SELECT id FROM h1) GROUP BY ALL),
h3 AS (SELECT other AS id, min(b.kind) AS kind, 3 AS depth FROM b JOIN h2 USING (id) WHERE other <> 'r1' AND other NOT IN (SELECT id FROM h1 UNION ALL SELECT id FROM h2) GROUP BY ALL)
SELECT id, kind, depth FROM h1 UNION ALL SELECT id, kind, depth FROM h2 UNION ALL SELECT id, kind, depth FROM h3""")
def bfs_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is within three hops of one region."""
    found = graph.expand(corpus.edges(spark, sf_dir), spark.createDataFrame([("r1",)], "id string"), hops=3)
    return found.select("id", "kind", "depth")


_EXPLORE = f"""{BOTH_SQL}, l AS (SELECT DISTINCT id, other FROM b),
a AS (SELECT 'c' || c_custkey AS id, c_acctbal AS s FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8),
h0 AS (SELECT id, floor(s / (SELECT max(s) FROM a) * 1000 + 5e-1)::BIGINT AS score, 0 AS hops FROM a),
h1 AS (SELECT other AS id, max((score * 55 + 50) // 100) AS score, 1 AS hops FROM l JOIN h0 USING (id) WHERE other NOT IN (SELECT id FROM h0) GROUP BY ALL),
h2 AS (SELECT other AS id, max((score * 55 + 50) // 100) AS score, 2 AS hops FROM l JOIN h1 USING (id) WHERE other NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1) GROUP BY ALL),
ex AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""


def _explored(spark, sf_dir):
    top = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(8)
    anchors = top.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").alias("score"))
    return graph.explore(corpus.edges(spark, sf_dir, repeated=True), anchors, rounds=2)


@query(f"WITH {_EXPLORE} SELECT id, score, hops FROM ex")
def explore_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds from the eight richest customers; scores in thousandths."""
    return _explored(spark, sf_dir).select("id", "score", "hops")


@query(f"WITH {_EXPLORE} SELECT file, sum(score)::BIGINT AS score, min(hops) AS hops FROM ex JOIN nd USING (id) GROUP BY ALL ORDER BY score DESC, file LIMIT 12")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.discovered_files(_explored(spark, sf_dir), corpus.nodes(spark, sf_dir))


@query(f"""WITH {BOTH_SQL}, g AS (SELECT id, count(DISTINCT other) FILTER (direction = 'out') AS outgoing, count(DISTINCT other) FILTER (direction = 'in') AS incoming FROM b GROUP BY ALL)
SELECT nd.id, file, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM nd LEFT JOIN g USING (id) ORDER BY outgoing + incoming DESC, incoming DESC, outgoing DESC, nd.id LIMIT 12""")
def hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir))


@query(f"""WITH {BOTH_SQL} SELECT file, count(DISTINCT other) FILTER (direction = 'in') AS incoming, count(DISTINCT other) FILTER (direction = 'out') AS outgoing
FROM nd LEFT JOIN b USING (id) GROUP BY ALL ORDER BY incoming + outgoing DESC, incoming DESC, file LIMIT 12""")
def dependency_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_hotspots(corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir))


@query(f"""WITH {BOTH_SQL} SELECT nd.id, file, count(e.dst) AS outgoing FROM nd LEFT JOIN e ON e.src = nd.id
WHERE nd.id NOT IN (SELECT dst FROM e WHERE kind = 'calls') AND (name IN ('1-URGENT', 'main') OR ends_with(file, '-12')) GROUP BY ALL ORDER BY outgoing DESC, file, nd.id LIMIT 12""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncalled nodes of certain names or files, with most outgoing edges first."""
    is_entry = F.col("name").isin("1-URGENT", "main") | F.col("file").endswith("-12")
    return graph.entry_points(corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir), is_entry, ["file", "id"]).select("id", "file", "outgoing")


@query(f"""WITH {BOTH_SQL} SELECT d.file, count(DISTINCT e.src) AS callers FROM e JOIN nd d ON d.id = e.dst JOIN nd s ON s.id = e.src
WHERE kind = 'calls' AND s.file <> d.file GROUP BY ALL""")
def dependents_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.dependents(corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("callers"))


@query(f"""WITH {BOTH_SQL} SELECT DISTINCT e.src, e.dst, kind, s.file AS src_file, d.file AS dst_file FROM e JOIN nd s ON s.id = e.src JOIN nd d ON d.id = e.dst
WHERE s.file IN ('nations', 'parts/Brand#11') OR d.file IN ('nations', 'parts/Brand#11')""")
def edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(corpus.nodes(spark, sf_dir), corpus.edges(spark, sf_dir), lambda f: f.isin("nations", "parts/Brand#11"))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS callers, count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN l_orderkey END) AS tests,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS high, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 45) AS medium
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
s AS (SELECT *, least(100, callers + tests * 6 + high * 25 + medium * 12 + callers * 9) AS risk_score FROM c)
SELECT l_partkey, callers, tests, high, medium, risk_score, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level FROM s""")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: orders call them, orders of low priority stand for tests, large returns for findings."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderpriority") == "5-LOW").alias("test"))
    big = F.col("l_quantity") > 45
    n = graph.tasks(spark, line.count())
    line = line.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    per_order = line.repartition(n, "l_orderkey").join(o.repartition(n, "l_orderkey"), "l_orderkey").groupBy("l_partkey", "l_orderkey").agg(
        F.max("test").alias("test"), F.count_if((F.col("l_returnflag") == "R") & big).alias("high"), F.count_if((F.col("l_returnflag") == "A") & big).alias("medium")
    )
    rows = per_order.repartition(n, "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("callers"), F.count_if("test").alias("tests"), F.sum("high").alias("high"), F.sum("medium").alias("medium"))
    return graph.risks(rows)


@query("""WITH p AS (SELECT page_id, replace(replace(url, 'https://', ''), '.example.', '/Tests/') AS file, CASE WHEN ends_with(url, '.html') THEN 'test_page' ELSE 'page' END AS name FROM pages)
SELECT page_id, (contains(string_split(lower(file), '/')[-1], 'test') OR starts_with(name, 'test_') OR contains(lower(file), '/tests/')) AS narrow,
  (contains(lower(file), 'test') OR starts_with(name, 'test_')) AS wide FROM p""")
def test_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit(".example."), F.lit("/Tests/")).alias("file"), F.when(url.endswith(".html"), "test_page").otherwise("page").alias("name"))
    return rows.select("page_id", T.is_test_path(F.col("file"), F.col("name")).alias("narrow"), T.is_test_anywhere(F.col("file"), F.col("name")).alias("wide"))


# --- budgets ----------------------------------------------------------------------------------

_TOP_PARTS = """c AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
k AS (SELECT * FROM c WHERE rank <= 64)"""


def _top_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return budget.top_candidates(rows, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 64)


@query(f"""WITH RECURSIVE {_TOP_PARTS},
w(p_brand, rank, used, took, p_partkey) AS (
  SELECT p_brand, rank, CASE WHEN p_size <= 300 THEN p_size ELSE 0 END::BIGINT, p_size <= 300, p_partkey FROM k WHERE rank = 1
  UNION ALL SELECT k.p_brand, k.rank, (w.used + CASE WHEN w.used + p_size <= 300 THEN p_size ELSE 0 END)::BIGINT, w.used + p_size <= 300, k.p_partkey FROM w JOIN k ON k.p_brand = w.p_brand AND k.rank = w.rank + 1)
SELECT p_brand, rank, p_partkey, used FROM w WHERE took""")
def greedy_pack_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 dearest parts of a brand under a budget of 300, passing over what does not fit."""
    return budget.greedy_skip(_top_parts(spark, sf_dir), ["p_brand"], "p_size", 300).select("p_brand", "rank", "p_partkey", "used")


@query(f"""WITH {_TOP_PARTS}, r AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY rank)::BIGINT AS used FROM k)
SELECT p_brand, rank, p_partkey, used FROM r WHERE used <= 300""")
def greedy_pack_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.greedy_break(_top_parts(spark, sf_dir), ["p_brand"], "p_size", 300).select("p_brand", "rank", "p_partkey", "used")


@query("""WITH m AS (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS best FROM customer)
SELECT c_nationkey, c_custkey, c_acctbal FROM m WHERE c_acctbal >= best * 5e-1""")
def relative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return budget.near_best(rows, ["c_nationkey"], "c_acctbal", [(-F.col("c_acctbal")).alias("s"), F.col("c_custkey")])


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'edit' WHEN l_returnflag = 'N' THEN 'periphery' WHEN l_returnflag = 'A' THEN 'tests' ELSE 'quality' END AS section, l_quantity::BIGINT AS tokens FROM lineitem),
p AS (SELECT *, CASE section WHEN 'periphery' THEN 1 WHEN 'tests' THEN 2 WHEN 'quality' THEN 3 END AS place FROM i),
g AS (SELECT *, sum(tokens) OVER (PARTITION BY l_orderkey) AS total,
  coalesce(sum(CASE WHEN place IS NOT NULL THEN tokens END) OVER (PARTITION BY l_orderkey ORDER BY place NULLS LAST, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM p)
SELECT l_orderkey, section, count(*) AS items, sum(tokens)::BIGINT AS tokens FROM g WHERE place IS NULL OR total - gone <= 100 GROUP BY ALL""")
def trim_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of sections; an order over 100 loses its last items section by section."""
    section = F.when(F.col("l_linenumber") == 1, "edit").when(F.col("l_returnflag") == "N", "periphery").when(F.col("l_returnflag") == "A", "tests").otherwise("quality")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), section.alias("section"), F.col("l_quantity").cast("long").alias("tokens"))
    kept = budget.trim(rows, ["l_orderkey"], "tokens", ["periphery", "tests", "quality"], "at", 100).where("kept")
    return kept.groupBy("l_orderkey", "section").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))


# --- runs and checks --------------------------------------------------------------------------

_SUMMARY = """t AS (SELECT user_id::VARCHAR AS run_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type, value,
  CASE event_type WHEN 'click' THEN 'check' WHEN 'view' THEN 'model_call' WHEN 'purchase' THEN 'outcome' ELSE event_type END AS kind FROM events),
x AS (SELECT run_id, arg_max(value, seq) AS v FROM t WHERE kind = 'outcome' GROUP BY ALL),
r AS (SELECT run_id, count(*) FILTER (kind = 'model_call') AS model_calls, coalesce(sum(value::DECIMAL(18,2)) FILTER (kind = 'model_call'), 0)::DOUBLE AS model_latency_s,
  count(*) FILTER (kind = 'check') AS checks, count(*) FILTER (kind = 'check' AND value >= 10) AS checks_passed, count(*) AS n_events FROM t GROUP BY ALL),
s AS (SELECT r.*, coalesce(v >= 20, false) AS resolved, CASE WHEN v IS NULL THEN '' WHEN v >= 60 THEN 'oracle' ELSE 'repair' END AS won_by, coalesce(trunc(v)::BIGINT % 4, 0) AS attempts FROM r LEFT JOIN x USING (run_id))"""


def _summary(spark, sf_dir):
    return runs.summarize(corpus.trace(spark, sf_dir))


@query(f"WITH {_SUMMARY} SELECT run_id, model_calls, round(model_latency_s, 2) AS model_latency_s, checks, checks_passed, resolved, won_by, attempts, n_events FROM s")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _summary(spark, sf_dir)
    events = F.aggregate(F.map_values("event_counts"), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("run_id", "model_calls", F.round("model_latency_s", 2).alias("model_latency_s"), "checks", "checks_passed", "resolved", "won_by", F.col("attempts").cast("long").alias("attempts"), events.alias("n_events"))


@query(f"""WITH {_SUMMARY} SELECT count(*) AS runs, count(*) FILTER (resolved) AS resolved, round(count(*) FILTER (resolved) / count(*)::DOUBLE, 3) AS resolved_rate,
round(avg(attempts) FILTER (resolved AND attempts <> 0), 2) AS avg_attempts_on_win FROM s""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.memory_stats(_summary(spark, sf_dir))


@query(f"WITH {_SUMMARY} SELECT won_by, count(*) AS wins FROM s WHERE resolved GROUP BY ALL")
def wins_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.wins_by_layer(_summary(spark, sf_dir))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
SELECT a.p AS a, b.p AS b, count(*) AS count FROM m a JOIN m b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2""")
def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that finished orders contain together, at least twice."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n_rows = line.count()
    n = graph.tasks(spark, n_rows)
    return runs.co_changes(line.repartition(n, "l_orderkey").join(done.repartition(n, "l_orderkey"), "l_orderkey"), "l_orderkey", "l_partkey", n_rows=n_rows)


_JACCARD = f"""f AS ({FILES_SQL}),
d AS (SELECT DISTINCT doc_id, unnest({terms_sql('source')}) AS term FROM f), q AS (SELECT DISTINCT item_id, unnest({terms_sql('text')}) AS term FROM benchmark),
nd AS (SELECT doc_id, count(*) AS nd FROM d GROUP BY ALL), nq AS (SELECT item_id, count(*) AS nq FROM q GROUP BY ALL),
i AS (SELECT item_id, doc_id, count(*) AS i FROM d JOIN q USING (term) GROUP BY ALL),
j AS (SELECT item_id, doc_id, round(i / (nd + nq - i)::DOUBLE, 6) AS similarity FROM i JOIN nd USING (doc_id) JOIN nq USING (item_id)),
jr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM j)"""


def _similar(spark, sf_dir):
    return runs.similar(table(spark, sf_dir, "benchmark"), "item_id", "text", corpus.files(spark, sf_dir), "doc_id", "source")


@query(f"WITH {_JACCARD} SELECT item_id, doc_id, similarity, rank FROM jr WHERE rank <= 3")
def jaccard_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).select("item_id", "doc_id", "similarity", "rank")


@query(f"""WITH {_JACCARD}, h AS (SELECT item_id, lang, count(*) AS n FROM jr JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, lang) AS r FROM h)
SELECT item_id, lang AS suggested, n AS votes FROM m WHERE r = 1""")
def recall_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest language of the three most similar documents; the first by name on a tie."""
    rows = _similar(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    votes = rows.groupBy("item_id", "lang").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("item_id").agg(F.min(F.struct(-F.col("votes"), F.col("lang").alias("lang"))).alias("m"), F.max("votes").alias("votes"))
    return first.select("item_id", F.col("m.lang").alias("suggested"), "votes")


@query("""WITH e AS (SELECT l_orderkey AS o, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS expected FROM lineitem GROUP BY ALL),
a AS (SELECT o_orderkey AS o, round(o_totalprice * 100)::BIGINT AS actual FROM orders)
SELECT o AS order_key, expected, actual, CASE WHEN expected IS NULL THEN 'unexpected' WHEN actual IS NULL THEN 'missing' WHEN expected <> actual THEN 'mismatch' ELSE 'ok' END AS status FROM e FULL JOIN a USING (o)""")
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in cents against the sum of their lines."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    left = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sum(cents("l_extendedprice")).alias("total"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), cents("o_totalprice").alias("total"))
    return runs.reconcile(left, right, "order_key")


@query("""WITH j AS (SELECT event_id, try_cast(props ->> 'k' AS BIGINT) AS k, (props -> 'k') IS NOT NULL AS has FROM events)
SELECT event_id, CASE WHEN NOT has THEN 'missing key: k;missing key: name' WHEN k IS NULL THEN 'k is no integer;missing key: name' ELSE 'missing key: name' END AS errors FROM j""")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props must have an integer k and a name."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(runs.schema_errors("props", {"k": "integer", "name": "string"}), ";").alias("errors"))


_CANDIDATES = """v AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag <> 'R' AS compiled, l_linestatus = 'F' AS tests_ran, l_quantity > 25 AS tests_passed,
  CASE WHEN l_discount < 3e-2 THEN true WHEN l_discount > 7e-2 THEN false END AS types_ok, l_tax * 100 AS tax FROM lineitem),
s AS (SELECT *, CASE WHEN NOT compiled THEN 0e0 ELSE greatest(0e0, 1e0 + CASE WHEN tests_ran THEN CASE WHEN tests_passed THEN 15e-1 ELSE -5e-1 END ELSE 0e0 END + CASE WHEN types_ok THEN 5e-1 WHEN NOT types_ok THEN -25e-2 ELSE 0e0 END) END AS signal FROM v)"""


def _verdicts(spark, sf_dir):
    compiled, ran, passed = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F", F.col("l_quantity") > 25
    types = F.when(F.col("l_discount") < 0.03, True).when(F.col("l_discount") > 0.07, False)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", T.exec_signal(compiled, ran, passed, types).alias("signal"), (compiled & passed).alias("ok"))


@query(f"""WITH {_CANDIDATES}, k AS (SELECT *, compiled AND tests_passed AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY signal DESC, (compiled AND tests_passed) DESC, l_linenumber, l_partkey) AS r FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, signal, ok FROM k WHERE r = 1""")
def exec_signal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of every order by its execution signal."""
    rows = _verdicts(spark, sf_dir).withColumn("score", F.lit(0.0)).withColumn("n_errors", F.lit(0))
    rows = rows.withColumn("at", F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey"))
    return runs.best_candidate(rows, "l_orderkey", "at").select("l_orderkey", "l_linenumber", "l_partkey", "signal", "ok")


@query(f"""WITH {_CANDIDATES}, n AS (SELECT *, row_number() OVER w AS n, lag(signal) OVER w AS before FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, min(n) AS stuck_at FROM n WHERE signal <= 0 AND before <= 0 GROUP BY ALL""")
def stuck_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two lines without a signal in a row, and where first."""
    return runs.stuck(_verdicts(spark, sf_dir), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "signal")


@query("""WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40)
SELECT o_custkey, count(*) AS expected, count(l_orderkey) AS hits, count(l_orderkey) / count(*)::DOUBLE AS score FROM m LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY ALL""")
def coverage_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, the share of orders that hold a large line."""
    expected = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return runs.coverage(expected, expected.join(large, "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT c_mktsegment AS layer, o_orderkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey),
h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40)
SELECT layer, count(*) AS tasks, count(l_orderkey) AS passed, round(count(l_orderkey) / count(*)::DOUBLE, 6) AS mean_score FROM c LEFT JOIN h ON l_orderkey = o_orderkey GROUP BY ALL""")
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass count and mean score by layer (market segment)."""
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1.0))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("layer"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(c, "o_custkey").join(large, "o_orderkey", "left").na.fill(0.0, ["hit"])
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("hit") > 0).alias("passed"), F.round(F.avg("hit"), 6).alias("mean_score"))


# --- messy text -------------------------------------------------------------------------------


@query("""SELECT page_id, length(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'))::BIGINT AS n_chars FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their script blocks."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", r"(?s)<script>.*?</script>", "")).cast("long").alias("n_chars"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS path, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS code FROM pages""")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired groups of a repeated pattern: targets and texts of links."""
    both = F.arrays_zip(*[F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(k)).alias(n) for k, n in ((1, "path"), (2, "code"))])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("b")).select("page_id", "b.path", "b.code")


@query("SELECT event_type, try_cast(props ->> 'k' AS BIGINT) AS k, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""WITH b AS (SELECT page_id, length(html) - length(replace(html, '{', '')) AS opened, length(html) - length(replace(html, '}', '')) AS closed FROM pages)
SELECT page_id, opened, closed, opened = closed AS balanced FROM b""")
def brace_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.char_count(F.col("html"), "{").alias("opened"), T.char_count(F.col("html"), "}").alias("closed"))
    return rows.withColumn("balanced", F.col("opened") == F.col("closed"))


@query("""WITH p AS (SELECT page_id, CASE WHEN contains(url, '#') THEN '../' || split_part(url, '://', 2) WHEN contains(url, '?') THEN '/' || split_part(url, '://', 2)
  WHEN ends_with(url, '.html') THEN 'a/../' || split_part(url, '://', 2) ELSE split_part(url, '://', 2) END AS rel FROM pages)
SELECT page_id, CASE WHEN starts_with(rel, '../') OR starts_with(rel, '/') THEN NULL WHEN starts_with(rel, 'a/../') THEN '/srv/' || rtrim(rel[6:], '/') ELSE '/srv/' || rtrim(rel, '/') END AS path FROM p""")
def safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as relative paths: climbing and absolute ones are refused."""
    tail = F.element_at(F.split("url", "://"), 2)
    rel = F.when(F.col("url").contains("#"), F.concat(F.lit("../"), tail)).when(F.col("url").contains("?"), F.concat(F.lit("/"), tail)).when(F.col("url").endswith(".html"), F.concat(F.lit("a/../"), tail)).otherwise(tail)
    return table(spark, sf_dir, "pages").select("page_id", T.safe_path(F.lit("/srv"), rel).alias("path"))
