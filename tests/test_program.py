import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import budget, graph, lines, retrieval, runs
from spindrift.plans import context, loops, program, program_catalog
from spindrift.sources import repo


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The three tables the program follows from, small."""
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(n, f"N{n}", 0) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{out}/nation.parquet")
    spark.createDataFrame([(c, f"C{c}", c % 3, 1.0, "x") for c in range(1, 12)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{out}/customer.parquet")
    spark.createDataFrame([(s, f"S{s}", 0, 1.0) for s in range(1, 6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{out}/supplier.parquet")
    return str(out)


def expected(spec, place):
    keys = [("base", "", "")] + [("nation", str(n), "") for n in range(3)] + [("customer", str(c), str(c % 3)) for c in range(1, 12)] + [("test", "10", "")]
    keys += [(("ts", "go", "java", "rb")[s % 4], str(s), "") for s in range(1, 6)]
    return {tuple(x.replace("{a}", a).replace("{b}", b) if isinstance(x, str) else x for x in place(row)) for t, a, b in keys for row in spec if row[0] == t}


def test_extraction_and_resolution(spark, folder):
    got = {tuple(r) for r in program_catalog.program_symbols(spark, folder).select("qualname", "kind", "start_line", "end_line", "signature", "docstring").collect()}
    assert got == expected(program.SYMBOLS, lambda r: r[1:])
    assert {tuple(r) for r in program_catalog.program_references(spark, folder).select("src", "ref", "kind").collect()} == expected(program.REFERENCES, lambda r: r[1:])
    assert {tuple(r)[1:] for r in program_catalog.program_imports(spark, folder).collect()} == expected(program.IMPORTS, lambda r: r[1:])
    edges = program_catalog.edge_resolve(spark, folder).select("src", "dst", "kind").collect()
    assert {tuple(r) for r in edges} == expected(program.EDGES, lambda r: r[1:]) and len(edges) == len(set(map(tuple, edges)))


def test_terms_agree_with_the_expression(spark):
    rng = random.Random(3)
    pieces = ["HTTPServer", "parse_args", "x", "A", "__init__", "camelCase2go", "the", "The", "naïve", "über_x", "a1b2", "SNAKE_CASE", "e", "I/O", "9x", "update", "Zürich"]
    rows = [(i, " ".join(rng.choice(pieces) + rng.choice(["", "(", ".", "'s"]) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = df.select("id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    post = retrieval.posted(df, "id", {"text": 1}).collect()
    assert {(r.id, r.term, r.tf) for r in post} == {tuple(r) for r in want.collect()} and len(post) == want.count()
    for key, own in itertools.groupby(sorted(post, key=lambda r: r.id), key=lambda r: r.id):
        own = list(own)
        assert {r.dl for r in own} == {sum(r.tf for r in own)} and {r.n_terms for r in own} == {len(own)} and sum(r.head for r in own) == 1
    both = {(r.id, r.term): r.tf for r in retrieval.posted(df.withColumn("again", F.col("text")), "id", {"text": 1, "again": 3}).collect()}
    assert both == {(r.id, r.term): 4 * r.tf for r in post}


def test_other_terms_can_be_given(spark):
    class Letters:
        def __call__(self, text):
            return {c: text.count(c) for c in set(text) if c.isalpha()}

    docs = spark.createDataFrame([(1, "aab"), (2, "bcc"), (3, "ddd")], "id long, text string")
    asked = spark.createDataFrame([(0, "b")], "q int, said string")
    got = retrieval.chunk_search(docs, asked, "id", "text", "q", "said", terms=Letters)
    assert {r.id for r in got.collect()} == {1, 2}


def test_overlap_and_owners_against_loops(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.choice("ab"), i, (s := rng.randint(-50, 400)), s + rng.choice([0, 3, 90, 700])) for i in range(n)]
    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "file string, l long, ls long, le long")
    b = spark.createDataFrame(right, "file string, r long, rs long, re long")
    got = sorted((r.l, r.r) for r in lines.overlapping(a, b, "file", "ls", "le", "rs", "re", bucket=37).collect())
    assert got == sorted((i, j) for f, i, s, e in left for g, j, t, u in right if f == g and s <= u and t <= e)
    points = [(rng.choice("ab"), rng.randint(-60, 800)) for _ in range(150)] * 2
    own = lines.owners(spark.createDataFrame(points, "file string, at long"), b, ["file"], "at", "rs", "re", "r")
    best = lambda f, at: min(((u - t, t, j) for g, j, t, u in right if g == f and t <= at <= u), default=(0, 0, None))[2]
    assert sorted(map(str, own.select("file", "at", "r").collect())) == sorted(str(x) for x in own.sparkSession.createDataFrame([(f, at, best(f, at)) for f, at in points], "file string, at long, r long").collect())


def test_explore_names_the_edge(spark):
    edges = spark.createDataFrame([("a", "c", "calls"), ("b", "c", "inherits"), ("c", "d", "calls"), ("a", "c", "inherits")], "src string, dst string, kind string")
    anchors = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "id string, score double")
    got = {r.id: (r.score, r.hops, r.via, r.origin) for r in graph.explore(edges, anchors).collect()}
    assert got == {"a": (1000, 0, None, None), "b": (1000, 0, None, None), "c": (550, 1, "calls", "a"), "d": (303, 2, "calls", "c")}


def test_context_uses_the_budget_operators(spark, folder):
    index = program.index(spark, folder)
    for limit in (300, 900, 4000):
        got = context.get_context(index, "visit customer 7 rate of nation", limit)
        assert got["files_to_edit"] and got["budget"]["remaining"] >= 0
        assert got["fits_in"] <= limit or "the files to edit alone exceed the budget" in got["notes"]
        assert got["budget"]["periphery"]["used"] <= got["budget"]["periphery"]["limit"]
    assert got["symbol_count"] == index.symbols.count() and got["stats"]["files"] == index.files.count()


def test_terms_stored_with_the_index(spark, folder, tmp_path):
    index = program.index(spark, folder)
    repo.save(index, str(tmp_path))
    stored = repo.load(spark, str(tmp_path))
    find = lambda i: [(r.id, r.score) for r in context.chunk_hits(i, "visit rate token", 5).collect()]
    assert find(stored) == find(index) and stored.chunk_terms.count() == index.chunk_terms.count()


def test_greedy_and_trim(spark):
    rows = [("g", i + 1, c) for i, c in enumerate([5, 9, 3, 20, 2, 7])]
    df = spark.createDataFrame(rows, "g string, rank long, cost long")
    used, want = 0, []
    for _, rank, cost in rows:
        if used + cost <= 19:
            used += cost
            want.append((rank, used))
    assert sorted((r.rank, r.used) for r in budget.greedy_skip(df, ["g"], "cost", 19).collect()) == want
    assert [r.rank for r in budget.greedy_break(df, ["g"], "cost", 19).orderBy("rank").collect()] == [1, 2, 3]
    assert runs.similar(spark.createDataFrame([(0, "red box")], "q int, t string"), "q", "t", spark.createDataFrame([(1, "red box"), (2, "red")], "id int, x string"), "id", "x").count() == 2


def test_verdicts_and_adaptive_attempts():
    check = loops.function_check("unit", lambda x: (x == "good", {"good": 2.0, "half": 1.0}.get(x, 0.0), {}))
    hint = lambda ok, *issues: lambda _: f'said {{"satisfies": {str(ok).lower()}, "issues": {list(issues)!r}}}'.replace("'", '"')
    assert [loops.verdict(x, check, c).score for x, c in (("good", None), ("good", hint(True)), ("half", hint(False, "a", "b")), ("", hint(True)), ("bad", lambda _: "??"))] == [2.0, 2.15, 0.9, -1.0, -0.05]
    assert not loops.verdict("half", check, hint(True)).accepted
    best = loops.best_verdict([loops.verdict("half", check), loops.verdict("half", check, hint(True)), loops.verdict("half", check, hint(True))])
    assert best.score == 1.15 and loops.best_verdict([]) is None
    for replies, ended, won in ((["half", "good", "bad"], "solved", "good"), (["half", "bad", "bad", "good"], "stuck", "half"), (["half", "bad"] * 3, "budget", "half")):
        asked, log = [], []
        it = iter(replies)
        got, tried, how = loops.adaptive(lambda f, t: (asked.append(t), next(it))[1], check, on_event=lambda k, d: log.append(k))
        assert (how, got.artifact) == (ended, won) and asked == [0.1, 0.3, 0.5, 0.7, 0.9, 1.0][: len(tried)] and log[-1] == "outcome"


def test_attention_map(spark, folder):
    got = context.attention(program.index(spark, folder), None)
    assert got["ok"] and got["coverage"]["files"] == program.index(spark, folder).files.count() and 12 <= len(got["attention"]["files"]) <= 32
    assert {n["tool"] for n in got["navigation"]} <= set(loops.index_tools(program.index(spark, folder)).by_name)
