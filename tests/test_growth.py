"""Work that must grow no faster than the input: how often and in how many tasks it is done."""

import pytest

from pyspark.sql import functions as F

from spindrift.operators import extract, graph, lines, retrieval, runs
from spindrift.plans import context, corpus, program, program_catalog
from spindrift.sources import repo


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables the program follows from, each in one file, as a driver may write them."""
    out = tmp_path_factory.mktemp("tables")
    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    one([(n, f"N{n}", 0) for n in range(3)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    one([(c, f"C{c}", c % 3, 1.0, "x") for c in range(1, 41)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    one([(s, f"S{s}", 0, 1.0) for s in range(1, 11)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "supplier")
    return str(out)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_are_read_in_one_pass(spark, folder):
    """Before, files were read three times for the numbers of symbols that only led back to their names."""
    rows = program_catalog.program_references(spark, folder)
    assert plan(rows).count("MapInArrow") == 1 and "Join" not in plan(rows).split("MapInArrow")[0]
    assert rows.count() == len(program.REFERENCES[:1]) + sum(n for t, *_ in program.REFERENCES for n in [{"nation": 3, "customer": 40, "test": 4, "ts": 2, "go": 3, "java": 3, "rb": 2}.get(t, 0)])


def test_files_are_spread_over_tasks_by_their_number(spark, folder, monkeypatch):
    """Before, files of a table in one row group were read in one task."""
    monkeypatch.setattr(extract, "FILES", 5)
    parts = program.files(spark, folder).rdd.glom().map(len).collect()
    assert len(parts) == 10 and sum(parts) == 58 and max(parts) < 20
    assert plan(program_catalog.program_symbols(spark, folder)).count("MapInArrow") == 1
    assert program_catalog.program_symbols(spark, folder).count() == 4 + 3 * 5 + 40 * 3 + 4 + 2 * 3 + 3 * 3 + 3 * 4 + 2 * 3


def test_a_query_makes_only_the_tables_that_it_reads(spark, folder):
    """Before, every query made and stored the whole index."""
    index = repo.build(program.files(spark, folder), program.CHUNK, program.OVERLAP)
    assert context.find_symbol(index, "log").count() == 3 and set(index.tables.made) == {"symbols"}
    assert context.references(index, "geo.n2.rate_2", "in").count() > 0 and set(index.tables.made) == {"symbols", "edges"}
    assert set(index.tables) == set(repo.TABLES)


def test_tables_from_a_files_own_row_agree_with_joins(spark, folder, monkeypatch):
    monkeypatch.setattr(extract, "FILES", 7)
    files = program.files(spark, folder)
    extracted = extract.ordered(files.union(files.limit(3)))
    symbols = extract.symbols(extracted)
    assert [r.id for r in symbols.orderBy("file", "ord").select("id").collect()] == list(range(1, symbols.count() + 1))
    index = repo.build(files, 10, 2)
    want = lines.owners(index.lines.drop("owner_symbol_id"), symbols, ["file"], "line_no", "start_line", "end_line", "id").select("file", "line_no", "id")
    assert sorted(map(str, want.collect())) == sorted(str(r).replace("owner_symbol_id", "id") for r in index.lines.select("file", "line_no", "owner_symbol_id").collect())
    plain = lines.chunks(files, size=10, overlap=2).select("file", "start_line", "end_line", "tokens", "text", "quality_summary")
    got = index.chunks
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(plain.columns).collect()))
    assert [r.id for r in got.orderBy("file", "start_line").select("id").collect()] == list(range(1, got.count() + 1))


def test_search_reads_fields_from_the_postings(spark, folder):
    """Before, the terms of five fields of every symbol were found again in each search."""
    index = program.index(spark, folder)
    hits = context.symbol_hits(index, program_catalog.TASK, 20)
    assert "regexp_extract_all" not in plan(hits)
    slow = retrieval.symbol_search(index.symbols, program_catalog.TASK, 20, post=index.symbol_terms.drop("fields"))
    assert [(r.id, r.score) for r in hits.orderBy("rank").collect()] == [(r.id, r.score) for r in slow.orderBy("rank").collect()]


def test_exploring_does_not_move_the_edges(spark):
    edges = spark.createDataFrame([("a", "c", "calls"), ("a", "c", "calls"), ("c", "d", "calls")], "src string, dst string, kind string")
    got = graph.explore(edges, spark.createDataFrame([("a", 2.0)], "id string, score double"))
    assert {r.id: r.score for r in got.collect()} == {"a": 1000, "c": 550, "d": 303}


def test_repeated_edges_are_the_same_edges(spark, tmp_path):
    for name, schema, rows in (
        ("nation", "n_nationkey int, n_regionkey int", [(0, 0)]), ("customer", "c_custkey long, c_nationkey int", [(1, 0)]), ("orders", "o_orderkey long, o_custkey long", [(1, 1)]),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long", [(1, 5, 2), (1, 5, 2), (1, 6, 2)]),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    once, repeated = corpus.edges(spark, str(tmp_path)), corpus.edges(spark, str(tmp_path), repeated=True)
    assert once.count() == 7 and repeated.count() == 9 and set(once.collect()) == set(repeated.collect())


def test_pairs_are_counted_in_tasks_by_the_number_of_members(spark, monkeypatch):
    """Before, the session's number of partitions held whatever came."""
    monkeypatch.setattr(graph, "ROWS", 10)
    rows = [(r, i) for r in range(30) for i in range(r % 4)] * 2 + [(None, 1), (None, 2), (5, None)]
    df = spark.createDataFrame(rows, "run long, item long")
    got = runs.co_changes(df, "run", "item")
    assert got.rdd.getNumPartitions() == -(-len(rows) // 10)
    assert {tuple(r) for r in got.collect()} == {(0, 1, 14), (0, 2, 7), (1, 2, 7)}


def test_known_words_and_scored_lines_are_bounded(spark):
    """Before, a worker kept the terms of 500 000 words, and those of all lines of a batch at once."""
    of = retrieval.CodeTerms()
    for i in range(3 * retrieval.KNOWN):
        of(f"w{i}")
    assert len(of.known) <= retrieval.KNOWN == 50_000
    df = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("red box "), F.col("id").cast("string")).alias("text"))
    assert retrieval.line_scores(df, "box of x").count() == 5000


def test_postings_leave_in_batches_of_bounded_size(spark, monkeypatch):
    """Before, a batch held the terms of 1000 texts, however long."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i % 7))) for i in range(60)], "id long, text string").coalesce(1)
    want = sorted(map(str, retrieval.posted(docs, "id", {"text": 1}).collect()))
    monkeypatch.setattr(retrieval, "TERMS", 5)
    monkeypatch.setattr(retrieval, "TEXTS", 4)
    assert sorted(map(str, retrieval.posted(docs, "id", {"text": 1}).collect())) == want


def test_only_asked_terms_are_posted(spark):
    """Before, postings of all terms were stored for a search of a few."""
    docs = spark.createDataFrame([(1, "red box box"), (2, "blue"), (3, ""), (4, None)], "id long, text string")
    full, some = retrieval.posted(docs, "id", {"text": 1}), retrieval.posted(docs, "id", {"text": 1}, only=frozenset(["box"]))
    assert {(r.id, r.term, r.tf, r.dl, r.n_terms, r["head"]) for r in some.collect()} == {(1, "box", 4, 6, 2, 1), (2, None, 0, 2, 1, 1)}
    assert retrieval.corpus_numbers(some, docs).first() == retrieval.corpus_numbers(full, docs).first()
