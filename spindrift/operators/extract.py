"""Source files to symbols, imports and references.

Each file is read on its own in an Arrow batch: Python by its syntax tree, other languages by patterns.
Nothing is executed.  A file that does not parse has no symbols but stays a file.
"""

from __future__ import annotations

import ast
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import languages as L
from spindrift.operators.graph import cut

SYMBOL = pa.struct([
    ("ord", pa.int32()), ("qualname", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("signature", pa.string()), ("docstring", pa.string()), ("source", pa.string()), ("calls", pa.list_(pa.string())), ("bases", pa.list_(pa.string())),
])
IMPORT = pa.struct([("ord", pa.int32()), ("module", pa.string()), ("name", pa.string()), ("alias", pa.string())])
SYMBOL_SQL = "ord int, qualname string, name string, kind string, start_line int, end_line int, signature string, docstring string, source string, calls array<string>, bases array<string>"
#: Files that one task reads, about, and that make one Arrow batch, at most.
FILES, BATCH = 5000, 500
EXTRACT_SQL = f"file string, source string, symbols array<struct<{SYMBOL_SQL.replace(' ', ': ').replace(',:', ',')}>>, imports array<struct<ord: int, module: string, name: string, alias: string>>"


def _dotted(node: ast.AST) -> str:
    """a.b.c of a name or attribute chain; what hangs on another expression keeps its attributes only."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


_LEAVES = (ast.Name, ast.Constant)


def _called(node: ast.AST) -> list[str]:
    """Names that are called below a node, as ast.walk meets them."""
    names: dict[str, None] = {}
    todo = [node]
    for x in todo:
        if isinstance(x, ast.Call) and (n := _dotted(x.func)):
            names[n] = None
        for field in x._fields:
            v = getattr(x, field, None)
            if isinstance(v, list):
                todo += [y for y in v if isinstance(y, ast.AST) and not isinstance(y, _LEAVES)]
            elif isinstance(v, ast.AST) and v._fields and not isinstance(v, _LEAVES):
                todo.append(v)
    return list(names)


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")


def _segment(lines: list[str], node) -> str:
    """ast.get_source_segment of a source whose lines, with their ends, are cut already; columns count bytes."""
    first, last = node.lineno - 1, node.end_lineno - 1
    if first == last:
        return lines[first].encode()[node.col_offset : node.end_col_offset].decode()
    return "".join([lines[first].encode()[node.col_offset :].decode(), *lines[first + 1 : last], lines[last].encode()[: node.end_col_offset].decode()])


def _heading(node) -> str:
    if isinstance(node, ast.ClassDef):
        return f"class {node.name}"
    lead = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    result = f" -> {ast.unparse(node.returns)}" if node.returns is not None else ""
    return f"{lead} {node.name}({ast.unparse(node.args)}){result}"


def python_file(file: str, source: str) -> tuple[list[dict], list[dict]]:
    """(symbols, imports): top-level functions, classes and their direct methods; module-level imports."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    module = file.removesuffix(".py").replace("/", ".")
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    symbols: list[dict] = []
    imports: list[dict] = []
    lines = _LINE.findall(source)

    def add(node, owner: str, kind: str) -> None:
        calls = _called(node) if isinstance(node, functions) else []
        bases = [b for x in getattr(node, "bases", []) if (n := _dotted(x)) for b in dict.fromkeys([n, n.rpartition(".")[2]])]
        symbols.append({
            "ord": len(symbols), "qualname": f"{owner}.{node.name}", "name": node.name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno,
            "signature": _heading(node), "docstring": ast.get_docstring(node) or "", "source": _segment(lines, node), "calls": calls, "bases": bases,
        })

    for node in tree.body:
        if isinstance(node, functions):
            add(node, module, "function")
        elif isinstance(node, ast.ClassDef):
            add(node, module, "class")
            for inner in node.body:
                if isinstance(inner, functions):
                    add(inner, f"{module}.{node.name}", "method")
        elif isinstance(node, ast.Import):
            imports += [{"module": a.name, "name": a.name, "alias": a.asname or a.name.partition(".")[0]} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [{"module": node.module or "", "name": a.name, "alias": a.asname or a.name} for a in node.names]
    return symbols, [{"ord": i, **x} for i, x in enumerate(imports)]


def pattern_file(file: str, source: str, language: L.Language) -> tuple[list[dict], list[dict]]:
    """As python_file, by the language's patterns; types first, so that methods find their owner."""
    lines = source.splitlines()
    module = os.path.splitext(file)[0].replace("/", ".")
    end_of = L.end_of_braces if language.blocks == "braces" else L.end_of_words
    compiled = {k: [re.compile(p) for p in getattr(language, k)] for k in ("types", "functions", "imports")}
    found: list[dict] = []
    spans: list[tuple[int, int, str]] = []

    def add(at: int, match, owner: str, kind: str, with_calls: bool) -> None:
        end = end_of(lines, at, language.comment)
        body = "\n".join(lines[at : end + 1])
        calls = list(dict.fromkeys(c for c in L.CALL.findall(body) if c not in L.NOT_CALLED)) if with_calls else []
        bases = [] if with_calls else L.base_names(match.groupdict().get("bases"))
        found.append({
            "qualname": f"{owner}.{match['name']}", "name": match["name"], "kind": kind, "start_line": at + 1, "end_line": end + 1,
            "signature": lines[at].strip()[:200], "docstring": L.comment_above(lines, at, language.comment), "source": body, "calls": calls, "bases": bases,
        })

    for at, line in enumerate(lines):
        match = next((m for p in compiled["types"] if (m := p.search(line))), None)
        if match:
            add(at, match, module, "class", False)
            spans.append((at, found[-1]["end_line"] - 1, match["name"]))
    for at, line in enumerate(lines):
        first = L.FIRST_WORD.match(line)
        if first and first[1] in L.STATEMENTS:
            continue
        match = next((m for p in compiled["functions"] if (m := p.search(line)) and m["name"] not in L.NOT_CALLED), None)
        if match:
            around = min(((e - s, n) for s, e, n in spans if s < at <= e), default=None, key=lambda x: x[0])
            add(at, match, f"{module}.{around[1]}" if around else module, "method" if around else "function", True)
    # One symbol per name and kind: the widest span, with what all of them call and extend.
    merged: dict[tuple[str, str], dict] = {}
    for symbol in found:
        key = symbol["qualname"], symbol["kind"]
        old = merged.get(key)
        if old is None:
            merged[key] = symbol
        elif symbol["end_line"] - symbol["start_line"] > old["end_line"] - old["start_line"]:
            merged[key] = symbol | {k: list(dict.fromkeys(old[k] + symbol[k])) for k in ("calls", "bases")}
    imports, block = [], False
    for line in lines:
        if ".go" in language.extensions:
            block = (block or bool(re.match(r"\s*import\s*\(\s*$", line))) and not re.match(r"\s*\)", line)
            if not block and not line.lstrip().startswith("import"):
                continue
        match = next((m for p in compiled["imports"] if (m := p.search(line))), None)
        if match:
            name = match["mod"].replace("\\", "/").rpartition("/")[2].rpartition(".")[2]
            imports.append({"ord": len(imports), "module": match["mod"], "name": name, "alias": name})
    return [{"ord": i, **s} for i, s in enumerate(merged.values())], imports


def read_file(file: str, source: str) -> tuple[list[dict], list[dict]]:
    extension = os.path.splitext(file)[1].lower()
    if extension == ".py":
        return python_file(file, source)
    return pattern_file(file, source, L.BY_EXTENSION[extension]) if extension in L.BY_EXTENSION else ([], [])


def _read(batch) -> tuple[list, list]:
    both = [read_file(f, s or "") for f, s in zip(batch.column("file").to_pylist(), batch.column("source").to_pylist())]
    return [b[0] for b in both], [b[1] for b in both]


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            yield batch.slice(lo, BATCH)


def extract(files: DataFrame) -> DataFrame:
    """(file, source) with arrays of symbols and imports."""

    def run(batches):
        for batch in _slices(batches):
            found, imported = _read(batch)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("source"), pa.array(found, pa.list_(SYMBOL)), pa.array(imported, pa.list_(IMPORT))], ["file", "source", "symbols", "imports"])

    return files.select("file", "source").mapInArrow(run, EXTRACT_SQL)


def tasks(spark: SparkSession, n_files: int) -> int:
    """Tasks that so many files are read in; by their number and not their bytes, as reading them costs far more than moving them."""
    return max(spark.sparkContext.defaultParallelism, -(-n_files // FILES))


def owners(symbols: list[dict]) -> list[int | None]:
    """For each line up to the last symbol's end the symbol (its ord) that holds it: the smallest span, then the smallest start."""
    out: list[int | None] = [None] * max((s["end_line"] for s in symbols), default=0)
    for s in sorted(symbols, key=lambda s: (s["end_line"] - s["start_line"], s["start_line"], s["ord"]), reverse=True):
        out[s["start_line"] - 1 : s["end_line"]] = [s["ord"]] * (s["end_line"] - s["start_line"] + 1)
    return out


def ordered(files: DataFrame) -> DataFrame:
    """As extract, of the distinct files, computed once, with ``before``, the number of symbols of the files before, and ``owners`` by line.

    The tasks hold ranges of paths, so whatever is exploded from here comes in the order of the paths.
    """
    spread = files.select("file", "source").repartitionByRange(tasks(files.sparkSession, files.count()), "file").distinct().sortWithinPartitions("file", "source")

    def run(batches):
        before = 0
        for batch in _slices(batches):
            found, imported = _read(batch)
            first = []
            for own in found:
                first.append(before)
                before += len(own)
            arrays = [pa.array(found, pa.list_(SYMBOL)), pa.array(imported, pa.list_(IMPORT)), pa.array(first, pa.int64()), pa.array([owners(x) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["file", "source", "__p", "symbols", "imports", "before", "owners"])

    schema = EXTRACT_SQL.replace("source string, ", "source string, __p int, ", 1) + ", before long, owners array<int>"
    kept = cut(spread.withColumn("__p", F.spark_partition_id()).mapInArrow(run, schema))
    counts = {r[0]: r[1] for r in kept.groupBy("__p").agg(F.max(F.col("before") + F.size("symbols"))).collect()}
    return kept.withColumn("before", _starts(counts, F.col("__p")) + F.col("before")).drop("__p")


def _starts(counts: dict[int, int], task):
    """How many the tasks before hold."""
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    return F.array(*[F.lit(n).cast("long") for n in starts])[task]


def counted(rows: DataFrame, name: str = "id") -> DataFrame:
    """rows, computed once, with a dense number from 1 in the order in which the tasks hold them."""
    kept = cut(rows.withColumn("__n", F.monotonically_increasing_id()))  # the task above 33 bits, the place in it below
    task = F.shiftright("__n", 33).cast("int")
    counts = {r[0]: r[1] for r in kept.groupBy(task).count().collect()}
    return kept.withColumn(name, _starts(counts, task) + F.col("__n").bitwiseAND((1 << 33) - 1) + 1).drop("__n")


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """rows with a dense number from 1 in the given order, without sorting them in one task.

    Rows are computed once, since a range partitioning reads them twice or more, and cut into ranges; each is numbered on from the counts before it.
    """
    return counted(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order), name)


def symbol_rows(extracted: DataFrame) -> DataFrame:
    """One row per symbol; ``id`` where ``extracted`` is ordered: dense over (file, order of appearance)."""
    if "before" not in extracted.columns:
        return extracted.select("file", F.explode("symbols").alias("s")).select("file", "s.*")
    return extracted.select("file", "before", F.explode("symbols").alias("s")).select("file", "s.*", (F.col("before") + F.col("s.ord") + 1).alias("id"))


def symbols(extracted: DataFrame) -> DataFrame:
    """One row per symbol with a dense id over (file, order of appearance)."""
    rows = symbol_rows(extracted)
    return rows if "id" in rows.columns else numbered(rows, ["file", "ord"])


def imports(extracted: DataFrame) -> DataFrame:
    return extracted.select("file", F.explode("imports").alias("i")).select("file", "i.*")


def references(symbol_rows: DataFrame, own: tuple[str, ...] = ("id",)) -> DataFrame:
    """(src, ref, kind) before resolution; own: other columns of the symbol in place of its id, id as src."""
    keep = [F.col(c).alias({"id": "src", "qualname": "src_name"}.get(c, c)) for c in own]
    side = lambda column, kind: F.transform(column, lambda x: F.struct(x.alias("ref"), F.lit(kind).alias("kind")))
    return symbol_rows.select(*keep, F.explode(F.concat(side("calls", "calls"), side("bases", "inherits"))).alias("r")).select(*[c for c in ({"id": "src", "qualname": "src_name"}.get(x, x) for x in own)], "r.ref", "r.kind")


def file_table(extracted: DataFrame) -> DataFrame:
    return extracted.select("file", F.size(T.split_lines(F.col("source"))).cast("long").alias("line_count"), T.token_estimate(F.col("source")).alias("tokens"), "source")
