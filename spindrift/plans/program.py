"""A program whose sources follow from the driver tables: files to extract, resolve and search, with known results.

Every nation is a Python module, every customer a module that uses its nation's, every tenth customer has a test,
every supplier is a file in one of four other languages.  The expected symbols, references, imports and edges
are written down here by hand, per template; ``{a}`` is the row's key, ``{b}`` the key that it refers to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import extract
from spindrift.plans.corpus import table
from spindrift.sources import repo

#: template -> (path, source)
SOURCES = {
    "base": ("geo/base.py", """class Base:
    pass


def open_door(who):
    return who


def scale(x):
    return x


def append(x):
    return eval(x)
"""),
    "nation": ("geo/n{a}.py", '''"""Nation {a}."""
import geo.base as gb
from geo.base import open_door as knock


class Nation{a}(Base):
    """Holds nation {a}."""

    def greet(self, who: str) -> str:
        self.log(who)
        return knock(who)

    def log(self, who):
        print(who)  # TODO


def rate_{a}(x, y=1):
    return gb.scale(x) + y


async def twice_{a}(x):
    """Two rates.

    token = "no"
    """
    x.append(x)
    return rate_{a}(rate_{a}(x))
'''),
    "customer": ("shop/c{a}.py", """from geo.n{b} import rate_{b} as rate
import geo.n{b} as home


class Customer{a}(home.Nation{b}):
    def total(self, x):
        self.total(x)
        x.thing.open_door(x)
        return rate(x)


def visit_{a}(x):
    x = Customer{a}()
    try:
        x.append(1)
    except Exception:
        api_key = "k{a}"
    if x == 1:
        assert False
    return home.rate_{b}(x)
"""),
    "test": ("tests/test_c{a}.py", """#!/bin/sh
from shop.c{a} import visit_{a}


@mark
def test_visit_{a}():
    # Visits.
    assert visit_{a}(1)
"""),
    "ts": ("web/s{a}.ts", """import { draw } from './draw'

// Shows supplier {a}.
export class Page{a} extends View {
  render_{a}(x: number) {
    draw(x)
    return paint_{a}(x)
  }
}

export const paint_{a} = async (x) => {
  return new Page{a}().render_{a}(x)
}
"""),
    "go": ("srv/s{a}.go", """package srv

import (
\t"fmt"
\tnet "net/http"
)

type Server{a} struct {
\tport int
}

// Run{a} starts it.
func (s *Server{a}) Run{a}() {
\tfmt.Println(help{a}(s.port))
}

func help{a}(p int) int {
\treturn p
}
"""),
    "java": ("srv/S{a}.java", """import java.util.List;

/* Jar of {a}. */
public class Jar{a} extends Box{a} implements Thing {
  @Override
  public int size{a}(List<String> x) {
    return count{a}(x);
  }

  private static int count{a}(List<String> x) {
    return x.size();
  }
}

abstract class Box{a} {
}
"""),
    "rb": ("lib/s{a}.rb", """require 'json'

module Kit{a}
  # Says {a}.
  def self.say{a}(x)
    if x
      shout{a}(x)
    end
  end

  def shout{a}(x)
    puts(x)
  end
end
"""),
}

#: (template, qualname, kind, first line, last line, signature, docstring), in the order of appearance; other languages: types first
SYMBOLS = [
    ("base", "geo.base.Base", "class", 1, 2, "class Base", ""),
    ("base", "geo.base.open_door", "function", 5, 6, "def open_door(who)", ""),
    ("base", "geo.base.scale", "function", 9, 10, "def scale(x)", ""),
    ("base", "geo.base.append", "function", 13, 14, "def append(x)", ""),
    ("nation", "geo.n{a}.Nation{a}", "class", 6, 14, "class Nation{a}", "Holds nation {a}."),
    ("nation", "geo.n{a}.Nation{a}.greet", "method", 9, 11, "def greet(self, who: str) -> str", ""),
    ("nation", "geo.n{a}.Nation{a}.log", "method", 13, 14, "def log(self, who)", ""),
    ("nation", "geo.n{a}.rate_{a}", "function", 17, 18, "def rate_{a}(x, y=1)", ""),
    ("nation", "geo.n{a}.twice_{a}", "function", 21, 27, "async def twice_{a}(x)", 'Two rates.\n\ntoken = "no"'),
    ("customer", "shop.c{a}.Customer{a}", "class", 5, 9, "class Customer{a}", ""),
    ("customer", "shop.c{a}.Customer{a}.total", "method", 6, 9, "def total(self, x)", ""),
    ("customer", "shop.c{a}.visit_{a}", "function", 12, 20, "def visit_{a}(x)", ""),
    ("test", "tests.test_c{a}.test_visit_{a}", "function", 6, 8, "def test_visit_{a}()", ""),
    ("ts", "web.s{a}.Page{a}", "class", 4, 9, "export class Page{a} extends View {", "Shows supplier {a}."),
    ("ts", "web.s{a}.Page{a}.render_{a}", "method", 5, 8, "render_{a}(x: number) {", ""),
    ("ts", "web.s{a}.paint_{a}", "function", 11, 13, "export const paint_{a} = async (x) => {", ""),
    ("go", "srv.s{a}.Server{a}", "class", 8, 10, "type Server{a} struct {", ""),
    ("go", "srv.s{a}.Run{a}", "function", 13, 15, "func (s *Server{a}) Run{a}() {", "Run{a} starts it."),
    ("go", "srv.s{a}.help{a}", "function", 17, 19, "func help{a}(p int) int {", ""),
    ("java", "srv.S{a}.Jar{a}", "class", 4, 13, "public class Jar{a} extends Box{a} implements Thing {", "Jar of {a}."),
    ("java", "srv.S{a}.Box{a}", "class", 15, 16, "abstract class Box{a} {", ""),
    ("java", "srv.S{a}.Jar{a}.size{a}", "method", 6, 8, "public int size{a}(List<String> x) {", ""),
    ("java", "srv.S{a}.Jar{a}.count{a}", "method", 10, 12, "private static int count{a}(List<String> x) {", ""),
    ("rb", "lib.s{a}.Kit{a}", "class", 3, 14, "module Kit{a}", ""),
    ("rb", "lib.s{a}.Kit{a}.say{a}", "method", 5, 9, "def self.say{a}(x)", "Says {a}."),
    ("rb", "lib.s{a}.Kit{a}.shout{a}", "method", 11, 13, "def shout{a}(x)", ""),
]
#: (template, source, reference, kind)
REFERENCES = [
    ("base", "geo.base.append", "eval", "calls"),
    ("nation", "geo.n{a}.Nation{a}", "Base", "inherits"),
    ("nation", "geo.n{a}.Nation{a}.greet", "self.log", "calls"), ("nation", "geo.n{a}.Nation{a}.greet", "knock", "calls"),
    ("nation", "geo.n{a}.Nation{a}.log", "print", "calls"), ("nation", "geo.n{a}.rate_{a}", "gb.scale", "calls"),
    ("nation", "geo.n{a}.twice_{a}", "x.append", "calls"), ("nation", "geo.n{a}.twice_{a}", "rate_{a}", "calls"),
    ("customer", "shop.c{a}.Customer{a}", "home.Nation{b}", "inherits"), ("customer", "shop.c{a}.Customer{a}", "Nation{b}", "inherits"),
    ("customer", "shop.c{a}.Customer{a}.total", "self.total", "calls"), ("customer", "shop.c{a}.Customer{a}.total", "x.thing.open_door", "calls"),
    ("customer", "shop.c{a}.Customer{a}.total", "rate", "calls"),
    ("customer", "shop.c{a}.visit_{a}", "Customer{a}", "calls"), ("customer", "shop.c{a}.visit_{a}", "x.append", "calls"), ("customer", "shop.c{a}.visit_{a}", "home.rate_{b}", "calls"),
    ("test", "tests.test_c{a}.test_visit_{a}", "visit_{a}", "calls"),
    ("ts", "web.s{a}.Page{a}", "View", "inherits"),
    ("ts", "web.s{a}.Page{a}.render_{a}", "render_{a}", "calls"), ("ts", "web.s{a}.Page{a}.render_{a}", "draw", "calls"), ("ts", "web.s{a}.Page{a}.render_{a}", "paint_{a}", "calls"),
    ("ts", "web.s{a}.paint_{a}", "async", "calls"), ("ts", "web.s{a}.paint_{a}", "Page{a}", "calls"),
    ("go", "srv.s{a}.Run{a}", "Run{a}", "calls"), ("go", "srv.s{a}.Run{a}", "help{a}", "calls"), ("go", "srv.s{a}.help{a}", "help{a}", "calls"),
    ("java", "srv.S{a}.Jar{a}", "Box{a}", "inherits"),
    ("java", "srv.S{a}.Jar{a}.size{a}", "size{a}", "calls"), ("java", "srv.S{a}.Jar{a}.size{a}", "count{a}", "calls"), ("java", "srv.S{a}.Jar{a}.count{a}", "count{a}", "calls"),
    ("rb", "lib.s{a}.Kit{a}.say{a}", "shout{a}", "calls"), ("rb", "lib.s{a}.Kit{a}.shout{a}", "shout{a}", "calls"), ("rb", "lib.s{a}.Kit{a}.shout{a}", "puts", "calls"),
]
#: (template, module, name, alias)
IMPORTS = [
    ("nation", "geo.base", "geo.base", "gb"), ("nation", "geo.base", "open_door", "knock"),
    ("customer", "geo.n{b}", "rate_{b}", "rate"), ("customer", "geo.n{b}", "geo.n{b}", "home"), ("test", "shop.c{a}", "visit_{a}", "visit_{a}"),
    ("ts", "./draw", "draw", "draw"), ("go", "fmt", "fmt", "fmt"), ("go", "net/http", "http", "http"), ("java", "java.util.List", "List", "List"), ("rb", "json", "json", "json"),
]
#: (template, source, target, kind): what the references mean
EDGES = [
    ("nation", "geo.n{a}.Nation{a}", "geo.base.Base", "inherits"),
    ("nation", "geo.n{a}.Nation{a}.greet", "geo.n{a}.Nation{a}.log", "calls"), ("nation", "geo.n{a}.Nation{a}.greet", "geo.base.open_door", "calls"),
    ("nation", "geo.n{a}.rate_{a}", "geo.base.scale", "calls"), ("nation", "geo.n{a}.twice_{a}", "geo.n{a}.rate_{a}", "calls"),
    ("customer", "shop.c{a}.Customer{a}", "geo.n{b}.Nation{b}", "inherits"),
    ("customer", "shop.c{a}.Customer{a}.total", "geo.base.open_door", "calls"), ("customer", "shop.c{a}.Customer{a}.total", "geo.n{b}.rate_{b}", "calls"),
    ("customer", "shop.c{a}.visit_{a}", "shop.c{a}.Customer{a}", "calls"), ("customer", "shop.c{a}.visit_{a}", "geo.n{b}.rate_{b}", "calls"),
    ("test", "tests.test_c{a}.test_visit_{a}", "shop.c{a}.visit_{a}", "calls"),
    ("ts", "web.s{a}.Page{a}.render_{a}", "web.s{a}.paint_{a}", "calls"), ("ts", "web.s{a}.paint_{a}", "web.s{a}.Page{a}", "calls"),
    ("go", "srv.s{a}.Run{a}", "srv.s{a}.help{a}", "calls"),
    ("java", "srv.S{a}.Jar{a}", "srv.S{a}.Box{a}", "inherits"), ("java", "srv.S{a}.Jar{a}.size{a}", "srv.S{a}.Jar{a}.count{a}", "calls"),
    ("rb", "lib.s{a}.Kit{a}.say{a}", "lib.s{a}.Kit{a}.shout{a}", "calls"),
]


def _values(name: str, columns: str, rows) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows) + ")"


def _fill(*columns: str) -> str:
    return ", ".join(f"replace(replace({c}, '{{a}}', a), '{{b}}', b) AS {c}" for c in columns)


#: The program as SQL: pf (file, source), ps (symbols), pr (references), pi (imports), pe (edges).
SQL = f"""keys AS (SELECT 'base' AS t, '' AS a, '' AS b
UNION ALL SELECT 'nation', n_nationkey::VARCHAR, '' FROM nation
UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'test', c_custkey::VARCHAR, '' FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT ['ts', 'go', 'java', 'rb'][s_suppkey % 4 + 1], s_suppkey::VARCHAR, '' FROM supplier),
{_values('xf', 't, file, source', [(t, *x) for t, x in SOURCES.items()])},
{_values('xs', 't, qualname, kind, start_line, end_line, signature, docstring, ord', [(*x, n) for n, x in enumerate(SYMBOLS)])},
{_values('xr', 't, src, ref, kind', REFERENCES)},
{_values('xi', 't, module, name, alias', IMPORTS)},
{_values('xe', 't, src, dst, kind', EDGES)},
pf AS (SELECT t, a, {_fill('file', 'source')} FROM keys JOIN xf USING (t)),
ps AS (SELECT row_number() OVER (ORDER BY file, ord) AS id, s.*, string_split(qualname, '.')[-1] AS name, file FROM (SELECT t, a, {_fill('qualname', 'signature', 'docstring')}, kind, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, ord FROM keys JOIN xs USING (t)) s JOIN pf USING (t, a)),
pr AS (SELECT {_fill('src', 'ref')}, kind FROM keys JOIN xr USING (t)),
pi AS (SELECT file, i.module, i.name, i.alias FROM (SELECT t, a, {_fill('module', 'name', 'alias')} FROM keys JOIN xi USING (t)) i JOIN pf USING (t, a)),
pe AS (SELECT {_fill('src', 'dst')}, kind FROM keys JOIN xe USING (t)),
pcut AS (SELECT file, string_split(source, chr(10)) AS a FROM pf),
pl AS (SELECT file, unnest(range(1, len(a))) AS line_no, unnest(a[:-2]) AS txt FROM pcut)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source) of the program; the keys are spread over tasks before the texts are made of them."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda c: F.col(c).cast("string")
    customer, supplier = t("customer"), t("supplier")
    keys = [
        spark.range(1).select(F.lit("base").alias("t"), F.lit("").alias("a"), F.lit("").alias("b")),
        t("nation").select(F.lit("nation"), text("n_nationkey"), F.lit("")),
        customer.select(F.lit("customer"), text("c_custkey"), text("c_nationkey")),
        customer.where("c_custkey % 10 = 0").select(F.lit("test"), text("c_custkey"), F.lit("")),
        supplier.select(F.element_at(F.array(*[F.lit(x) for x in ("ts", "go", "java", "rb")]), (F.col("s_suppkey") % 4 + 1).cast("int")), text("s_suppkey"), F.lit("")),
    ]
    rows = keys[0]
    for k in keys[1:]:
        rows = rows.union(k)
    templates = spark.createDataFrame([(k, *x) for k, x in SOURCES.items()], "t string, file string, source string")
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")).alias(c)
    rows = rows.repartition(extract.tasks(spark, customer.count() + supplier.count()), "t", "a", "b")
    return rows.join(F.broadcast(templates), "t").select(fill("file"), fill("source"))


#: Lines of a chunk of the program and how many two chunks share: the files are short.
CHUNK, OVERLAP = 10, 2
_BUILT: dict[tuple[str, str], repo.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> repo.Index:
    """The program's index, one per session and table folder; a query makes the tables that it reads."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        _BUILT[key] = repo.build(files(spark, sf_dir), CHUNK, OVERLAP)
    return _BUILT[key]
