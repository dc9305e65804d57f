"""Column functions over source text: lines, roles, rule findings, identifier terms, small parsers.

All are built-in expressions, so they stay inside code generation and serve batch and streaming alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query about code.
STOP_WORDS = tuple(
    "without with using update to this the per or on of make keep it is into in from for change by be at as are and an add a".split()
)
IDENTIFIER = r"[A-Za-z_]\w*"
#: Java's \w is ASCII only, like the identifiers meant here.
PIECES = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def stripped(text: Column) -> Column:
    """Without white space at both ends (also tabs and line ends, unlike trim)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1; 0 for empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line; empty text has none."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(cut)


def _begins(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


CONTROL = ("case ", "match ", "with ", "finally:", "except ", "try:", "while ", "for ", "else:", "elif ", "if ")


def line_role(text: Column, s: Column | None = None) -> Column:
    """One of ten roles, the first that fits; s: the stripped text, if it is a column already."""
    s = stripped(text) if s is None else s
    return (
        F.when(s == "", "blank")
        .when(_begins(s, "#"), "comment")
        .when(_begins(s, "from ", "import "), "import")
        .when(_begins(s, "@"), "decorator")
        .when(_begins(s, "class ", "def ", "async def "), "definition")
        .when(_begins(s, *CONTROL), "control_flow")
        .when(_begins(s, "return "), "return")
        .when(s.contains("=") & ~s.contains("=="), "assignment")
        .when(s.contains("("), "call_or_expression")
        .when(s.endswith(")"), "call_or_expression")
        .otherwise("expression")
    )


#: Quoted strings.  Possessive loops run without recursion, so long strings need no stack.
LITERAL = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
MESSAGES = {
    "long_line": ("info", "More than 120 characters in one line."),
    "todo": ("info", "Open TODO or FIXME."),
    "debug_print": ("info", "Print call left in code."),
    "dynamic_exec": ("high", "Runs text as code."),
    "broad_except": ("medium", "Catches every exception."),
    "possible_secret": ("high", "A credential seems to be written into the source."),
    "assert_false": ("medium", "Assertion that always fails."),
    "non_python_shebang": ("info", "Interpreter line of another language."),
}


def masked(s: Column) -> Column:
    """A line with its quoted strings emptied."""
    return F.when(s.contains("'") | s.contains('"'), F.regexp_replace(s, LITERAL, '""')).otherwise(s)


#: What a line must hold to break any rule but that of its length; most lines are told apart by it alone.
SUSPECT = r"(?iu)todo|fixme|print\(|exec\(|eval\(|except|password|token|secret|api_key|assert false|^\s*#!"


def finding_codes(text: Column, line_no: Column, s: Column | None = None, code: Column | None = None) -> Column:
    """Codes of all rules a line breaks, in the order of MESSAGES; s and code: stripped and masked text, if columns already."""
    s = stripped(text) if s is None else s
    code = masked(s) if code is None else code
    low = F.lower(code)
    at = F.instr(s, "=")
    left = F.lower(F.substring(s, F.lit(1), at - 1))
    right = F.substring(s, at + 1, F.length(s))
    name = F.regexp_replace(stripped(left), ":+$", "")
    term = F.lit(False)
    for word in ("password", "token", "secret", "api_key"):
        term = term | left.contains(word)
    listed = name.endswith("keys") | name.endswith("names") | name.endswith("terms")
    rules = {
        "long_line": F.length(text) > 120,
        "todo": low.contains("fixme") | low.contains("todo"),
        "debug_print": s.startswith("print("),
        "dynamic_exec": code.contains("exec(") | code.contains("eval("),
        "broad_except": s.startswith("except Exception:") | s.startswith("except:"),
        "possible_secret": (at > 0) & term & ~listed & (right.contains('"') | right.contains("'")),
        "assert_false": code.contains("assert False"),
        "non_python_shebang": (line_no == 1) & s.startswith("#!") & ~s.contains("python"),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(c)) for c, rule in rules.items()]), lambda c: c.isNotNull())
    return F.when((F.length(text) > 120) | s.rlike(SUSPECT), broken).otherwise(F.array().cast("array<string>"))


def severity_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, (severity, _) in MESSAGES.items():
        out = F.when(code == c, severity).otherwise(out)
    return out


def message_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, (_, message) in MESSAGES.items():
        out = F.when(code == c, message).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def terms(text: Column) -> Column:
    """Search terms of a text, repeats included: the pieces of every identifier and the whole of it, lower-case.

    A plain word is both its only piece and the whole, so it counts twice.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    split = F.transform(words, lambda w: F.concat(F.regexp_extract_all(w, F.lit(PIECES), F.lit(0)), F.array(w)))
    return F.filter(F.transform(F.flatten(split), F.lower), lambda t: ~t.isin(*STOP_WORDS))


def one_line(docstring: Column, signature: Column) -> Column:
    """First line of the docstring, else the signature."""
    return F.when(docstring != "", F.split(stripped(docstring), "\n")[0]).otherwise(signature)


def is_test_path(file: Column, name: Column) -> Column:
    """Test symbols by the narrow rule: base name, folder or name prefix."""
    low = F.lower(file)
    return F.substring_index(low, "/", -1).contains("test") | name.startswith("test_") | low.contains("/tests/")


def is_test_anywhere(file: Column, name: Column) -> Column:
    """Test symbols by the wide rule: "test" anywhere in the path."""
    return F.lower(file).contains("test") | name.startswith("test_")


def safe_path(root: Column, rel: Column) -> Column:
    """root/rel with . and .. resolved; null if rel is empty, absolute, has a drive or leaves root."""
    parts = F.filter(F.split(rel, "/"), lambda p: (p != "") & (p != "."))
    # Folded as a list; once it climbs above the root it stays marked.
    joined = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..") , F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
    )
    outside = F.coalesce(F.element_at(F.concat(joined, F.array(F.lit("x"))), 1) == "..", F.lit(False))
    bad = rel.isNull() | (rel == "") | rel.startswith("/") | rel.rlike(r"^[A-Za-z]:") | outside
    return F.when(~bad, F.when(F.size(joined) == 0, root).otherwise(F.concat(root, F.lit("/"), F.array_join(joined, "/"))))


def strip_reasoning(text: Column, tag: str = "think") -> Column:
    """Without <tag> blocks; after a lone closing tag only what follows it stays."""
    done = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    tail = F.when(done.contains(f"</{tag}>"), F.substring_index(done, f"</{tag}>", -1)).otherwise(done)
    return stripped(F.replace(tail, F.lit(f"<{tag}>"), F.lit("")))


FILE_BLOCK = r"(?s)FILE:\s*([^\n]+)\n```[\w+-]*\n(.*?)```"


def file_blocks(text: Column) -> Column:
    """array<struct<path, code>> of the FILE blocks of a reply."""
    paths = F.regexp_extract_all(text, F.lit(FILE_BLOCK), F.lit(1))
    codes = F.regexp_extract_all(text, F.lit(FILE_BLOCK), F.lit(2))
    return F.transform(F.arrays_zip(paths.alias("path"), codes.alias("code")), lambda b: F.struct(stripped(b["path"]).alias("path"), b["code"].alias("code")))


def char_count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def exec_signal(compiled: Column, tests_ran: Column, tests_passed: Column, types_ok: Column) -> Column:
    """0 if it does not compile, else 1, +1.5 or -0.5 for tests, +0.5 or -0.25 for types; never below 0."""
    tests = F.when(tests_ran, F.when(tests_passed, 1.5).otherwise(-0.5)).otherwise(0.0)
    types = F.when(types_ok, 0.5).when(~types_ok, -0.25).otherwise(0.0)
    return F.when(~compiled, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) + tests + types))


def verdict_score(signal: Column, n_files: Column, satisfies: Column, n_issues: Column) -> Column:
    """The signal with a critique as a tie-break only; -1 without files."""
    tie = F.when(satisfies, 0.15).when(~satisfies, -0.05 * n_issues).otherwise(0.0)
    return F.when(n_files == 0, -1.0).otherwise(F.round(signal + tie, 3))


def risk_score(callers: Column, tests: Column, high: Column, medium: Column) -> Column:
    return F.least(F.lit(100).cast("long"), callers * 10 + tests * 6 + high * 25 + medium * 12)


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")


def clip(text: Column, limit: int = 1600) -> Column:
    """struct(truncated, preview) of an observation."""
    return F.struct((F.length(text) > limit).alias("truncated"), F.left(text, F.lit(limit)).alias("preview"))


def mentions_file(text: Column, file: Column) -> Column:
    """Whether a plan names a file by its path, base name or stem."""
    base = F.substring_index(file, "/", -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return text.contains(file) | text.contains(base) | ((stem != "") & text.contains(stem))
