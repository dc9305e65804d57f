"""Driver-side loops around a caller's model: attempts, verdicts, tools.  Nothing here runs proposed code.

Attempts and verdicts are records; ``as_table`` turns them into a DataFrame for the run analytics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from spindrift.functions import parse


@dataclass
class Check:
    ok: bool
    signal: float
    kind: str
    detail: dict = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


def function_check(kind: str, test: Callable) -> Callable[[object], Check]:
    """A check from a function that returns a truth value or (ok, signal, detail); an exception fails."""

    def run(artifact) -> Check:
        try:
            got = test(artifact)
        except Exception as e:  # noqa: BLE001 - whatever a caller's check raises is its verdict
            return Check(False, 0.0, kind, errors=[f"{type(e).__name__}: {e}"])
        if isinstance(got, tuple):
            ok, signal, detail = (*got, {})[:3]
            return Check(bool(ok), float(signal), kind, detail or {})
        return Check(bool(got), 2.0 if got else 0.0, kind)

    return run


def schema_check(required: dict[str, type]) -> Callable[[object], Check]:
    def run(artifact) -> Check:
        if not isinstance(artifact, dict):
            return Check(False, 0.0, "schema", errors=["not a record"])
        errors = [f"missing key: {k}" for k in required if k not in artifact]
        errors += [f"{k} is no {t.__name__}" for k, t in required.items() if k in artifact and not isinstance(artifact[k], t)]
        return Check(not errors, 0.0 if errors else 2.0, "schema", errors=errors)

    return run


def totals_check(expected: dict[str, float]) -> Callable[[object], Check]:
    """Group totals must agree exactly."""

    def run(artifact) -> Check:
        if not isinstance(artifact, dict):
            return Check(False, 0.0, "reconcile", errors=["not a record"])
        errors = [f"missing {g}" if artifact.get(g) is None else f"{g}: {artifact[g]} instead of {t}" for g, t in expected.items() if artifact.get(g) != t]
        errors += [f"unexpected {g}" for g in artifact if g not in expected]
        return Check(not errors, 0.0 if errors else 2.0, "reconcile", {"expected": expected}, errors)

    return run


def code_check(blocks: list[dict]) -> Check:
    """Whether proposed files ({path, code}) compile; they are never run."""
    if not blocks:
        return Check(False, -1.0, "coding", errors=["no files"])
    errors = [f"{b['path']}: {e}" for b in blocks if (e := parse.compile_error(b["path"], b["code"]))]
    return Check(not errors, 0.0 if errors else 1.0, "coding", errors=errors)


@dataclass
class Verdict:
    """A checked proposal.  Only the check accepts it; a critique, by somebody other than its author, breaks ties."""
    check: Check
    artifact: object
    critique: dict | None
    score: float

    @property
    def accepted(self) -> bool:
        return self.check.ok


def critique(reply: str | None) -> dict:
    """{"satisfies", "issues"} of a critic's reply; at most eight issues."""
    said = parse.first_object(reply)
    if said is None:
        return {"satisfies": False, "issues": ["the critic's reply cannot be read"]}
    issues = said.get("issues") or []
    return {"satisfies": bool(said.get("satisfies", False)), "issues": [str(i) for i in (issues if isinstance(issues, list) else [issues])][:8]}


def verdict(artifact, check: Callable[[object], Check], critic: Callable[[object], str] | None = None) -> Verdict:
    """Checked first; then, if there is anything proposed, criticised.  Without a proposal the score is -1."""
    got = check(artifact)
    said = critique(critic(artifact)) if critic is not None and artifact else None
    tie = 0.0 if said is None else 0.15 if said["satisfies"] else -0.05 * len(said["issues"])
    return Verdict(got, artifact, said, round(got.signal + tie, 3) if artifact else -1.0)


def best_verdict(verdicts: list[Verdict]) -> Verdict | None:
    """Of most signal, then accepted, then score, then fewest errors, then the first."""
    return max(enumerate(verdicts), key=lambda p: (p[1].check.signal, p[1].accepted, p[1].score, -len(p[1].check.errors), -p[0]), default=(0, None))[1]


def adaptive(produce: Callable[[str, float], object], check: Callable[[object], Check], samples: int = 6, stuck_after: int = 2, on_event: Callable | None = None) -> tuple[Verdict | None, list[Verdict], str]:
    """(best, all, "solved", "stuck" or "budget"): one sample more only while the last failed, each time warmer and with its errors.

    ``produce(feedback, temperature)``.  ``stuck_after`` samples without any signal in a row end it.  Of equal samples
    the first is best.
    """
    tell = on_event or (lambda *_: None)
    tried: list[Verdict] = []
    best, feedback, idle, tenths = None, "", 0, 1
    for number in range(1, samples + 1):
        now = verdict(produce(feedback, tenths / 10), check)
        tried.append(now)
        tell("check", {"attempt": number, "ok": now.check.ok, "signal": now.check.signal})
        if best is None or now.check.signal > best.check.signal:
            best = now
        idle = idle + 1 if now.check.signal == 0 else 0
        if now.accepted or idle >= stuck_after:
            tell("outcome", {"resolved": now.accepted, "won_by": "adaptive", "attempts": number})
            return (now, tried, "solved") if now.accepted else (best, tried, "stuck")
        tenths = min(10, tenths + 2)
        feedback = "\n".join(f"- {e}" for e in now.check.errors) or "Try another way."
        tell("repair", {"attempt": number, "feedback": feedback})
    tell("outcome", {"resolved": False, "won_by": "adaptive", "attempts": samples})
    return best, tried, "budget"


@dataclass
class Attempt:
    number: int
    artifact: object
    check: Check


def solve(produce: Callable[[str], object], check: Callable[[object], Check], attempts: int = 3, patience: int = 2, on_event: Callable | None = None) -> tuple[Attempt | None, list[Attempt]]:
    """(best, all): asks again with the errors as feedback until one passes, or ``patience`` attempts in a row have no signal.

    Of equal attempts the first is best.
    """
    tried: list[Attempt] = []
    best, feedback, idle = None, "", 0
    for number in range(1, attempts + 1):
        artifact = produce(feedback)
        got = check(artifact)
        tried.append(Attempt(number, artifact, got))
        if on_event:
            on_event("check", {"attempt": number, "ok": got.ok, "signal": got.signal})
        if best is None or (got.signal, got.ok) > (best.check.signal, best.check.ok):
            best = tried[-1]
        idle = idle + 1 if got.signal <= 0 else 0
        if got.ok or idle >= patience:
            break
        feedback = "\n".join(got.errors)[:500]
        if on_event:
            on_event("repair", {"attempt": number, "feedback": feedback})
    return best, tried


def best_of(candidates: list, check: Callable[[object], Check]) -> Attempt | None:
    """The candidate of most signal, then ok, then fewest errors, then the first."""
    tried = [Attempt(n, c, check(c)) for n, c in enumerate(candidates, 1)]
    return max(tried, key=lambda a: (a.check.signal, a.check.ok, -len(a.check.errors), -a.number), default=None)


def as_table(spark: SparkSession, run: str, tried: list[Attempt]) -> DataFrame:
    rows = [(run, a.number, a.check.ok, float(a.check.signal), a.check.kind, len(a.check.errors)) for a in tried]
    return spark.createDataFrame(rows, "run string, attempt int, ok boolean, signal double, kind string, n_errors int")


# --- tools ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "string"
    required: bool = True
    default: object = None


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    params: tuple[Param, ...]
    call: Callable

    def spec(self) -> str:
        return f"{self.name}({', '.join(f'{p.name}:{p.kind}' + '?' * (not p.required) for p in self.params)}) - {self.about}"


class Tools:
    """Named tools with typed parameters; names are matched loosely, arguments are coerced."""

    def __init__(self, tools: list[Tool]):
        self.by_name = {t.name: t for t in tools}

    def specs(self) -> str:
        return "\n".join(t.spec() for t in self.by_name.values())

    def arguments(self, tool: Tool, given: dict) -> dict:
        out = {}
        for p in tool.params:
            value = given.get(p.name, p.default)
            if p.required and p.name not in given:
                raise parse.ArgumentError(f"{tool.name} needs {p.name}")
            out[p.name] = p.default if value is None else parse.coerce(p.name, p.kind, value)
        return out

    def run(self, name: str, given: dict | None = None) -> object:
        known = parse.closest(name, list(self.by_name))
        if known is None:
            raise parse.ArgumentError(f"no tool is called {name}; there are {', '.join(self.by_name)}")
        tool = self.by_name[known]
        return tool.call(**self.arguments(tool, given or {}))


def index_tools(index) -> Tools:
    """The questions of an index as tools."""
    from spindrift.plans import context

    text, optional = Param("query"), lambda n, k="string", d=None: Param(n, k, False, d)
    return Tools([
        Tool("search_code", "symbols, chunks and files for a query", (text, optional("top", "integer", 8)), lambda query, top: context.search_code(index, query, top)),
        Tool("get_context", "what to read for a task", (Param("task"), optional("token_budget", "integer", 4000)), lambda task, token_budget: context.get_context(index, task, token_budget)),
        Tool("inspect_code", "a symbol, range or file", (optional("file"), optional("symbol"), optional("start_line", "integer"), optional("end_line", "integer")), lambda **a: context.inspect(index, **a)),
        Tool("analyze_impact", "what a change touches", (optional("file"), optional("symbol")), lambda **a: context.impact(index, **a)),
        Tool("plan", "steps for a task", (Param("task"),), lambda task: context.graph_plan(context.get_context(index, task))),
        Tool("read_file", "a file of the index", (Param("path"),), lambda path: context.file_source(index, path)),
        Tool("verify", "whether code compiles", (Param("path"), Param("code")), lambda path, code: asdict(code_check([{"path": path, "code": code}]))),
    ])


def tool_loop(ask: Callable[[str], str], tools: Tools, task: str, steps: int = 6) -> list[dict]:
    """Call log of a model that names one tool per reply; a reply without a call, or the tool "finish", ends it."""
    log: list[dict] = []
    said = f"{task}\n{tools.specs()}"
    for step in range(1, steps + 1):
        call = parse.tool_call(ask(said))
        if call is None or call["tool"] == "finish":
            break
        try:
            seen, ok = tools.run(call["tool"], call["args"]), True
        except parse.ArgumentError as e:
            seen, ok = str(e), False
        log.append({"step": step, "tool": call["tool"], "args": call["args"], "ok": ok, "observation": str(seen)[:1600]})
        said = log[-1]["observation"]
    return log
