"""Small results as Markdown."""

from __future__ import annotations


def table(rows: list[dict], columns: list[str]) -> str:
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    return "\n".join([head, *[f"| {' | '.join(str(r.get(c, '')) for c in columns)} |" for r in rows]])


def dossier(context: dict) -> str:
    """A context package to read."""
    out = [f"# {context['task']}", f"{context.get('fits_in', 0)} of {context['token_budget']} tokens"]
    for f in context["files_to_edit"]:
        out.append(f"## {f['path']} ({f['mode']}, {f['tokens']} tokens)\n```\n{f['full_source']}```")
    for title, key, columns in (
        ("Ranked symbols", "ranked_symbols", ["qualname", "file", "score"]), ("Around", "periphery", ["qualname", "relation", "one_line_summary"]),
        ("Tests", "relevant_tests", ["qualname", "file"]), ("Findings", "quality_signals", ["file", "line_no", "severity", "code"]), ("Edges", "dependency_edges", ["from", "kind", "to"]),
    ):
        if context[key]:
            out.append(f"## {title}\n{table(context[key], columns)}")
    for c in context["relevant_chunks"]:
        out.append(f"## {c['file']}:{c['start_line']}-{c['end_line']}\n```\n{c['text']}\n```")
    return "\n\n".join([*out, *[f"- {n}" for n in context["notes"]]])


def numbers(stats: dict) -> str:
    """Statistics to read."""
    out = ["# Index", *[f"- {k}: {v}" for k, v in stats.items() if isinstance(v, int)]]
    for key in ("hubs", "entrypoints", "largest_files", "quality_hotspots", "dependency_hotspots"):
        if stats[key]:
            out.append(f"## {key}\n{table(stats[key], list(stats[key][0]))}")
    return "\n\n".join(out)


def hint(similar: list[dict], files: list[str], approach: str | None) -> str:
    """What past runs suggest; empty without any."""
    if not similar:
        return ""
    out = ["## Past runs (for orientation only)"]
    out += [f"- {'solved' if s['resolved'] else 'failed'}: {s['task']} (similarity {s['similarity']}, {s['won_by']})" for s in similar]
    return "\n".join(out + [f"- files that helped: {', '.join(files)}"] * bool(files) + [f"- approach that helped: {approach}"] * bool(approach))


def timeline(events: list[dict]) -> str:
    """Run-log events, one a line."""
    return "\n".join(f"{e['t']:8.3f} {e['kind']:<11} " + " ".join(f"{k}={v}" for k, v in sorted((e.get("data") or {}).items())) for e in sorted(events, key=lambda e: e["seq"]))
