"""Secret scan: pattern spans, and candidate strings judged by sliding-window Shannon entropy.

Base spans (code points, end exclusive), leftmost and non-overlapping per kind: ``assign`` (a credential
name, a separator and a value of 12 or more characters), ``access`` (AKIA keys of 18 or more) and ``hex``
(runs of 16 or more of 0-9a-f).

Added spans, kind ``entropy``: candidate strings are runs of 20 or more characters of [A-Za-z0-9+/_=-].
A window of WIDTH characters slides over each; the counts of its characters and the sum of c*log2(c) are
updated by the character that enters and the one that leaves, overall and per character class, so each
step costs the same.  A window is a hit when its entropy exceeds the threshold of its character set (hex
digits, or mixed) and at least two classes (digits, lower, upper) carry entropy of their own.  Hits that
touch form one span.  Allow-listed strings are suppressed: UUIDs, counting sequences, strings with placeholder
words in them, paths, and strings of letters only or of digits only.  Of a span, what overlaps a base span is
left out and the rest of it stays, if it is WIDTH characters or longer.

A block of documents is first looked through with array expressions; only documents in which a pattern
can occur at all are decoded and searched, each whole.  Null counts as empty; empty texts have no spans
and the hash of the empty string.  Repeated rows are scanned each by itself, whatever their ids; extra columns,
also ones named like a result, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

KINDS = ("assign", "access", "hex", "entropy")
WIDTH, CANDIDATE = 20, 20
HEX_BITS, MIXED_BITS, CLASS_BITS = 2.9, 3.5, 1.0


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

_ALLOWED = [
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i).*(example|placeholder|changeme|xxxxx|your[_-]).*"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Za-z+/_=-]+"),
    re.compile(r"/?[A-Za-z][a-z0-9_-]{0,14}(/[A-Za-z][a-z0-9_-]{0,14})+/?"),
]
_SEQUENCES = ("0123456789abcdef0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "01234567890123456789")


def allowed(text: str, extra: tuple = ()) -> bool:
    """Whether a candidate is known not to be a secret."""
    low = text.lower()
    if any(low[i : i + 10] in s for s in _SEQUENCES for i in range(0, max(1, len(low) - 9), 5)):
        return True
    return any(p.fullmatch(text) for p in (*_ALLOWED, *extra))


_LOG = [0.0] + [c * math.log2(c) for c in range(1, WIDTH + 1)]


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Joined windows of a candidate that look random."""
    n = len(text)
    if n < WIDTH:
        return []
    counts: dict[str, int] = {}
    total, size, part = 0.0, [0] * 4, [0.0] * 4
    not_hex, spans = 0, []
    for i, c in enumerate(text):
        k, old = _class(c), counts.get(c, 0)
        counts[c] = old + 1
        step = _LOG[old + 1] - _LOG[old]
        total += step
        part[k] += step
        size[k] += 1
        not_hex += c not in "0123456789abcdefABCDEF"
        if i >= WIDTH:
            gone = text[i - WIDTH]
            k, old = _class(gone), counts[gone]
            counts[gone] = old - 1
            step = _LOG[old] - _LOG[old - 1]
            total -= step
            part[k] -= step
            size[k] -= 1
            not_hex -= gone not in "0123456789abcdefABCDEF"
        if i >= WIDTH - 1:
            bits = _LOG[WIDTH] / WIDTH - total / WIDTH
            own = sum(size[j] >= 2 and math.log2(size[j]) - part[j] / size[j] >= CLASS_BITS for j in range(3))
            if own >= 2 and size[0] >= 2 and bits >= (MIXED_BITS if not_hex else HEX_BITS):
                lo, hi = i - WIDTH + 1, i + 1
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], extra: tuple = ()) -> list[tuple[int, int, int]]:
    taken: list[list[int]] = []
    for lo, _, hi in base:
        if taken and lo <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], hi)
        else:
            taken.append([lo, hi])
    starts, out = [x[0] for x in taken], []
    for m in _CANDIDATE.finditer(text):
        if allowed(m[0], extra):
            continue
        for lo, hi in entropy_spans(m[0]):
            lo, hi = lo + m.start(), hi + m.start()
            # What base spans leave of it.
            for k in range(max(0, bisect.bisect_right(starts, lo) - 1), bisect.bisect_left(starts, hi)):
                if taken[k][1] > lo:
                    if taken[k][0] - lo >= WIDTH:
                        out.append((lo, 3, taken[k][0]))
                    lo = taken[k][1]
            if hi - lo >= WIDTH:
                out.append((lo, 3, hi))
    return out


def _run(mask: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of at least n begins or goes on for n more."""
    have = 1
    while have < n and len(mask):
        step = min(have, n - have)
        mask = mask[:-step] & mask[step:] if len(mask) > step else mask[:0]
        have += step
    return np.flatnonzero(mask)


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_CANDIDATE = np.zeros(256, bool)
_IS_CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents of a block that may hold a span (never misses one)."""
    at = [_run(_IS_HEX[buf], 16), _run(_IS_CANDIDATE[buf], 18)]
    low = buf.tobytes().lower()
    for word in _WORDS:
        k = low.find(word)
        while k >= 0:
            at.append(np.array([k]))
            # on with the next document
            row = int(np.searchsorted(offs, k, side="right"))
            k = low.find(word, int(offs[row])) if row < len(offs) else -1
    rows = np.searchsorted(offs, np.concatenate(at), side="right") - 1
    return np.unique(rows[rows < len(offs) - 1])


def render(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, keep: list[str], allow: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, n_entropy, base, spans of every document.

    ``allow``: further regular expressions of candidate strings to suppress.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        extra = tuple(re.compile(p) for p in allow)
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("__text"))
            n = len(offs) - 1
            count, base, full = np.zeros((n, 4), np.int64), [""] * n, [""] * n
            for lo, _, b, o in textkit.blocks(buf, offs):
                for i in suspects(b, o).tolist():
                    text = b[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace")
                    found = base_spans(text)
                    every = sorted(found + added_spans(text, found, extra))
                    for _, k, _ in every:
                        count[lo + i, k] += 1
                    base[lo + i], full[lo + i] = render(found, KINDS), render(every, KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(count[:, k].copy()) for k in range(4)] + [pa.array(base, pa.string()), pa.array(full, pa.string())],
                [*keep, *[f"n_{k}" for k in KINDS], "base", "spans"],
            )

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"n_{k} long" for k in KINDS] + ["base string", "spans string"])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")
