"""Personal data: checked patterns, and identifiers found by the contexts those occur in.

Base spans (code points, end exclusive), leftmost and non-overlapping per kind, failing matches dropped
without a retry: ``email``, ``ip`` (four parts of at most 255), ``card`` (12 to 19 digits that pass the
Luhn check) and ``phone`` (9 to 15 digits after a plus).

Bootstrapping: base spans are the seed entities.  Tokens of MIN_DIGITS or more digits outside base spans,
and runs of number groups with single spaces between that hold as many, are candidates.  Every occurrence
of either gives lexical patterns: its neighbours' words (left word, two left words, left and right word),
once together with the token's shape, once alone, whatever the shape.  A context alone says something only
where identifiers are what it introduces, so every place in the corpus that it precedes is counted in a
second pass over the texts, and it takes part if at least MIN_SHARE of these hold a seed or a candidate.
The pattern-instance graph, one edge
per distinct pair, is scored in Spark for ROUNDS rounds: a pattern's confidence is the mean confidence of
its instances (seeds 1), an unknown instance's confidence towards a pattern is one minus the product of the
doubts of its *other* patterns, so no pattern vouches for itself by way of an instance.  Patterns with
enough confidence and enough distinct seeds are accepted and mark the candidates they fit as further spans,
kind ``context``.  A candidate that as a whole has the form of a kind and fails that kind's check (12 to 19
digits with a wrong check digit, an address part over 255, a plus and too few or too many digits) is no
identifier: it is never marked, and counts against a pattern like any other unknown instance.

A context word is known by the 64 characters next to the span, which holds for any text; spans, candidates
and texts have no length limit.

The least number of seeds is the same at every size, so documents added elsewhere withdraw no pattern.
Accepted patterns may be any number: candidates are joined with their table, never with a list of them.

Spans and candidates with their contexts are written to the shared folder.  Of overlapping spans found by
context the longest stays.
Null counts as empty; empty texts have no spans and the hash of the empty string.  Repeated rows and null
ids are scanned each by itself; extra columns, also ones named like a result, are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

KINDS = ("email", "ip", "card", "phone", "context")
MIN_DIGITS = 5
ROUNDS = 3
MIN_SEEDS, MIN_CONFIDENCE = 3, 0.6
#: Of the places that a context precedes, those with a seed or a candidate, for a pattern without a shape.
MIN_SHARE = 0.5
#: Bits of the filter that is broadcast for the second pass; it prunes only, the join that follows is exact.
FILTER_BITS = 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_GROUPS = re.compile(r"[+(]*[0-9][0-9().+/-]*(?:\x20[+(]*[0-9][0-9().+/-]*)+")
_EDGE = "\"'()[]{}<>,;:.!?*%$#&"


def emails(text: str) -> list[tuple[int, int, int]]:
    """The pattern has one way to match at an @: all local characters before it, the longest domain after."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int, int]]:
    """Dotted chains of numbers, taken by four from the left."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    return out


def phones(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = emails(text) if "@" in text else []
    out += addresses(text) + cards(text)
    return sorted(out + phones(text)) if "+" in text else sorted(out)


def shape(token: str) -> str:
    """Letters and digits as classes, with the length of each run."""
    form = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", token)))
    return form if len(form) <= 40 else f"{form[:20]}#{_digest(form):016x}"


def _before(text: str, at: int) -> list[str]:
    """The two words before a position, nearest first."""
    out, end = [], at
    for _ in range(2):
        while end > 0 and text[end - 1] in " \t\n\r\x0b\x0c":
            end -= 1
        begin = end
        while begin > 0 and text[begin - 1] not in " \t\n\r\x0b\x0c" and end - begin < 64:
            begin -= 1
        out.append(text[begin:end].strip(_EDGE).lower())
        end = begin
    return out


def _after(text: str, at: int) -> str:
    end = at
    n = len(text)
    while end < n and text[end] not in " \t\n\r\x0b\x0c" and end - at < 64:
        end += 1
    while end < n and text[end] in " \t\n\r\x0b\x0c":
        end += 1
    begin = end
    while end < n and text[end] not in " \t\n\r\x0b\x0c" and end - begin < 64:
        end += 1
    return text[begin:end].strip(_EDGE).lower()


def patterns(text: str, lo: int, hi: int) -> list[str]:
    """Lexical patterns of an occurrence; those without a shape begin with ~ and hold the context's key."""
    one, two = _before(text, lo)
    kind, right = shape(text[lo:hi]), _after(text, hi)
    out = [f"L|{one}|{kind}", f"LL|{two} {one}|{kind}", f"LR|{one}|{right}|{kind}"]
    # An opening bracket or quote before the token is no word.
    while lo > 0 and text[lo - 1] in _EDGE:
        lo -= 1
    one, two = _before(text, lo)
    if one:
        own, other, after = np.array([[_digest(w)] for w in (one, two, right)], np.uint64)
        keys = context_keys(own, other, after)
        out += [f"~{int(key[0])}" for key, there in zip(keys, (True, two, right)) if there]
    return out


def _digest(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def context_keys(one: np.ndarray, two: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the left word, the two left words, the left and the right word, from the words' digests."""
    ll = textkit.mix64(textkit.mix64(two + np.uint64(1)) + one)
    lr = textkit.mix64(textkit.mix64(right + np.uint64(2)) + one)
    return one.view(np.int64), ll.view(np.int64), lr.view(np.int64)


_EMPTY = np.uint64(xxhash.xxh64_intdigest(b""))


def places(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(pattern, places): words in all texts that stand where an identifier would in the context.

    ``contexts``: pattern (without a shape).
    """
    keys = contexts.select(F.substring("pattern", 2, 20).cast("long").alias("key"))
    some = keys.select(F.col("key").bitwiseAND((1 << FILTER_BITS) - 1).alias("bit")).distinct().toArrow()
    wanted = np.zeros(1 << FILTER_BITS, bool)
    wanted[some.column("bit").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        want = sent.value
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("text"))
            for _, _, b, o in textkit.blocks(buf, offs):
                number: dict[bytes, int] = {}
                words = [b[x:y].tobytes().split() for x, y in zip(o[:-1], o[1:])]
                # Texts are set apart by two empty words on either side.
                gap, at = number.setdefault(b"", 0), []
                for text in words:
                    at += [gap, gap]
                    at += [number.setdefault(w, len(number)) for w in text]
                at += [gap, gap]
                ids = np.array(at, np.int64)
                read = [w.decode("utf-8", "replace") for w in number]
                left = np.array([_digest(w[-64:].strip(_EDGE).lower()) for w in read], np.uint64)[ids]
                right = np.array([_digest(w[:64].strip(_EDGE).lower()) for w in read], np.uint64)[ids]
                one, two, after = left[1:-2], left[:-3], right[3:]
                real = (ids[2:-1] != gap) & (one != _EMPTY)
                l, ll, lr = context_keys(one[real], two[real], after[real])
                found = np.concatenate([l, ll[two[real] != _EMPTY], lr[after[real] != _EMPTY]])
                key, n = np.unique(found[want[found & ((1 << FILTER_BITS) - 1)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("places"))
    return counted.select(F.concat(F.lit("~"), F.col("key").cast("string")).alias("pattern"), "places")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with many digits, without their outer punctuation, and runs of number groups, that touch no base span."""
    runs = [(m.start(), m.end()) for m in _GROUPS.finditer(text)]
    spans = set()
    for lo, hi in [m.span() for m in _TOKEN.finditer(text)] + runs:
        token = text[lo:hi]
        lo += len(token) - len(token.lstrip(_EDGE))
        token = token.strip(_EDGE)
        if sum("0" <= c <= "9" for c in token) >= MIN_DIGITS:
            spans.add((lo, lo + len(token)))
    out, k = [], 0
    taken = sorted((s, e) for s, _, e in base)
    for lo, hi in sorted(spans):
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        if k == len(taken) or taken[k][0] >= hi:
            out.append((lo, hi))
    return out


def refuted(token: str) -> bool:
    """Whether a token has the form of a base kind as a whole; being no base span, it fails the check of that kind."""
    digits = sum("0" <= c <= "9" for c in token)
    if _CARD.fullmatch(token) and 12 <= digits <= 19:
        return True
    return bool(_PHONE.fullmatch(token)) or (token.count(".") == 3 and bool(_CHAIN.fullmatch(token)))


_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1


def suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents of a block with an @, or with MIN_DIGITS digits or more in all (no span has neither)."""
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf], dtype=np.int64)))
    ats = np.concatenate(([0], np.cumsum(buf == 64, dtype=np.int64)))
    return np.flatnonzero((np.diff(digits[offs]) >= 4) | (np.diff(ats[offs]) > 0))


def extract(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, counts, base, and found: array of (lo, hi, kind, instance, patterns); kind 4 are candidates, kind 5 those that are refuted."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    item = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("__text"))
            n = len(offs) - 1
            count, found = np.zeros((n, 4), np.int64), [[] for _ in range(n)]
            for first, _, b, o in textkit.blocks(buf, offs):
                for i in suspects(b, o).tolist():
                    text = b[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    for _, k, _ in base:
                        count[first + i, k] += 1
                    every = base + [(lo, 4 + refuted(text[lo:hi]), hi) for lo, hi in candidates(text, base)]
                    found[first + i] = [{"lo": lo, "hi": hi, "kind": k, "instance": text[lo:hi], "patterns": patterns(text, lo, hi)} for lo, k, hi in sorted(every)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(count[:, k].copy()) for k in range(4)] + [pa.array(found, pa.list_(item))],
                [*keep, "n_email", "n_ip", "n_card", "n_phone", "found"],
            )

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"n_{k} long" for k in KINDS[:4]])
    schema += ", found array<struct<lo: int, hi: int, kind: int, instance: string, patterns: array<string>>>"
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def bootstrap(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, confidence, seeds) of the accepted patterns, from rows with ``found`` and their texts."""
    seen = found.select(F.explode("found").alias("f")).select(F.xxhash64("f.instance").alias("instance"), (F.col("f.kind") < 4).alias("seed"), F.explode("f.patterns").alias("pattern"))
    edges = shared.materialize(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")))
    # Patterns of too few seeds are never accepted, so they take no part in the rounds.
    strong = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum("n").alias("filled")).where(F.col("seeds") >= min_seeds)
    strong = shared.materialize(strong)
    contexts = strong.where("pattern LIKE '~%'")
    if not contexts.isEmpty():
        near = places(docs, contexts.select("pattern"))
        telling = contexts.join(near, "pattern", "left").where(F.col("filled") >= MIN_SHARE * F.coalesce("places", F.lit(0)))
        strong = strong.where("pattern NOT LIKE '~%'").unionByName(telling.select(strong.columns))
    graph = shared.materialize(edges.join(strong.select("pattern", "seeds"), "pattern"))
    # A pattern or an instance may hold a large part of the edges: those few are spread over several tasks.
    hot = {k: shared.hot_keys(graph.groupBy(k).agg(F.count(F.lit(1)).alias("n")), k, "n") for k in ("pattern", "instance")}
    belief = graph.select("pattern", "instance", "seeds", F.col("seed").cast("double").alias("conf"))
    for _ in range(rounds):
        # ln(1 - confidence) is summed, so an instance's doubt is a product over its patterns.
        scored = belief.groupBy("pattern").agg(F.avg("conf").alias("confidence"))
        own = shared.salted(graph, scored, "pattern", hot["pattern"])
        own = shared.materialize(own.select("pattern", "instance", "seeds", "seed", F.log(F.greatest(F.lit(1e-6), F.lit(1.0) - F.col("confidence") * 0.5)).alias("own")))
        doubt = own.groupBy("instance").agg(F.sum("own").alias("doubt"))
        both = shared.salted(own, doubt, "instance", hot["instance"])
        # Without what the pattern itself says; sums of doubles may differ in the last place, hence the bound.
        others = F.least(F.lit(0.0), F.col("doubt") - F.col("own"))
        belief = shared.materialize(both.select("pattern", "instance", "seeds", F.when(F.col("seed"), 1.0).otherwise(1.0 - F.exp(others)).alias("conf")))
    return belief.groupBy("pattern").agg(F.avg("conf").alias("confidence"), F.max("seeds").alias("seeds")).where(F.col("confidence") >= min_confidence)


def outermost(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The longest of overlapping spans."""
    out, end = [], -1
    for lo, hi in sorted(spans):
        if lo >= end:
            out.append((lo, hi))
        elif hi - lo > out[-1][1] - out[-1][0]:
            out[-1] = (lo, hi)
        end = out[-1][1]
    return set(out)


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, counts, base (rendered), spans (rendered, with those found by context), n_context."""
    found = shared.materialize(extract(docs, keep).withColumn("__row", F.monotonically_increasing_id()))
    accepted = bootstrap(found, docs).select("pattern")
    asked = found.select("__row", F.explode("found").alias("f")).where("f.kind = 4").select("__row", F.struct("f.lo", "f.hi").alias("span"), F.explode("f.patterns").alias("pattern"))
    hits = asked.join(accepted, "pattern", "left_semi").groupBy("__row").agg(F.collect_set("span").alias("__hits"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            base, full, more = [], [], []
            for row, hit in zip(batch.column("found").to_pylist(), batch.column("__hits").to_pylist()):
                good = outermost([(h["lo"], h["hi"]) for h in hit or ()])
                spans = [(f["lo"], f["kind"], f["hi"]) for f in row if f["kind"] < 4 or (f["lo"], f["hi"]) in good]
                base.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < 4))
                full.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
                more.append(sum(k == 4 for _, k, _ in spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*keep, "n_email", "n_ip", "n_card", "n_phone")] + [pa.array(base, pa.string()), pa.array(full, pa.string()), pa.array(more, pa.int64())],
                [*keep, "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_context"],
            )

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"n_{k} long" for k in KINDS[:4]] + ["base string", "spans string", "n_context long"])
    return found.join(hits, "__row", "left").mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(shared.documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_context")
