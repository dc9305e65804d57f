"""Ranked retrieval: postings, BM25 with coverage, field and substring boosts, file roll-up, line ranking.

Texts become terms in Arrow batches: identifiers are counted per text and split once per distinct word, so a text's
postings leave the batch already summed, with its length, and need no shuffle.  ``terms`` may be any function of
a text; the default, ``code_terms``, gives the same terms as ``functions.text.terms``.
"""

from __future__ import annotations

import ctypes
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators.graph import stored

K1, B = 1.4, 0.72
FIELD_WEIGHTS = {"file": 1.25, "qualname": 1.75, "signature": 1.35, "docstring": 1.0, "source": 0.3}
DOCUMENT_WEIGHTS = {"file": 2, "qualname": 3, "name": 2, "signature": 2, "docstring": 2, "source": 1}


_WORD, _PIECE, _STOP = re.compile(T.IDENTIFIER, re.ASCII), re.compile(T.PIECES), frozenset(T.STOP_WORDS)


def hand_back() -> None:
    """Gives the system what the allocators of this worker hold and do not use; it waits beside the heap for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)``; a task that ends hands back its memory."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return rows.mapInArrow(lean, schema)


#: Words whose terms a worker keeps; text brings new ones without end, and most occurrences are of few.
KNOWN = 50_000


class CodeTerms:
    """Terms of a text with their counts: pieces and the whole of every identifier, lower-case, without stop words."""

    def __init__(self):
        self.known: dict[str, tuple[tuple[str, int], ...]] = {}

    def learn(self, word: str) -> tuple[tuple[str, int], ...]:
        if len(self.known) >= KNOWN:
            self.known.clear()
        if word[1:].islower() and word.isalpha():  # a plain word is its only piece
            low = word.lower()
            own = () if low in _STOP else ((low, 2),)
        else:
            own = tuple(Counter(t for t in (p.lower() for p in (*_PIECE.findall(word), word)) if t not in _STOP).items())
        self.known[word] = own
        return own

    def __call__(self, text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        get, known = out.get, self.known.get
        for word, n in Counter(_WORD.findall(text)).items():
            own = known(word)
            for term, k in self.learn(word) if own is None else own:
                out[term] = get(term, 0) + n * k
        return out


#: Makes the function that gives the terms of a text with their counts; one is made per task.
code_terms: Callable[[], Callable[[str], dict[str, int]]] = CodeTerms
#: Texts whose postings make one Arrow batch, and their terms, about; lines that are scored at a time.
TEXTS, TERMS, LINES = 1000, 100_000, 1000
#: Asked terms that are sent to the tasks that read texts.
ASKED = 200_000


def posted(docs: DataFrame, key: str, weights: dict[str, int], terms=code_terms, only: frozenset[str] | None = None) -> DataFrame:
    """(key, term, tf, dl, n_terms, head, fields) of every row: fields count as often as their weight says.

    dl: sum of tf of the row; n_terms: its terms; head: 1 at its first term, else 0; fields: a bit for each field that
    holds the term, the first field's is 1.  One row per key.  only: postings of other terms are left out; dl and n_terms
    are of the whole row all the same, and a row without any of these terms has one of no term, with tf 0, as its head.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields, plain = list(weights), list(weights.values()) == [1]

    def run(batches):
        of = terms()
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts = [batch.column(i + 1).slice(lo, TEXTS).to_pylist() for i in range(len(fields))]
                words, tf, bits, many, dl, n_terms, at = [], [], [], [], [], [], 0
                while at < len(texts[0]) and len(words) < TERMS:
                    counts: dict[str, int] = of(texts[0][at] or "") if plain else {}
                    held: dict[str, int] = {}
                    for bit, (column, weight) in enumerate(zip(texts, () if plain else weights.values())):
                        for term, n in of(column[at] or "").items():
                            counts[term] = counts.get(term, 0) + n * weight
                            held[term] = held.get(term, 0) | 1 << bit
                    dl.append(sum(counts.values()))
                    n_terms.append(len(counts))
                    if only is not None and counts:
                        counts = {t: counts[t] for t in counts if t in only} or {None: 0}
                        held = {t: held.get(t, 0) for t in counts}
                    words += counts
                    bits += [1] * len(counts) if plain else held.values()
                    tf += counts.values()
                    many.append(len(counts))
                    at += 1
                many = np.array(many, np.int64)
                head = np.zeros(len(tf), np.int64)
                head[np.concatenate(([0], np.cumsum(many)))[:-1][many > 0]] = 1
                numbers = [pa.array(x, pa.int64()) for x in (tf, np.repeat(np.array(dl, np.int64), many), np.repeat(np.array(n_terms, np.int64), many), head, bits)]
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(lo, lo + at), many)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(words, pa.string()), *numbers], [key, "term", "tf", "dl", "n_terms", "head", "fields"])
                lo += at

    rows = docs.select(key, *[F.col(c).cast("string").alias(f"__f{i}") for i, c in enumerate(fields)])
    return in_arrow(rows, run, f"`{key}` {kind}, term string, tf long, dl long, n_terms long, head long, fields long")


def postings(docs: DataFrame, key: str, text: str, terms=code_terms) -> DataFrame:
    """(key, term, tf) of every row; one row per key."""
    return posted(docs, key, {text: 1}, terms).select(key, "term", "tf")


def weighted_postings(docs: DataFrame, key: str, weights: dict[str, int], terms=code_terms) -> DataFrame:
    """Postings of several fields, each counted as often as its weight says."""
    return posted(docs, key, weights, terms).select(key, "term", "tf")


def idf(df, n):
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def corpus_numbers(post: DataFrame, docs: DataFrame) -> DataFrame:
    """One row (n, avg_dl); documents without terms count as length 1.  post: as posted."""
    total = post.agg(F.coalesce(F.sum(F.when(F.col("head") == 1, F.col("dl"))), F.lit(0)).alias("s"), F.coalesce(F.sum("head"), F.lit(0)).alias("have"))
    one = total.withColumn("n", F.greatest(F.lit(1).cast("long"), docs.agg(F.count(F.lit(1))).scalar()))
    return one.select("n", F.greatest(F.lit(1.0), (F.col("s") + F.col("n") - F.col("have")) / F.col("n")).alias("avg_dl"))


def bm25(post: DataFrame, queries: DataFrame, docs: DataFrame, key: str, query_key: str, only: list[str] | None = None, fields: dict[str, int] | None = None) -> DataFrame:
    """(query, key, bm25, matched, q_terms) of every query that shares a term with a document.

    only: the terms that are asked for, where they are few and known: postings of others are then passed over before
    they are moved.  fields: names for how many of the query's terms stand in a field, and that field's place.

    post: as posted, stored or cut; queries: (query_key, term, qc, q_terms).  Only postings of terms that some query
    asks for are counted and joined; a posting's and a query term's own factors are computed before the join.
    """
    one = corpus_numbers(post, docs).first()  # two numbers
    post = post if only is None else post.where(F.col("term").isin(only))
    df = post.join(queries.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.join(df, "term").select(query_key, "term", "q_terms", (F.col("qc") * idf(F.col("df"), F.lit(one.n))).alias("__qw"))
    bits = ["fields"] if fields else []
    rows = post.select(key, "term", *bits, ((F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.lit(one.avg_dl)))).alias("__dw"))
    hits = rows.join(asked, "term")
    counts = [F.sum(F.shiftright("fields", bit).bitwiseAND(1)).alias(name) for name, bit in (fields or {}).items()]
    return hits.groupBy(query_key, key, "q_terms").agg(F.sum(F.col("__qw") * F.col("__dw")).alias("bm25"), F.count(F.lit(1)).alias("matched"), *counts)


def query_terms(queries: DataFrame, query_key: str, text: str, terms=code_terms) -> DataFrame:
    """(query_key, term, qc, q_terms)."""
    return posted(queries, query_key, {text: 1}, terms).select(query_key, "term", F.col("tf").alias("qc"), F.col("n_terms").alias("q_terms"))


def ranked(scored: DataFrame, by: str | None, score: str, tie: str, top: int, decimals: int = 6) -> DataFrame:
    """The best ``top`` per group on the rounded score, ties by key; rank from 1."""
    rows = scored.withColumn(score, F.round(score, decimals))
    order = [F.desc(score), F.asc(tie)]
    if by is None:
        return rows.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def chunk_document():
    """The text that a chunk is searched by: file and symbol names count twice."""
    join = lambda c: F.array_join(c, " ")
    return F.concat_ws(" ", "file", "file", join("symbols"), join("symbols"), join("quality_summary"), "text")


def chunk_search(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, top: int = 12, post: DataFrame | None = None, terms=code_terms, only: list[str] | None = None) -> DataFrame:
    """(query, key, score, rank): BM25 times one plus the share of query terms found.

    ``post``: stored postings of docs, as posted; without them the texts are read once, for the terms that are asked for (all of
    them, if the queries have more than ASKED).  ``only``: as in bm25.
    """
    asked = query_terms(queries, query_key, query_text, terms)
    if post is None:
        words = [r.term for r in asked.select("term").distinct().limit(ASKED + 1).collect()]
        post = stored(posted(docs, key, {text: 1}, terms, frozenset(words) if len(words) <= ASKED else None))
    hits = bm25(post, asked, docs, key, query_key, only)
    scored = hits.select(query_key, key, (F.col("bm25") * (1.0 + F.col("matched") / F.col("q_terms"))).alias("score"))
    return ranked(scored, query_key, "score", key, top)


def field_boost(q_terms, fields: dict[str, float]):
    """Sum over fields of weight times the share of the query's distinct terms found there."""
    n = F.greatest(F.lit(1), F.size(q_terms))
    out = F.lit(0.0)
    for name, weight in fields.items():
        out = out + F.lit(float(weight)) * F.size(F.array_intersect(q_terms, T.terms(F.col(name)))) / n
    return out


def plain_substring_boost(raw: str, haystacks: list):
    """As substring_boost, of a query that is known: its pieces are written out."""
    pieces = [p for p in re.split(r"[ \t\n\x0b\f\r]+", raw.lower().strip(" \t\n\x0b\f\r")) if len(p) >= 4]
    found = []
    for p in pieces:
        anywhere = F.lit(False)
        for h in haystacks:
            anywhere = anywhere | F.coalesce(F.lower(h).contains(p), F.lit(False))
        found.append(F.when(anywhere, 1).otherwise(0))
    total = F.lit(0)
    for f in found:
        total = total + f
    return F.lit(0.2) * total


def substring_boost(raw, haystacks: list):
    """0.2 for every white-space piece (4 characters or more) of the raw query found in any haystack."""
    pieces = F.filter(F.split(T.stripped(F.lower(raw)), r"\s+"), lambda p: F.length(p) >= 4)
    return F.lit(0.2) * F.size(F.filter(pieces, lambda p: F.coalesce(F.exists(F.array(*[F.lower(h) for h in haystacks]), lambda h: h.contains(p)), F.lit(False))))


def symbol_search(symbols: DataFrame, query: str, top: int = 12, fields: dict[str, float] = FIELD_WEIGHTS, weights: dict[str, int] = DOCUMENT_WEIGHTS, key: str = "id", post: DataFrame | None = None, code=code_terms) -> DataFrame:
    """symbols with score and rank for one query: (BM25 + field boosts + substring boosts) * (1 + coverage).

    ``post``: stored postings of the symbols with these weights, as posted.
    """
    spark = symbols.sparkSession
    words = sorted(code()(query))
    if not words:
        return symbols.limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0).cast("long"))
    q = query_terms(spark.createDataFrame([(0, query)], "__q int, __text string"), "__q", "__text", code)
    post = stored(posted(symbols, key, weights, code)) if post is None else post
    # Postings of the default terms know which fields hold them; else the fields are read again.
    place = list(weights).index
    known = code is code_terms and "fields" in post.columns and set(fields) <= set(weights) and len(weights) > 1
    hits = bm25(post, q, symbols, key, "__q", words, {f"__in_{f}": place(f) for f in fields} if known else None).drop("__q")
    rows = symbols.withColumn("__sub", plain_substring_boost(query, [F.col("file"), F.col("qualname"), F.col("signature")]))
    if known:
        rows, own = rows.join(hits, key, "left"), F.lit(0.0)
        for name, weight in fields.items():
            own = own + F.lit(float(weight)) * F.coalesce(F.col(f"__in_{name}"), F.lit(0)) / F.lit(len(words))
    else:
        rows = rows.withColumn("__own", field_boost(F.array(*[F.lit(w) for w in words]), fields)).join(hits, key, "left")
        own = F.col("__own")
    joined = rows.withColumn("score", (F.coalesce("bm25", F.lit(0.0)) + (own + F.col("__sub"))) * (1.0 + F.coalesce("matched", F.lit(0)) / len(words)))
    best = joined.where("score > 0").drop("__sub", "__own", "bm25", "matched", "q_terms", *[f"__in_{f}" for f in fields])
    return ranked(best, None, "score", key, top)


def file_rollup(symbol_hits: DataFrame, chunk_hits: DataFrame, file: str, by: str | None = None, top: int = 8) -> DataFrame:
    """Score per file: symbol scores and 0.65 of chunk scores, each over rank^0.35."""
    keys = [file] if by is None else [by, file]
    share = lambda w: (F.col("score") * w / F.pow(F.col("rank").cast("double"), F.lit(0.35))).alias("part")
    parts = symbol_hits.select(*keys, share(1.0)).unionByName(chunk_hits.select(*keys, share(0.65)))
    return ranked(parts.groupBy(*keys).agg(F.sum("part").alias("score")), by, "score", file, top)


def matched_terms(q_terms, texts, limit: int = 12):
    """Query terms present in a text, sorted, the first ``limit``."""
    return F.slice(F.array_sort(F.array_intersect(q_terms, T.terms(texts))), 1, limit)


def line_scores(lines: DataFrame, query: str) -> DataFrame:
    """lines with score: shared distinct terms over 1 + 0.05 * the line's distinct terms; only lines that share any."""
    spark = lines.sparkSession
    words = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(T.terms(F.lit(query))))).collect()]
    if not words:
        return lines.limit(0).withColumn("score", F.lit(0.0))
    asked, names = frozenset(words), lines.columns

    def run(batches):
        of = CodeTerms()
        for batch in (b.slice(lo, LINES) for b in batches for lo in range(0, b.num_rows, LINES)):
            shared, every = [], []
            for x in batch.column("text").to_pylist():
                own = of(x or "").keys()
                shared.append(len(own & asked))
                every.append(len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int32()), pa.array(every, pa.int32())], [*names, "__s", "__n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", __s int, __n int"
    return in_arrow(lines, run, schema).where("__s > 0").withColumn("score", F.col("__s") / (1.0 + F.col("__n") * 0.05)).drop("__s", "__n")


def rank_lines(lines: DataFrame, query: str, top: int = 5, window: int = 3) -> list[dict]:
    """Best lines of one file with their surroundings; a line inside a picked window is passed over.

    A picked window hides at most 2*window other lines, so the top*(2*window+1) best lines decide the result.
    """
    need = top * (2 * window + 1)
    best = line_scores(lines, query).orderBy(F.desc("score"), "line_no").select("line_no", "score").limit(need).collect()
    used: set[int] = set()
    picked = []
    for row in best:
        if row.line_no in used or len(picked) >= top:
            continue
        lo, hi = max(1, row.line_no - window), row.line_no + window
        used |= set(range(lo, hi + 1))
        picked.append((row.line_no, lo, hi, row.score))
    out = []
    for focus, lo, hi, score in picked:
        around = lines.where(F.col("line_no").between(lo, hi)).orderBy("line_no").select("text").collect()
        out.append({"focus_line": focus, "start_line": lo, "end_line": hi, "score": round(score, 3), "text": "\n".join(r.text for r in around)})
    return out
