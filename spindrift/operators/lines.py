"""Files to lines, findings, chunks and owners."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T


def explode_lines(files: DataFrame, key: str = "file", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no from 1, text, role, quality_flags), and the columns to carry along."""
    rows = files.select(key, *carry, F.posexplode(T.split_lines(F.col(source))).alias("__n", "text"))
    rows = rows.select(key, *carry, (F.col("__n") + 1).cast("long").alias("line_no"), "text")
    # Columns of their own: every rule reads them, and each is computed once.
    rows = rows.withColumn("__s", T.stripped(F.col("text"))).withColumn("__code", T.masked(F.col("__s")))
    flags = T.finding_codes(F.col("text"), F.col("line_no"), F.col("__s"), F.col("__code"))
    return rows.select(key, *carry, "line_no", "text", T.line_role(F.col("text"), F.col("__s")).alias("role"), flags.alias("quality_flags"))


def findings(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, severity, code, message) of every rule broken."""
    # Of an outer explode no filter is inferred that would evaluate the rules once more.
    rows = lines.select(key, "line_no", F.explode_outer("quality_flags").alias("code")).where("code IS NOT NULL")
    return rows.select(key, "line_no", T.severity_of(F.col("code")).alias("severity"), "code", T.message_of(F.col("code")).alias("message"))


def hotspots(found: DataFrame, key: str = "file", top: int | None = 12) -> DataFrame:
    """Findings per file: high, medium, total; the worst first."""
    out = found.groupBy(key).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count(F.lit(1)).alias("total")
    )
    return out if top is None else out.orderBy(F.desc("high"), F.desc("medium"), F.desc("total"), key).limit(top)


def chunk_spans(n_lines, size: int = 80, overlap: int = 12):
    """array<struct<start, end>> of the windows over 1..n_lines; the last one ends at n_lines."""
    stride = max(1, size - overlap)
    more = F.ceil(F.greatest(F.lit(0), n_lines - size) / stride)
    starts = F.sequence(F.lit(0).cast("long"), more.cast("long"))
    spans = F.transform(starts, lambda k: F.struct((k * stride + 1).alias("start"), F.least(n_lines.cast("long"), k * stride + size).alias("end")))
    return F.when(n_lines > 0, spans).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))


def chunks(files: DataFrame, key: str = "file", source: str = "source", size: int = 80, overlap: int = 12) -> DataFrame:
    """(key, start_line, end_line, tokens, text, quality_summary): overlapping windows of lines."""
    split = files.select(key, T.split_lines(F.col(source)).alias("__lines"))
    spans = split.select(key, "__lines", F.explode(chunk_spans(F.size("__lines"), size, overlap)).alias("s"))
    text = F.array_join(F.slice("__lines", F.col("s.start").cast("int"), (F.col("s.end") - F.col("s.start") + 1).cast("int")), "\n")
    window = F.slice("__lines", F.col("s.start").cast("int"), (F.col("s.end") - F.col("s.start") + 1).cast("int"))
    codes = F.array_sort(F.array_distinct(F.flatten(F.transform(window, lambda x, i: T.finding_codes(x, i + F.col("s.start"))))))
    out = spans.select(key, F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), text.alias("text"), codes.alias("quality_summary"))
    return out.withColumn("tokens", T.token_estimate(F.col("text")))


CHUNK_SQL = "file string, start_line long, end_line long, text string, quality_summary array<string>, symbols array<string>"


def chunks_of(extracted: DataFrame, size: int = 80, overlap: int = 12) -> DataFrame:
    """As chunks, with the symbols that each chunk reaches, in the order of the files.

    extracted: (file, source, symbols).  Each file is read on its own, in time that grows with its lines and what its
    chunks hold; the codes of a line are found once, however many chunks hold it.
    """
    split = extracted.select("file", T.split_lines(F.col("source")).alias("l"), "symbols")
    codes = F.transform("l", lambda x, i: T.finding_codes(x, i + 1))
    rows = split.select("file", "l", codes.alias("c"), *[F.col(f"symbols.{x}").alias(x) for x in ("qualname", "start_line", "end_line")])
    stride = max(1, size - overlap)

    def one(file, l, c, names, starts, ends):  # noqa: E741
        n = len(l)
        count = 1 + -(-max(0, n - size) // stride) if n else 0
        held = [[] for _ in range(count)]
        for name, start, end in zip(names, starts, ends):
            if start > n:
                continue
            for k in range(max(0, -(-(start - size) // stride)), min(count - 1, (end - 1) // stride) + 1):
                held[k].append(name)
        for k in range(count):
            lo, hi = k * stride, min(n, k * stride + size)
            yield file, lo + 1, hi, "\n".join(l[lo:hi]), sorted({x for own in c[lo:hi] for x in own}), sorted(held[k])

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("text", pa.string()), ("quality_summary", pa.list_(pa.string())), ("symbols", pa.list_(pa.string()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [row for x in zip(*(v.to_pylist() for v in batch.slice(at, 500).columns)) for row in one(*x)]
                columns = list(zip(*out)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    out = rows.mapInArrow(run, CHUNK_SQL)
    return out.withColumn("tokens", T.token_estimate(F.col("text")))


#: Lines of one bucket of the containment join; a span meets the buckets it reaches over.
BUCKET = 64


def owners(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, owner: str, bucket: int = BUCKET) -> DataFrame:
    """points with ``owner`` of the smallest span that holds them, then of the smallest start; null if none does.

    The range join is an equi-join on (keys, bucket); spans reach over several buckets, so one long file is
    spread over many of them.
    """
    left = points.withColumn("__b", F.floor(F.col(at) / bucket))
    right = spans.select(*on, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(owner).alias("__o"))
    right = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    # The owner depends on the keys and the position only.
    places = left.select(*on, "__b", F.col(at).alias("__at")).distinct()
    hits = places.join(right, [*on, "__b"]).where("__at BETWEEN __s AND __e")
    best = hits.groupBy(*on, "__b", "__at").agg(F.min_by("__o", F.struct(F.col("__e") - F.col("__s"), F.col("__s"), F.col("__o"))).alias(owner))
    return left.withColumn("__at", F.col(at)).join(best, [*on, "__b", "__at"], "left").drop("__b", "__at").select(*points.columns, owner)


def overlapping(left: DataFrame, right: DataFrame, on: str, l_start: str, l_end: str, r_start: str, r_end: str, bucket: int = BUCKET) -> DataFrame:
    """Interval-overlap join within ``on``; ends are whole numbers.

    The axis is cut into buckets, so a key of very many rows is spread and only intervals that come near each other
    meet; a pair is reported in the bucket where the later one of the two starts.
    """
    filed = lambda df, start, end: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    both = filed(left.where(F.col(l_start) <= F.col(l_end)), l_start, l_end).join(filed(right.where(F.col(r_start) <= F.col(r_end)), r_start, r_end), [on, "__b"])
    meet = (F.col(l_end) >= F.col(r_start)) & (F.col(l_start) <= F.col(r_end))
    return both.where(meet & (F.col("__b") == F.floor(F.greatest(l_start, r_start) / bucket))).drop("__b")


def line_window(lines: DataFrame, start: int, end: int, radius: int = 0) -> DataFrame:
    return lines.where(F.col("line_no").between(max(1, start - radius), end + radius))
