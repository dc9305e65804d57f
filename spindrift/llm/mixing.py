"""Mixing to target weights with soft domain membership.

A multinomial naive-Bayes classifier, fitted on a bounded sample of the labelled rows, gives each
document a posterior p over the domains.  Nonnegative rates r (expected copies per document) are fitted
so that the expected domain tokens meet the targets T_d:

    minimise  sum_i t_i (r_i - 1)^2 + sum_d (sum_i r_i t_i p_id - T_d)^2 / w_d,   r_i >= least

with weights w_d = ridge * (tokens of the domain, at least SCARCE of all), so that small domains meet their
targets as closely as large ones.  The solution is r_i = max(least, 1 + p_i . m) with one multiplier per
domain; they are found by Newton's method on the dual, a convex piecewise quadratic function.  A round is
a map over narrow rows (posterior, tokens) and sums of one number per domain and pair of domains; only
those reach the driver.  Rounds go on until the dual's gradient is SLOPE of all tokens; a target missed by
more than RESIDUAL of itself is logged.

Rates become whole copies by systematic rounding: the rows of a task that share their likeliest domain and
their length class (powers of two) are run through in order, a row gets the whole numbers that the running
sum of rates passes, and the sum starts at a hash of the task's first id.  So every group of a task is off by
less than one copy, where rounding row by row is off by the square root of the rows.  Copies are the rate
rounded up or down, and the same whenever the same stored table is read in the same splits.

Defined results: null and empty texts have no tokens, the classes' prior as posterior, and a rate like
any other; domains that no document resembles keep a residual; targets are normalised, a zero target is
allowed (with a least rate of 1 such a domain keeps its documents, and the others are mixed as if it were
not there); without labelled rows the posterior is even.  Repeated rows are mixed each by itself, ties and
null ids like other rows.  Extra columns are ignored (kept by the pipeline stage, whatever their names).  An
empty table gives an empty table.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

BITS = 18
SAMPLE = 4000
#: Target shares of tokens by domain (the language column names the domain of a labelled row).
TARGETS = {"en": 0.50, "fr": 0.18, "de": 0.18, "es": 0.14}
#: Where Newton's method ends, the residual that counts as met, and a bound on rounds that is not reached in practice.
SLOPE, RESIDUAL, ROUNDS = 1e-7, 0.01, 200
RIDGE, SCARCE = 1e-4, 0.01


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of a block: (document, bucket, words per document)."""
    words = textkit.Words(buf, offs)
    bucket = (words.hashes() & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return words.docs(), bucket, words.counts


def fit_domains(docs: DataFrame, labelled_ids: DataFrame, domains: list[str], domain_column: str, sample: int = SAMPLE):
    """Broadcast (log weights [domain, bucket] as float32, log prior): a fit on at most ``sample`` labelled rows.

    Counts leave the executors as (domain, bucket, n): at most domains * 2**BITS rows.
    """
    spark = docs.sparkSession
    chosen = labelled_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col(domain_column)).cast("int") - 1
    rows = docs.select("doc_id", "text", place.alias("d")).where("d >= 0").join(F.broadcast(chosen), "doc_id").select("d", "text")

    def count(batches):
        seen = np.zeros((len(domains), 1 << BITS), np.int64)
        n = np.zeros(len(domains), np.int64)
        for batch in batches:
            d = batch.column("d").to_numpy(zero_copy_only=False)
            n += np.bincount(d, minlength=len(domains))
            buf, offs = textkit.text_buffers(batch.column("text"))
            for lo, hi, b, o in textkit.blocks(buf, offs):
                doc, bucket, _ = features(b, o)
                np.add.at(seen, (d[lo:hi][doc], bucket), 1)
        at, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[at, bucket])], ["d", "bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(domains)), pa.int32()), pa.array(np.full(len(domains), -1), pa.int32()), pa.array(n)], ["d", "bucket", "n"])

    table = shared.in_arrow(rows, count, "d int, bucket int, n long").groupBy("d", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen, prior = np.full((len(domains), 1 << BITS), 0.5), np.ones(len(domains))
    d, bucket, n = (table.column(c).to_numpy() for c in ("d", "bucket", "n"))
    words = bucket >= 0
    seen[d[words], bucket[words]] += n[words]
    prior[d[~words]] += n[~words]
    weights = np.log(seen / seen.sum(1, keepdims=True))
    return spark.sparkContext.broadcast(((weights - weights.mean(0)).astype(np.float32), np.log(prior / prior.sum())))


class Copies:
    """Systematic rounding of a task's rates, apart for every domain and length class."""

    def __init__(self, seed: int):
        self.seed, self.sums = np.uint64(seed & (2**64 - 1)), {}

    def __call__(self, domain: np.ndarray, tokens: np.ndarray, rate: np.ndarray) -> np.ndarray:
        group = domain * 64 + np.log2(tokens + 1).astype(np.int64)
        out = np.zeros(len(rate), np.int32)
        for g in np.unique(group).tolist():
            if g not in self.sums:
                self.sums[g] = float(textkit.mix64(np.array([self.seed]) + np.uint64(g))[0] >> np.uint64(11)) / float(1 << 53)
            mine = np.flatnonzero(group == g)
            passed = np.floor(np.cumsum(np.concatenate(([self.sums[g]], rate[mine]))))
            out[mine] = np.diff(passed)
            self.sums[g] += float(rate[mine].sum()) - passed[-1]
        return out


def posteriors(docs: DataFrame, model, domains: int, keep: list[str], rate=None) -> DataFrame:
    """``keep`` columns, tokens (words), p array<double>; with a function ``rate`` of p also its value and the copies."""
    text = "text" if "text" in keep else "__text"
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        weights, prior = model.value
        whole = None
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column(text))
            all_p, all_n = [np.zeros((0, domains))], [np.zeros(0, np.int64)]
            for _, _, b, o in textkit.blocks(buf, offs):
                doc, bucket, n = features(b, o)
                logit = np.stack([np.bincount(doc, weights=w[bucket], minlength=len(n)) for w in weights], 1)
                # Words of one text are not independent: their mean counts as ten of them.
                logit = logit * np.minimum(1.0, 10.0 / np.maximum(n, 1))[:, None] + prior
                p = np.exp(logit - logit.max(1, keepdims=True))
                all_p.append(p / p.sum(1, keepdims=True))
                all_n.append(n)
            p, n = np.concatenate(all_p), np.concatenate(all_n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * domains, pa.int32()), pa.array(p.reshape(-1)))
            columns = [batch.column(c) for c in keep] + [pa.array(n.astype(np.int64)), lists]
            if rate is not None:
                whole = whole or Copies(int(batch.column("doc_id")[0].as_py() or 0) if batch.num_rows else 0)
                columns += [pa.array(r := rate(p)), pa.array(whole(p.argmax(1), n, r))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "tokens", "p", *["rate", "copies"] * (rate is not None)])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["tokens long", "p array<double>"] + ["rate double", "copies int"] * (rate is not None))
    source = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return shared.in_arrow(source, run, schema)


def replay(p: np.ndarray, multipliers: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(1.0 + p @ multipliers, least)


def fit_rates(rows: DataFrame, targets: np.ndarray, total: float | None = None, least: float = 0.0, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Multipliers of the domains for rows (tokens, p); ``total``: tokens wanted (default: as many as there are).

    Sums are taken in fixed point per row, so they do not depend on the order of addition.
    """
    domains = len(targets)
    targets = np.asarray(targets, float) / max(1e-12, float(np.sum(targets)))

    def sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and their derivative by the multipliers."""
        def run(batches):
            out = np.zeros((domains + 1, domains), np.int64)
            for batch in batches:
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
                n = batch.column("tokens").to_numpy(zero_copy_only=False)
                fixed = lambda x: np.round(x * 65536).astype(np.int64).sum(0)
                out[0] += fixed(p * (replay(p, m, least) * n)[:, None])
                moving = p * (n * (1.0 + p @ m >= least))[:, None]
                for d in range(domains):
                    out[d + 1] += fixed(moving * p[:, d : d + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.reshape(-1))], ["d", "s"])

        got = rows.select("tokens", "p").mapInArrow(run, "d int, s long").groupBy("d").agg(F.sum("s").alias("s")).collect()
        out = np.zeros((domains + 1) * domains)
        for r in got:
            out[r.d] = r.s / 65536
        out = out.reshape(domains + 1, domains)
        return out[0], out[1:]

    m = np.zeros(domains)
    have, slopes = sums(m)
    size = max(1.0, have.sum())
    wanted = float(size if total is None else total) * targets
    weight = ridge * np.maximum(have, SCARCE * size)
    now = have
    left = rounds if have.sum() > 0 else 0
    while left > 0:
        gradient = now - wanted + weight * m
        if np.abs(gradient).max() <= SLOPE * size:
            break
        step = -np.linalg.solve(slopes + np.diag(weight), gradient)
        share, before = 1.0, float(step @ gradient)
        while left > 0:
            now, slopes = sums(m + share * step)
            left -= 1
            after = float(step @ (now - wanted + weight * (m + share * step)))
            # Beyond the lowest point of the line: back to where the secant has its zero.
            if after <= -0.5 * before:
                break
            share *= before / (before - after)
        m = m + share * step
    return m, {"have": have, "wanted": wanted, "reached": now}


def rated(docs: DataFrame, model, domains: int, multipliers: np.ndarray, least: float, keep: list[str]) -> DataFrame:
    """posteriors() and each document's rate and copies, in one pass over the texts; ``keep`` has doc_id."""
    return posteriors(docs, model, domains, keep, lambda p: replay(p, multipliers, least))


def mix(docs: DataFrame, labelled_ids: DataFrame, targets: dict[str, float] = TARGETS, domain_column: str = "lang", least: float = 0.0, total_of=None, ridge: float = RIDGE, keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """(keep columns, tokens, p, rate, copies) of every document, and the fit's sums.

    ``total_of(domain tokens, target shares)`` gives the total wanted; the default keeps the present one.
    """
    domains = list(targets)
    model = fit_domains(docs, labelled_ids, domains, domain_column)
    want = np.array(list(targets.values()), float)
    want = want / want.sum()
    rows = shared.materialize(posteriors(docs, model, len(domains), []))
    total = None
    if total_of is not None:
        sums = rows.select([F.sum(F.col("p")[i] * F.col("tokens")).alias(f"d{i}") for i in range(len(domains))]).first()
        total = total_of(np.array([x or 0.0 for x in sums]), want)
    multipliers, report = fit_rates(rows, want, total, least, ridge)
    missed = np.abs(report["reached"] - report["wanted"]) > RESIDUAL * report["wanted"] + 1
    if missed.any():
        logging.getLogger(__name__).warning("mixing: targets missed, tokens %s", {d: (round(report["reached"][i]), round(report["wanted"][i])) for i, d in enumerate(domains) if missed[i]})
    return rated(docs, model, len(domains), multipliers, least, keep or ["doc_id"]), report


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies per document: doc_id, tokens, domain (most likely), p_<domain>, rate, copies, and the
    fit's report: wanted_tokens and reached_tokens of that domain."""
    docs, labels = shared.documents(spark, sf_dir), shared.labels(spark, sf_dir)
    mixed, report = mix(docs, labels)
    names = list(TARGETS)
    at = F.array_position("p", F.array_max("p")).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    told = [of([float(x) for x in report[k]]).alias(f"{k}_tokens") for k in ("wanted", "reached")]
    return mixed.select("doc_id", "tokens", of(names).alias("domain"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)], "rate", "copies", *told)


def least_total(have: np.ndarray, want: np.ndarray) -> float:
    """The smallest total at which no domain has more tokens than its target; domains without a target do not count."""
    some = want > 0
    return float((have[some] / want[some]).max()) if some.any() else 0.0


def resample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays (least rate 1); those of short domains are repeated.

    The total is the smallest at which the domain with most tokens for its target keeps rate 1.  Null and empty
    texts stay once or more like others, repeated rows are repeated each by itself; an empty table stays empty.
    """
    docs, restore = shared.shield(docs, ("doc_id", "text", "lang"))
    mixed, _ = mix(docs, shared.labels(spark, sf_dir), least=1.0, total_of=least_total, keep=docs.columns)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*restore)
