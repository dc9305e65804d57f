"""URL filter: list rules first, mined association rules for what no list rule covers.

List rules are (host, path) prefixes: a rule fits its host and all subdomains when the url's path starts
with the rule's path; the longest fitting rule wins.  Host, path and list rules are built-in expressions.

For the rest, FP-growth mines combinations of URL tokens (host labels, top domain, path parts, query keys,
fragment; numbers are one token) together with the label of labelled urls.  Tokens that stand in exactly the
same labelled urls are one item, so a url repeated with many tokens does not multiply item sets; item sets
have no length bound.  Combinations on at least MIN_SUPPORT of the labelled urls and at least MIN_URLS of
them are rules if they imply a label with at least MIN_CONFIDENCE, and if the lower Wilson bound (Z deviations, as
thousands of combinations are tried) of that confidence is MIN_LIFT times the label's share of all labelled urls;
those that a part of themselves implies as well are dropped.  Rules are filed in an inverted index
under their rarest token, so a url looks only at rules one of whose tokens it has.  The best fitting rule
(confidence, then support, then tokens) decides; urls without one are allowed.

Labels come from documents: a page whose whole article text, white space aside, is that of a labelled
document has its label.  Mining uses at most SAMPLE labelled urls, those with the lowest hash, so what it
collects is bounded; every url is judged.

Defined results: null urls and urls without ``://`` have an empty host and path, no tokens and the
verdict allow; without labelled urls nothing is mined.  Repeated rows are judged each by itself, texts that
carry both labels count as blocked from one half on; extra columns, also ones named like a result, are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT, MIN_URLS, MIN_CONFIDENCE, MIN_LIFT, Z = 0.005, 5, 0.9, 1.1, 4.0
SAMPLE = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def pieces(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest) of a url."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    part = lambda k: F.coalesce(F.regexp_extract(after, "^([^/?#]*)([^?#]*)(?s)(.*)$", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2), part(3)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting list rule; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for said, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix) & (host != "")
        rule, verdict = F.when(fits, F.lit(own + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(host: str, path: str, rest: str) -> list[str]:
    """Distinct tokens of a url."""
    labels = [x for x in host.split(".") if x]
    out = [f"top:{labels[-1]}"] if labels else []
    out += [f"host:{x}" for label in labels[:-1] for x in {label, *label.split("-")}]
    parts = [re.sub(r"[0-9]+", "#", p.translate(_FOLD)) for p in path.split("/") if p]
    out += [f"path:{p}" for p in parts]
    query, _, fragment = rest.partition("#")
    out += [f"query:{pair.partition('=')[0]}" for pair in query.lstrip("?").split("&") if pair]
    if fragment:
        out.append(f"fragment:{fragment}")
    return sorted(set(out))


def parse(pages: DataFrame, keep: list[str], rules=RULES) -> DataFrame:
    """``keep`` columns, host, path, tokens, rule, listed (the verdict of the list; null without a rule)."""
    host, path, rest = pieces(F.col("url").cast("string"))
    own = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*own, host.alias("host"), path.alias("path"), rest.alias("__rest"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    names = [*rows.columns]

    def run(batches):
        for batch in batches:
            every = [tokens(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "__rest")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(every, pa.list_(pa.string()))], [*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", tokens array<string>"
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "tokens", "rule", "listed")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS, min_lift: float = MIN_LIFT, z: float = Z, sample: int = SAMPLE) -> list[tuple[tuple[str, ...], str, float, int]]:
    """(tokens, label, confidence, urls) of the pruned rules, best first; labelled: tokens, label."""
    known = labelled.where("size(tokens) > 0 AND label IS NOT NULL").select("tokens", "label")
    known = shared.materialize(known.orderBy(F.xxhash64("tokens", "label")).limit(sample).withColumn("__row", F.monotonically_increasing_id()))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return []
    # Tokens of exactly the same urls become one item, named by the first of them.
    places = known.select(F.xxhash64("__row").alias("__at"), F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("__at").alias("x"), F.sum(F.col("__at").bitwiseAND(0xFFFFFFFF)).alias("y"))
    places = places.where(F.col("n") >= max(min_urls, min_support * total))
    items = places.groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("all")).select(F.col("all")[0].alias("item"), "all")
    items = shared.materialize(items)  # at most a url's tokens / MIN_SUPPORT
    baskets = known.select("__row", "label", F.explode("tokens").alias("item")).join(items.select("item"), "item", "left_semi")
    baskets = baskets.groupBy("__row", "label").agg(F.collect_list("item").alias("own")).select(F.concat("own", F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_urls / total), minConfidence=min_confidence).fit(baskets)
    label = F.filter("items", lambda x: x.startswith("="))
    body = F.array_sort(F.filter("items", lambda x: ~x.startswith("=")))
    sets = shared.materialize(model.freqItemsets.select(body.alias("body"), label.alias("label"), "freq").where("size(body) > 0 AND size(label) <= 1"))
    alone = sets.where("size(label) = 0").select("body", F.col("freq").alias("all"))
    both = sets.where("size(label) = 1").select("body", F.substring(F.col("label")[0], 2, 1000).alias("label"), "freq")
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("label") == name, n / total).otherwise(share)
    strong = both.join(alone, "body").withColumn("confidence", F.col("freq") / F.col("all"))
    p, n = F.col("confidence"), F.col("all")
    lower = (p + z * z / (n * 2) - z * F.sqrt(p * (1 - p) / n + z * z / (n * n * 4))) / (1 + z * z / n)
    strong = strong.where((p >= min_confidence) & (lower >= share * min_lift)).collect()
    whole = {r.item: tuple(r["all"]) for r in items.collect()}
    kept: dict[tuple[frozenset, str], float] = {}
    out = []
    for r in sorted(strong, key=lambda r: (len(r.body), r.body)):
        own = frozenset(r.body)
        parts = [own - {x} for x in own] if len(own) > 1 else []
        covered = any(kept.get((p, r.label), -1.0) >= r.confidence for p in parts)
        kept[own, r.label] = max([r.confidence, *[kept.get((p, r.label), -1.0) for p in parts]])
        if not covered:
            out.append((tuple(sorted({t for x in own for t in whole[x]})), r.label, float(r.confidence), int(r.freq)))
    return sorted(out, key=lambda r: (-r[2], -r[3], r[0], r[1]))


def inverted(rules) -> dict[str, list[tuple[int, frozenset, str]]]:
    """Rules (rank, tokens, label) by their rarest token."""
    uses: dict[str, int] = {}
    for body, *_ in rules:
        for x in body:
            uses[x] = uses.get(x, 0) + 1
    out: dict[str, list] = {}
    for rank, (body, label, *_rest) in enumerate(rules):
        out.setdefault(min(body, key=lambda x: (uses[x], x)), []).append((rank, frozenset(body), label))
    return out


def judge(parsed: DataFrame, rules, keep: list[str]) -> DataFrame:
    """``keep``, host, path, rule, verdict, mined (tokens of the deciding mined rule)."""
    if not rules:
        verdict = F.coalesce("listed", F.lit("allow"))
        return parsed.select(*keep, "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("string").alias("mined"))
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema.fields}
    texts = [" ".join(body) for body, *_ in rules]
    index = parsed.sparkSession.sparkContext.broadcast(inverted(rules))

    def run(batches):
        by_token = index.value
        for batch in batches:
            verdicts, mined = [], []
            for own, listed in zip(batch.column("tokens").to_pylist(), batch.column("listed").to_pylist()):
                best = None
                if listed is None and own:
                    have = frozenset(own)
                    fits = [(rank, label) for t in own for rank, body, label in by_token.get(t, ()) if body <= have]
                    best = min(fits, default=None)
                verdicts.append(listed or (best[1] if best else "allow"))
                mined.append(texts[best[0]] if best else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*keep, "host", "path", "rule")] + [pa.array(verdicts, pa.string()), pa.array(mined, pa.string())], [*keep, "host", "path", "rule", "verdict", "mined"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["host string, path string, rule string, verdict string, mined string"])
    return parsed.mapInArrow(run, schema)


def article(html: Column) -> Column:
    """The whole text of a page's article (of the page, where none is marked) without its heading, tags and white space."""
    inner = F.regexp_extract(html, r"(?s)<article[^>]*>(.*)</article>", 1)
    text = F.when(inner != "", inner).otherwise(html)
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<script\b.*?</script>", r"(?s)<style\b.*?</style>", r"(?s)<h1[^>]*>.*?</h1>", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return F.regexp_replace(text, r"\s+", "")


def page_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, label) of pages that hold a labelled document: block for low quality or toxicity, else allow.

    A page holds a document when the whole texts agree, white space aside; of documents with one text the
    majority counts, block on a tie.  Texts are compared by their SHA-256.
    """
    bad = F.greatest(F.coalesce(1 - F.col("quality"), F.lit(0)), F.coalesce(F.col("toxic"), F.lit(0)))
    plain = lambda text: F.unhex(F.sha2(text, 256)).alias("__text")
    # Texts are hashed before they meet their labels, so none of them is shuffled.
    hashed = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("t")).where("t <> ''").select("doc_id", plain(F.col("t")))
    known = labels.where("doc_id IS NOT NULL").select("doc_id", bad.alias("bad")).join(hashed, "doc_id").groupBy("__text").agg(F.avg("bad").alias("bad"))
    held = pages.select("page_id", plain(article(F.col("html")))).join(known, "__text")
    return held.select("page_id", F.when(F.col("bad") >= 0.5, "block").otherwise("allow").alias("label"))


def cross_validate(labelled: DataFrame, folds: int = 5, **bounds) -> dict[str, float]:
    """Rules mined on all folds but one, judged on that one: counts of rules, of urls that rules decide, and of right ones."""
    rows = shared.materialize(labelled.select("tokens", "label", F.pmod(F.xxhash64("tokens", "label"), F.lit(folds)).alias("__fold"), F.lit(None).cast("string").alias("listed"), F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("rule")))
    out = {"urls": rows.count(), "block": rows.where("label = 'block'").count(), "rules": 0, "decided": 0, "right": 0, "blocked": 0, "blocked_right": 0}
    for fold in range(folds):
        rules = mine(rows.where(F.col("__fold") != fold), **bounds)
        judged = judge(rows.where(F.col("__fold") == fold), rules, ["label"]).where("mined IS NOT NULL")
        right, blocked = F.col("verdict") == F.col("label"), F.col("verdict") == "block"
        got = judged.agg(F.count(F.lit(1)).alias("decided"), F.count_if(right).alias("right"), F.count_if(blocked).alias("blocked"), F.count_if(blocked & right).alias("blocked_right")).first().asDict()
        for k, v in {"rules": len(rules), **got}.items():
            out[k] += v
    return out


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls learn from the labels of the documents that their pages hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parsed = shared.materialize(parse(pages, ["page_id"]))
    labelled = page_labels(pages, shared.documents(spark, sf_dir), shared.labels(spark, sf_dir))
    rules = mine(parsed.select("page_id", "tokens").join(labelled, "page_id").select("tokens", "label"))
    return judge(parsed, rules, ["page_id"])
