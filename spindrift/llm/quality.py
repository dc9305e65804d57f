"""Quality classifier: linear SVM over n-gram indicators scaled by naive-Bayes log-count ratios.

Each text becomes a set of hashed indicators: word unigrams and bigrams, and 1- to 4-grams of word
*shapes* (case, digits, symbols, trailing byte class, repetition of the words before), so that
broken markup, shouting, tables and stuttering show whatever the words are.  Indicators are scaled
by r = log(p/q), the smoothed log ratio of their document counts in the two classes, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.

Defined results: a null text counts as empty; an empty text has the single indicator "no words" and
gets a score like any other; with fewer than one row of either label every score is the share of
label 1 (0.5 without labels).  Of several documents with one labelled id the one with the least indicators is
learnt from.  Repeated and null ids are scored row by row; further columns, also ones named like a result, are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

BITS = 20
PER_CLASS = 3000

_U, _D, _S = np.uint8(1), np.uint8(2), np.uint8(4)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b"#$%&*|!@^~<>{}[]\\=_+":
    _KIND[_c] = 4
_TAIL = np.zeros(256, np.uint64)
for _i, _c in enumerate(b".,;:?!%*&$#|\"')", 1):
    _TAIL[_c] = _i


def _shapes(words: textkit.Words, hashes: np.ndarray) -> np.ndarray:
    n = len(words)
    length = words.end - words.start
    kind = _KIND[words.raw]
    total = lambda bit: _spans((kind == bit), words)
    upper, digit, symbol = total(1), total(2), total(4)
    doc = words.docs()
    same = np.zeros(n, np.uint64)
    for back in (1, 2, 3):
        same[back:] |= ((hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])).astype(np.uint64) << np.uint64(back - 1)
    case = np.where(upper == 0, 0, np.where((upper >= 2) & (upper * 2 > length), 2, 1)).astype(np.uint64)
    size = np.minimum(3, length // 6).astype(np.uint64)
    shape = case | (np.minimum(digit, 2).astype(np.uint64) << np.uint64(2)) | (np.minimum(symbol, 3).astype(np.uint64) << np.uint64(4))
    shape |= (_TAIL[words.raw[words.end - 1]] << np.uint64(6)) if n else shape
    return shape | (same << np.uint64(10)) | (size << np.uint64(13))


def _spans(mask: np.ndarray, words: textkit.Words) -> np.ndarray:
    pre = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=pre[1:])
    return pre[words.end] - pre[words.start]


def _grams(ids: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = ids[: len(ids) - n + 1] + np.uint64(salt)
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    keep = doc[n - 1 :] == doc[: len(doc) - n + 1]
    return textkit.mix64(out[keep]), doc[n - 1 :][keep]


def indicators(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicator numbers of each document of a block: (numbers, n_docs+1 positions)."""
    words = textkit.Words(buf, offs)
    n_docs = len(offs) - 1
    hashes, doc = words.hashes(), words.docs()
    shapes = _shapes(words, hashes)
    parts = [_grams(hashes, doc, 1, 11), _grams(hashes, doc, 2, 12)]
    parts += [_grams(shapes, doc, k, 20 + k) for k in (1, 2, 3, 4)]
    bucket = np.minimum(15, np.log2(words.counts + 1) * 1.5).astype(np.uint64)
    parts.append((textkit.mix64(bucket + np.uint64(77)), np.arange(n_docs)))
    mask = np.uint64((1 << BITS) - 1)
    sizes = [np.searchsorted(d, np.arange(n_docs + 1)) for _, d in parts]
    ids = [(h & mask).astype(np.int64) for h, _ in parts]
    stamp = _stamp()
    out, first = [], [0]
    for i in range(n_docs):
        own = np.concatenate([x[s[i] : s[i + 1]] for x, s in zip(ids, sizes)])
        at = np.arange(len(own))
        stamp[own] = at
        own = own[stamp[own] == at]
        out.append(own)
        first.append(first[-1] + len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(first)


_STAMP: list[np.ndarray] = []


def _stamp() -> np.ndarray:
    if not _STAMP:
        _STAMP.append(np.zeros(1 << BITS, np.int64))
    return _STAMP[0]


def fit(sets: list[np.ndarray], label: np.ndarray, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """(weight per indicator with its ratio multiplied in, bias, ratios), scaled so that the sigmoid is a probability."""
    n, dim = len(sets), 1 << BITS
    y = np.where(label > 0, 1.0, -1.0)
    if n == 0 or (y > 0).all() or (y < 0).all():
        share = (y > 0).mean() if n else 0.5
        share = min(max(share, 0.01), 0.99)
        return np.zeros(dim, np.float32), float(np.log(share / (1 - share))), np.zeros(dim, np.float32)
    count = [np.full(dim, alpha), np.full(dim, alpha)]
    for x, v in zip(sets, y):
        count[int(v > 0)][x] += 1
    pos, neg = (y > 0).sum(), (y < 0).sum()
    ratio = np.log(count[1] / (pos + 2 * alpha)) - np.log(count[0] / (neg + 2 * alpha))
    # Indicators seen once or never say nothing that carries over to other texts.
    ratio[count[0] + count[1] - 2 * alpha < 3] = 0.0
    sets = [x[ratio[x] != 0] for x in sets]
    norm = np.array([max(1e-9, np.sqrt((ratio[x] ** 2).sum())) for x in sets])
    w, bias, dual = np.zeros(dim), 0.0, np.zeros(n)
    cost = np.where(y > 0, n / (2 * pos), n / (2 * neg)) * c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            x, r = sets[i], ratio[sets[i]] / norm[i]
            g = y[i] * (w[x] @ r + bias) - 1
            old = dual[i]
            dual[i] = min(max(old - g / 2.0, 0.0), cost[i])  # |x|^2 is 1, and 1 for the bias
            step = (dual[i] - old) * y[i]
            if step:
                w[x] += step * r
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    w = w * ratio
    margin = np.array([w[x].sum() / k + bias for x, k in zip(sets, norm)])
    scale = _platt(margin, y)
    return (w * scale).astype(np.float32), float(bias * scale), ratio.astype(np.float32)


def _platt(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of a sigmoid through the decision boundary, by Newton steps on balanced log loss."""
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
    a = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin * y, -30, 30)))
        g = -(weight * (1 - p) * margin * y).sum() + 0.01 * a
        h = (weight * p * (1 - p) * margin**2).sum() + 0.01
        a = min(max(a - g / h, 0.5), 12.0)
    return a


def score_sets(sets: np.ndarray, first: np.ndarray, model) -> np.ndarray:
    w, bias, ratio = model
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    up = np.bincount(doc, weights=w[sets], minlength=n)
    norm = np.sqrt(np.bincount(doc, weights=ratio[sets] ** 2, minlength=n))
    return 1 / (1 + np.exp(-(up / np.maximum(norm, 1e-9) + bias)))


def train(docs: DataFrame, labelled: DataFrame, label: str, per_class: int = PER_CLASS):
    """Fits on at most ``per_class`` rows of each label; texts become indicators before they leave the executors."""
    spark = docs.sparkSession
    chosen = shared.bounded_sample(labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")), "y", "doc_id", per_class)

    def features(batches):
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("text"))
            for lo, hi, b, o in textkit.blocks(buf, offs):
                ids, first = indicators(b, o)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), lists], ["doc_id", "y", "ids"])

    # The sample has at most 2 * per_class rows, so its broadcast is bounded.
    rows = shared.in_arrow(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), features, "doc_id long, y int, ids array<int>")
    table = rows.toArrow()
    order = np.lexsort((np.array([len(x) for x in table.column("ids")], dtype=np.int64), table.column("doc_id").to_numpy())) if table.num_rows else np.zeros(0, np.int64)
    ids = table.column("doc_id").to_numpy()[order]
    order = order[np.concatenate(([True], ids[1:] != ids[:-1]))] if len(order) else order
    lists = [x.values.to_numpy() for x in table.column("ids")]
    sets = [lists[i] for i in order]
    y = table.column("y").to_numpy()[order]
    return spark.sparkContext.broadcast(fit(sets, y))  # 2 arrays of 2**BITS numbers, 8 MB


def score(docs: DataFrame, model, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """``keep`` columns and score, predicted; one pass over the texts without a shuffle."""
    text = "text" if "text" in keep else "__text"
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        weights = model.value
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column(text))
            got = [score_sets(*indicators(b, o), weights) for _, _, b, o in textkit.blocks(buf, offs)]
            p = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    source = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return shared.in_arrow(source, run, f"{fields}, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    held = textkit.sql_crc_bucket("doc_id", 3) == 1
    model = train(docs, shared.labels(spark, sf_dir).where(~held), "quality")
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of label 1 stay, with their columns.

    Every row is judged by its own text: null and empty texts by the score of an empty text, repeated rows and rows with
    null ids like any other; an empty table stays empty.
    """
    model = train(docs, shared.labels(spark, sf_dir), "quality")
    docs, restore = shared.shield(docs)
    return score(docs, model, docs.columns).where("predicted = 1").select(*restore)
