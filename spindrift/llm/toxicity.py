"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a step is one word (a run of letters and digits): a hashed word vector next to the mean of its hashed character grams, so
unseen words are read by their spelling.  A text is cut into overlapping windows of WINDOW words, one
every STRIDE words, down to its last word; two GRUs read each window in both directions, every position
gets an attention weight and a vote, and the window's logit is the weighted vote.  A document's score weighs
its most toxic window and the most toxic one that does not overlap it.

Labels are per document, so training chooses windows: of a toxic document the one that looks most toxic to
the model so far, of a clean one random ones and the two worst.  Per round all windows of the training texts
are scored anew.  Scores are calibrated on a quarter of the labelled documents that the fit leaves out, if each
label has SPARE_FROM documents or more (a parameter of ``fit`` and ``train``); with fewer, where a quarter would be
too few to calibrate on, on all of them.

Beside their vectors, words bring three fixed inputs: naive-Bayes log odds of the word and of its grams (``prior``;
README has the accuracy without them).

Defined results: a null text counts as empty; an empty text has one empty window, whose logit is the bias;
with labels of one kind only (or none) every score is the share of label 1 (0 without labels).  Of several
documents with one labelled id the one with the least hash of its text is learnt from.  Repeated rows and null
ids are scored each by itself; extra columns, also ones named like a result, are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import shared, textkit

WINDOW, STRIDE = 48, 36
HIDDEN, EMBED = 8, 8
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 15
#: Words and grams in fewer training documents than this have no vector of their own.
LEAST_DOCS = 5
PRIOR_DOCS = 8.0
PER_CLASS = 1200
ROUNDS = 8
SPARE_FROM = 80


# --- words and windows ------------------------------------------------------------------------

class Vocabulary:
    """Distinct words of a block: their word bucket and the buckets of their character grams.

    Grams are the trigrams, word edges included, and the runs of up to five bytes from every byte.
    """

    def __init__(self, words: textkit.Words):
        codes, unique = pd.factorize(words.hashes())
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        start, end = words.start[first], words.end[first]
        self.codes = codes.astype(np.int64)
        self.word = (unique.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & (WORD_BUCKETS - 1)
        length = end - start
        self.first = np.concatenate(([0], np.cumsum(2 * length)))
        self.grams = np.empty(self.first[-1], np.int32)
        for lo in range(0, len(unique), 16384):  # bounds the scratch memory
            some = slice(lo, lo + 16384)
            self.grams[self.first[lo] : self.first[min(lo + 16384, len(unique))]] = self._spell(words.buf, start[some], end[some])

    @staticmethod
    def _spell(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(length)))[:-1], length) + np.arange(length.sum())
        lead, stop = np.repeat(start, length), np.repeat(end, length)
        # A word's bytes with an edge on both sides.
        byte = lambda k: np.where((at + k >= lead) & (at + k < stop), buf[np.clip(at + k, 0, len(buf) - 1)], 1).astype(np.uint64)
        tri = byte(-1) << np.uint64(16) | byte(0) << np.uint64(8) | byte(1)
        five = tri << np.uint64(16) | byte(2) << np.uint64(8) | byte(3)
        grams = np.stack([textkit.mix64(tri), textkit.mix64(five + np.uint64(1 << 60))], 1)
        return (grams.reshape(-1) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.word)

    def odds(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Per word: its own log odds, the mean and the maximum of its grams'."""
        if not len(self):
            return np.zeros((0, 3), np.float32)
        own = grams[self.grams].astype(np.float32)
        return np.stack([words[self.word], np.add.reduceat(own, self.first[:-1]) / np.diff(self.first), np.maximum.reduceat(own, self.first[:-1])], 1).astype(np.float32)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean of the grams' rows per word."""
        if not len(self):
            return np.zeros((0, table.shape[1]), table.dtype)
        out = np.empty((len(self), table.shape[1]), table.dtype)
        for lo in range(0, len(self), 16384):  # bounds the gathered rows
            first = self.first[lo : lo + 16385]
            rows = table[self.grams[first[0] : first[-1]]]
            out[lo : lo + 16384] = np.add.reduceat(rows, first[:-1] - first[0], axis=0) / np.diff(first)[:, None].astype(table.dtype)
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all windows; a document without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    lead = np.concatenate(([0], np.cumsum(count)))[:-1]
    offset = (np.arange(len(doc)) - lead[doc]) * STRIDE
    return doc, first[:-1][doc] + offset, np.minimum(WINDOW, n[doc] - offset)


def window_index(codes: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """(WINDOW, n_windows) word numbers, ``pad`` beyond a window's end."""
    step = np.arange(WINDOW)[:, None]
    at = start[None, :] + step
    inside = step < size[None, :]
    return np.where(inside, codes[np.minimum(at, max(0, len(codes) - 1))] if len(codes) else pad, pad)


# --- the network ------------------------------------------------------------------------------

def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    model = {"word": normal(WORD_BUCKETS, EMBED, scale=0.05), "gram": normal(GRAM_BUCKETS, EMBED, scale=0.05)}
    for d in "fb":
        model["w" + d] = normal(2 * EMBED + 3, 3 * HIDDEN, scale=0.3)
        model["u" + d] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
        model["c" + d] = np.zeros(3 * HIDDEN, np.float32)
        model["v" + d] = normal(HIDDEN, 2, scale=0.5)  # attention and vote
    model["bias"] = np.zeros(1, np.float32)
    return model


def inputs(model: dict, vocabulary: Vocabulary) -> np.ndarray:
    """Per word: its vector, the mean vector of its grams, and three fixed log odds."""
    return np.concatenate([model["word"][vocabulary.word], vocabulary.mean(model["gram"]), vocabulary.odds(model["word_odds"], model["gram_odds"])], axis=1)


def _gates(model: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    """Input part of the gates per word; one more row, for the pad, that leaves the state as it is."""
    out = {}
    for d in "fb":
        g = x @ model["w" + d] + model["c" + d]
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = 40.0
        out[d] = np.concatenate([g, pad])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def logits(model: dict, gates: dict, index: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Logit of each window: both directions, attention softmax over the words that are there."""
    n, pad = index.shape[1], len(gates["f"]) - 1
    out = np.zeros(n, np.float32)
    for lo in range(0, n, chunk):
        part = index[:, lo : lo + chunk]
        total = np.zeros((WINDOW, part.shape[1], 2), np.float32)
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h, u, v, g = np.zeros((part.shape[1], HIDDEN), np.float32), model["u" + d], model["v" + d], gates[d]
            for t in order:
                x, hu = g[part[t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                cand = hu[:, 2 * HIDDEN :]
                cand *= zr[:, HIDDEN:]
                cand += x[:, 2 * HIDDEN :]
                np.tanh(cand, out=cand)
                h -= cand
                h *= zr[:, :HIDDEN]
                h += cand
                total[t] += h @ v
        attention = np.where(part == pad, -1e9, total[:, :, 0])
        attention = np.exp(attention - attention.max(0))
        out[lo : lo + chunk] = np.where(part[0] == pad, 0, (attention * total[:, :, 1]).sum(0) / attention.sum(0)) + model["bias"][0]
    return out


def _learn(model: dict, vocabulary: Vocabulary, odds: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss over a batch of windows; odds: per label and word."""
    n_words, B = len(vocabulary), index.shape[1]
    there = index < n_words
    pairs, local = np.unique((index + y.astype(np.int64) * n_words)[there], return_inverse=True)
    used, side = pairs % n_words, pairs // n_words
    place = np.full(index.shape, len(used))
    place[there] = local
    counts = np.diff(vocabulary.first)[used]
    begin = np.concatenate(([0], np.cumsum(counts)))
    gram_at = np.repeat(vocabulary.first[used] - begin[:-1], counts) + np.arange(begin[-1])
    grams = vocabulary.grams[gram_at]
    x = np.concatenate([model["word"][vocabulary.word[used]], np.add.reduceat(model["gram"][grams], begin[:-1], axis=0) / counts[:, None].astype(np.float32), odds[side, used]], axis=1)
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    mask = (place < len(used)).astype(np.float32)[:, :, None]
    tape, total = {}, np.zeros((WINDOW, B, 2), np.float32)
    for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        h, g = np.zeros((B, HIDDEN), np.float32), x @ model["w" + d] + model["c" + d]
        steps = []
        for t in order:
            xg, hu = g[place[t]], h @ model["u" + d]
            zr = _sigmoid(xg[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            cand = np.tanh(xg[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = (cand + z * (h - cand)) * mask[t] + h * (1 - mask[t])
            steps.append((t, h, z, r, cand, hu[:, 2 * HIDDEN :], new))
            h = new
            total[t] += h @ model["v" + d]
        tape[d] = steps
    attention = np.where(mask[:, :, 0] > 0, total[:, :, 0], -1e9)
    attention = np.exp(attention - attention.max(0))
    attention /= attention.sum(0)
    vote = (attention * total[:, :, 1]).sum(0)
    out = vote + model["bias"][0]
    slope = weight * (1 / (1 + np.exp(-out)) - y)
    grad = {k: np.zeros_like(v) for k, v in model.items() if not k.endswith("odds")}
    grad["bias"][0] = slope.sum()
    dtotal = np.empty_like(total)
    dtotal[:, :, 1] = attention * slope
    dtotal[:, :, 0] = attention * (total[:, :, 1] - vote) * slope
    dx = np.zeros_like(x)
    for d in "fb":
        dh = np.zeros((B, HIDDEN), np.float32)
        dg = np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t, h, z, r, cand, hn, new in reversed(tape[d]):
            dh = dh + dtotal[t] @ model["v" + d].T
            grad["v" + d] += new.T @ dtotal[t]
            live = dh * mask[t]
            dcand = live * (1 - z) * (1 - cand**2)
            dz = live * (h - cand) * z * (1 - z)
            dr = dcand * hn * r * (1 - r)
            hidden = np.concatenate([dz, dr, dcand * r], axis=1)
            grad["u" + d] += h.T @ hidden
            dh = dh * (1 - mask[t]) + live * z + hidden @ model["u" + d].T
            np.add.at(dg, place[t], np.concatenate([dz, dr, dcand], axis=1))
        dg[-1] = 0
        grad["c" + d] += dg.sum(0)
        grad["w" + d] += x.T @ dg
        dx += dg @ model["w" + d].T
    np.add.at(grad["word"], vocabulary.word[used], dx[:-1, :EMBED])
    np.add.at(grad["gram"], grams, np.repeat(dx[:-1, EMBED : 2 * EMBED] / counts[:, None].astype(np.float32), counts, axis=0))
    return grad


def fit(buf: np.ndarray, offs: np.ndarray, label: np.ndarray, share: float | None = None, rounds: int = ROUNDS, seed: int = 5, spare_from: int = SPARE_FROM, prior: bool = True) -> dict[str, np.ndarray]:
    """A calibrated model from whole labelled texts (bytes and offsets).

    ``share``: of toxic documents among all labelled ones, if the texts were not drawn in proportion.
    ``prior``: whether words bring their log odds.
    """
    model = new_model(seed + 6)
    label = np.asarray(label, float)
    n_docs = len(label)
    if n_docs == 0 or label.min() == label.max():
        share = float(np.clip(label.mean() if n_docs else 0.0, 1e-4, 1 - 1e-4))
        return {"constant": np.array([share])}
    rng = np.random.default_rng(seed)
    words = textkit.Words(buf, offs, apart=textkit.NOT_ALNUM)
    vocabulary = Vocabulary(words)
    doc, start, size = windows(words.first)
    index = window_index(vocabulary.codes, start, size, len(vocabulary))
    # With enough of both labels a quarter of the documents is kept for the calibration.
    spare = (np.arange(n_docs) % 4 == 3) & (min((label > 0).sum(), (label == 0).sum()) >= spare_from)
    shown = np.flatnonzero(~spare)

    def by_document(spelled: bool):
        """(document, its distinct items), one document at a time, so that grams need little memory."""
        for d in shown:
            kinds = np.unique(vocabulary.codes[words.first[d] : words.first[d + 1]])
            yield d, np.unique(vocabulary.grams[_ranges(vocabulary, kinds)] if spelled else vocabulary.word[kinds])

    word_odds, known = _log_odds(by_document(False), label, len(shown), WORD_BUCKETS)
    gram_odds, spelt = _log_odds(by_document(True), label, len(shown), GRAM_BUCKETS)
    if not prior:
        word_odds, gram_odds = word_odds * 0, gram_odds * 0
    model["word_odds"], model["gram_odds"] = word_odds[2], gram_odds[2]
    mask = {"word": known[:, None].astype(np.float32), "gram": spelt[:, None].astype(np.float32)}
    for k, m in mask.items():
        model[k] *= m
    # A training document sees odds that leave one document of its label out; others see all.
    odds = np.stack([vocabulary.odds(word_odds[k], gram_odds[k]) for k in (0, 1, 2)])
    view = np.where(spare, 2, label > 0)
    hint = np.concatenate([odds[:, :, 0] + odds[:, :, 1], np.full((3, 1), -9.0)], 1)
    score = np.sort(hint[view[doc][None, :], index], axis=0)[-2:].sum(0)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items() if not k.endswith("odds")}
    step, many = 0, np.bincount(doc, minlength=n_docs)
    for _ in range(rounds):
        rank = np.lexsort((-score, doc))
        lead = np.searchsorted(doc[rank], np.arange(n_docs))
        clean = np.flatnonzero((label == 0) & ~spare)
        loose = np.concatenate([lead[clean] + (rng.random(len(clean)) * many[clean]).astype(np.int64) for _ in range(2)])
        second = np.minimum(lead[clean] + 1, lead[clean] + many[clean] - 1)
        pick = np.unique(rank[np.concatenate([lead[~spare], loose, second])])
        pick = pick[index[0, pick] < len(vocabulary)]
        target = label[doc[pick]]
        balance = np.where(target > 0, 0.5 / max(1, (target > 0).sum()), 0.5 / max(1, (target == 0).sum())) * len(pick)
        # Small tables get about as many updates as large ones.
        for _ in range(max(1, 16 // max(1, len(pick) // 96))):
            order = rng.permutation(len(pick))
            for lo in range(0, len(order), 96):
                part = pick[order[lo : lo + 96]]
                shown_index = np.where(rng.random(index[:, part].shape) < 0.1, len(vocabulary), index[:, part])
                shown_index[0] = index[0, part]
                grad = _learn(model, vocabulary, odds, shown_index, label[doc[part]].astype(np.float32), (balance[order[lo : lo + 96]] / len(part)).astype(np.float32))
                step += 1
                rate = 0.01 * min(1.0, step / 30)
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    slower = 0.05 if k in mask else 1.0
                    model[k] -= rate * slower * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)) + rate * 1e-3 * model[k]
                    if k in mask:
                        model[k] *= mask[k]
        base = inputs(model, vocabulary)
        for k in (0, 1, 2):
            base[:, -3:] = odds[k]
            mine = np.flatnonzero(view[doc] == k)
            score[mine] = logits(model, _gates(model, base), index[:, mine])
    judged = spare if spare.any() else np.ones(n_docs, bool)
    model["calibration"] = _calibrate(evidence(doc, score, n_docs)[judged], label[judged], share)
    return model


def evidence(doc: np.ndarray, score: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: logit of the worst window, of the worst one that does not overlap it (else 0), whether there is one, 1."""
    rank = np.lexsort((-score, doc))
    lead = rank[np.searchsorted(doc[rank], np.arange(n_docs))]
    apart = np.abs(np.arange(len(doc)) - lead[doc]) >= 2
    second = np.full(n_docs, -1e9)
    np.maximum.at(second, doc[apart], score[apart])
    there = second > -1e8
    return np.stack([score[lead], np.where(there, second, 0.0), there, np.ones(n_docs)], 1)


def _ranges(vocabulary: Vocabulary, codes: np.ndarray) -> np.ndarray:
    counts = np.diff(vocabulary.first)[codes]
    begin = np.concatenate(([0], np.cumsum(counts)))
    return np.repeat(vocabulary.first[codes] - begin[:-1], counts) + np.arange(begin[-1])


def _log_odds(documents, label: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How the log odds of a toxic document change with an item, shrunk by PRIOR_DOCS average documents:
    without one clean document, without one toxic document, with all; and which items are known.

    documents: (document, its distinct items).
    """
    there, toxic = np.zeros((2, size), np.int64), 0
    for d, items in documents:
        there[int(label[d] > 0)][items] += 1
        toxic += label[d] > 0
    known = there[0] + there[1] >= LEAST_DOCS
    base = toxic / n_docs
    out = []
    for less in (0, 1, None):
        neg, pos = (np.maximum(there[c] - (less == c), 0) for c in (0, 1))
        share = (pos + PRIOR_DOCS * base) / (neg + pos + PRIOR_DOCS)
        out.append(np.where(known, np.clip(np.log(share / (1 - share)) - np.log(base / (1 - base)), -4, 4), 0.0))
    return np.array(out, np.float32), known


_PRIOR = np.array([0.7, 0.2, 0.0, 0.0])


def _calibrate(x: np.ndarray, label: np.ndarray, share: float | None) -> np.ndarray:
    """Weights of a sigmoid over a document's evidence, by Newton steps on log loss at the given share of toxic ones."""
    pos, neg = (label > 0).sum(), (label == 0).sum()
    share = pos / (pos + neg) if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(label > 0, share / max(1, pos), (1 - share) / max(1, neg))
    w = _PRIOR.copy()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - target)) + 3e-3 * (w - _PRIOR)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 3e-3 * np.eye(4)
        w = w - np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    return np.maximum(w, [0.05, 0.0, -99.0, -99.0])


def score_block(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Score of each whole document of a block."""
    n_docs = len(offs) - 1
    if "constant" in model:
        return np.full(n_docs, model["constant"][0])
    words = textkit.Words(buf, offs, apart=textkit.NOT_ALNUM)
    vocabulary = Vocabulary(words)
    doc, start, size = windows(words.first)
    gates = _gates(model, inputs(model, vocabulary))
    score = np.concatenate([
        logits(model, gates, window_index(vocabulary.codes, start[lo : lo + 16384], size[lo : lo + 16384], len(vocabulary)))
        for lo in range(0, len(doc), 16384)
    ])
    return 1 / (1 + np.exp(-np.clip(evidence(doc, score, n_docs) @ model["calibration"], -30, 30)))


# --- Spark ------------------------------------------------------------------------------------

def train(docs: DataFrame, labelled: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, spare_from: int = SPARE_FROM):
    """Fits on at most ``per_class`` labelled documents of each kind, whole texts."""
    known = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = shared.bounded_sample(known, "y", "doc_id", per_class)
    share = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    # At most 2 * per_class rows, one of each id, so the broadcast and what reaches the driver are bounded in rows; texts come whole.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    table = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toArrow()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    buf, offs = textkit.text_buffers(table.take(pa.array(order)).column("text"))
    return docs.sparkSession.sparkContext.broadcast(fit(buf, offs, table.column("y").to_numpy()[order], share, spare_from=spare_from))


def score(docs: DataFrame, model, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns and score, predicted; one pass over the texts without a shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        weights = model.value
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("__text"))
            p = np.concatenate([np.zeros(0)] + [score_block(weights, b, o) for _, _, b, o in textkit.blocks(buf, offs, 2 * textkit.BLOCK_BYTES)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double", "predicted int"])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    held = textkit.sql_crc_bucket("doc_id", 4) == 2
    model = train(docs, shared.labels(spark, sf_dir).where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
