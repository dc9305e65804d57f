import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing, packing, quality, simhash, textkit, toxicity

WORDS = "the of and stone river light green house garden letter window music paper bread winter summer morning evening yellow table".split()
BAD = ["grobian", "schuftig", "lumpig"]


def text_of(rng, n, bad=0):
    words = [rng.choice(WORDS) + rng.choice(["", "s", ",", "."]) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD) + rng.choice(["", "!", "e"])
    return " ".join(words)


def labelled(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, text_of(rng, rng.randint(10, 150), 3 if bad else 0), int(bad)))
    return rows


def auc(scores, y):
    p, n = scores[y == 1], scores[y == 0]
    return (p[:, None] > n[None]).mean() + 0.5 * (p[:, None] == n[None]).mean()


def test_gradients_of_the_network():
    rng = random.Random(2)
    buf, offs = textkit.text_buffers(pa.array([text_of(rng, n) for n in (3, 60, 1)]))
    words = textkit.Words(buf, offs, apart=textkit.NOT_ALNUM)
    vocabulary = toxicity.Vocabulary(words)
    doc, start, size = toxicity.windows(words.first)
    index = toxicity.window_index(vocabulary.codes, start, size, len(vocabulary))
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    model["word"] *= 10
    odds = np.random.default_rng(0).normal(size=(3, len(vocabulary), 3))
    y, weight = (doc % 2).astype(np.float64), np.ones(len(doc))

    def loss(m):
        got = []
        for k in range(len(doc)):
            x = np.concatenate([m["word"][vocabulary.word], vocabulary.mean(m["gram"]), odds[int(y[k])]], 1)
            got.append(toxicity.logits(m, toxicity._gates(m, x), index[:, [k]])[0])
        out = np.array(got, np.float64)
        return (np.log1p(np.exp(-np.abs(out))) + np.maximum(out, 0) - y * out).sum()

    grad = toxicity._learn(model, vocabulary, odds, index, y, weight)
    for key in ("wf", "wb", "uf", "ub", "cf", "cb", "vf", "vb", "bias"):
        flat = np.argsort(-np.abs(grad[key]).reshape(-1))[:2]
        for at in flat:
            step = np.zeros(grad[key].size)
            step[at] = 1e-3
            move = {**model, key: model[key] + step.reshape(grad[key].shape)}
            back = {**model, key: model[key] - step.reshape(grad[key].shape)}
            assert abs((loss(move) - loss(back)) / 2e-3 - grad[key].reshape(-1)[at]) < 2e-2 * max(1, abs(grad[key].reshape(-1)[at])), key


def test_forward_pass_against_a_plain_loop():
    """One word, one gate and one window at a time."""
    rng = random.Random(3)
    buf, offs = textkit.text_buffers(pa.array([text_of(rng, n) for n in (1, 7, 100)] + [""]))
    words = textkit.Words(buf, offs, apart=textkit.NOT_ALNUM)
    vocabulary = toxicity.Vocabulary(words)
    doc, start, size = toxicity.windows(words.first)
    index = toxicity.window_index(vocabulary.codes, start, size, len(vocabulary))
    model = toxicity.new_model()
    model["word"] = model["word"] * 20
    model["bias"][0] = 0.3
    x = np.random.default_rng(1).normal(size=(len(vocabulary), 2 * toxicity.EMBED + 3)).astype(np.float32)
    got = toxicity.logits(model, toxicity._gates(model, x), index)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    H = toxicity.HIDDEN
    for k in range(len(doc)):
        own = [x[c] for c in index[:, k] if c < len(vocabulary)]
        pairs = np.zeros((len(own), 2))
        for d, order in (("f", range(len(own))), ("b", reversed(range(len(own))))):
            h, w, u, c, v = np.zeros(H), *(model[n + d].astype(float) for n in "wucv")
            for t in order:
                z = sigmoid(own[t] @ w[:, :H] + c[:H] + h @ u[:, :H])
                r = sigmoid(own[t] @ w[:, H : 2 * H] + c[H : 2 * H] + h @ u[:, H : 2 * H])
                cand = np.tanh(own[t] @ w[:, 2 * H :] + c[2 * H :] + r * (h @ u[:, 2 * H :]))
                h = z * h + (1 - z) * cand
                pairs[t] += h @ v
        weight = np.exp(pairs[:, 0] - pairs[:, 0].max()) if own else np.zeros(0)
        assert abs(got[k] - ((weight * pairs[:, 1]).sum() / weight.sum() if own else 0) - 0.3) < 1e-4


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 48, 97, 400])
    doc, start, size = toxicity.windows(first)
    for d, (a, b) in enumerate(zip(first, first[1:])):
        seen = {p for s, n in zip(start[doc == d], size[doc == d]) for p in range(s, s + n)}
        assert seen == set(range(a, b)) and (doc == d).any()


def test_toxicity(spark):
    train, test = labelled(1), labelled(7, 120)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in train], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    more = [(1000, None), (1001, ""), (1002, "..."), (1003, text_of(random.Random(5), 3000)), (1004, text_of(random.Random(5), 3000) + " grobian lumpig schuftig"), (5, "a"), (5, "a")]
    out = toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in test] + more, "doc_id long, text string"), model, ["doc_id"]).toPandas()
    assert len(out) == len(test) + len(more) and out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    y = np.array([y for *_, y in test])
    assert auc(out.score.to_numpy()[: len(test)], y) > 0.97
    tail = out.iloc[len(test) :]
    assert tail.predicted.tolist()[:4] == [0, 0, 0, 0] and tail.predicted.tolist()[4] == 1 and tail.score.iloc[0] == tail.score.iloc[1]
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(df.limit(3), toxicity.train(df, few), ["doc_id"]).where("predicted = 1").count() == 0


def test_quality(spark):
    rng = random.Random(4)
    junk = lambda t: rng.choice([t.upper() + "!!", " | ".join(t.split()), " ".join(w + "%%%" for w in t.split()), " ".join([t.split()[0]] * 40)])
    rows = [(i, text_of(rng, rng.randint(20, 120)), i % 4 != 0) for i in range(300)]
    rows = [(i, t if good else junk(t), int(good)) for i, t, good in rows]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    train = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200], "doc_id long, quality int")
    model = quality.train(df, train, "quality")
    out = quality.score(df, model, ["doc_id"]).toPandas().sort_values("doc_id").iloc[200:]
    assert auc(out.score.to_numpy(), np.array([y for *_, y in rows[200:]])) > 0.99
    odd = quality.score(spark.createDataFrame([(1, None), (1, ""), (None, "x" * 300_000)], "doc_id long, text string"), model, ["doc_id"]).toPandas()
    assert odd.score.between(0, 1).all() and odd.score[0] == odd.score[1]
    assert quality.score(df.limit(2), quality.train(df, train.limit(0), "quality"), ["doc_id"]).first().score == 0.5
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_quality_indicators_are_distinct_per_document():
    buf, offs = textkit.text_buffers(pa.array(["a b a b a b", "a", "", "a b"]))
    ids, first = quality.indicators(buf, offs)
    for k in range(4):
        own = ids[first[k] : first[k + 1]]
        assert len(own) == len(set(own.tolist())) >= 1


def test_fit_against_a_plain_solver():
    """The same objective, minimised by subgradient steps over dense vectors."""
    rng = np.random.default_rng(5)
    sets, label = [], []
    for i in range(60):
        good = i % 3 > 0
        sets.append(np.unique(rng.choice(40, 8, p=np.where(np.arange(40) < 20, 1.6 if good else 0.4, 0.4 if good else 1.6) / 40)))
        label.append(int(good))
    label = np.array(label)
    w, bias, ratio = quality.fit(sets, label, epochs=400)
    y, n = np.where(label > 0, 1.0, -1.0), len(sets)
    x = np.zeros((n, 41))
    for i, s in enumerate(sets):
        x[i, s] = ratio[s]
        x[i, :40] /= np.sqrt((x[i] ** 2).sum())
        x[i, 40] = 1  # the bias is a weight like the others
    cost = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
    objective = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    v, best = np.zeros(41), np.inf
    for k in range(1, 60001):
        v = v - (v - x.T @ (cost * y * (y * (x @ v) < 1))) / k
        best = min(best, objective(v))
    counts = [np.array([sum(k in s for s, t in zip(sets, label) if t == c) for k in range(40)]) + 1.0 for c in (0, 1)]
    want = np.log(counts[1] / (label.sum() + 2)) - np.log(counts[0] / ((1 - label).sum() + 2))
    assert np.allclose(ratio[:40][ratio[:40] != 0], want[ratio[:40] != 0], atol=1e-5)
    own = np.append(np.divide(w[:40], ratio[:40], out=np.zeros(40), where=ratio[:40] != 0), bias)
    scales = np.linspace(0.05, 2, 4000) * np.linalg.norm(v) / np.linalg.norm(own)  # the sigmoid's slope is multiplied in
    assert min(objective(own * s) for s in scales) < best * 1.01


def test_dual_coordinate_descent_separates():
    sets = [np.array([0, 2]), np.array([0, 3]), np.array([0, 4]), np.array([1, 2]), np.array([1, 3]), np.array([1, 4])]
    model = quality.fit(sets, np.array([1, 1, 1, 0, 0, 0]))
    got = quality.score_sets(np.concatenate(sets), np.arange(0, 13, 2), model)
    assert (got[:3] > 0.5).all() and (got[3:] < 0.5).all() and model[2][2] == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    langs = {"en": "the of and to that with", "fr": "le la les des une dans", "de": "der die das und nicht ist", "es": "el los las una por con"}
    share = {"en": 0.6, "fr": 0.2, "de": 0.1, "es": 0.1}
    rows = []
    for i in range(600):
        lang = rng.choices(list(share), list(share.values()))[0]
        rows.append((i, " ".join(rng.choice(langs[lang].split()) for _ in range(rng.randint(1, 200))), lang))
    rows += [(900, None, "en"), (901, "", None), (5, "the of", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rate", F.lit("clash"))
    mixed, report = mixing.mix(df, df.select("doc_id").where("doc_id < 300"))
    out = mixed.toPandas()
    assert len(out) == len(rows) and (out.rate >= 0).all() and np.allclose(report["reached"], report["wanted"], rtol=0.02)
    p = np.stack(out.p)
    assert np.allclose(p.sum(1), 1) and np.allclose((p * (out.rate * out.tokens).to_numpy()[:, None]).sum(0), report["reached"], rtol=1e-3)
    # Against a solver that knows nothing of posteriors being all that matters.
    rate, t, want = np.ones(len(out)), out.tokens.to_numpy(float), report["wanted"]
    total = want.sum()
    for _ in range(4000):
        residual = ((rate * t) @ p - want) / total
        rate = np.maximum(0, rate - 0.2 * (2 * p @ residual + 2e-3 * (rate - 1)))
    objective = lambda r: ((((r * t) @ p - want) / total) ** 2).sum() + 1e-3 * (t / total * (r - 1) ** 2).sum()
    assert objective(out.rate.to_numpy()) < objective(rate) + 1e-4
    assert (abs(out.copies - out.rate) <= 1).all()
    for empty in (df.limit(0), df.where("text = ''")):
        assert mixing.mix(empty, df.select("doc_id"))[0].count() == empty.count()


@pytest.mark.parametrize("shares", [(0.97, 0.01, 0.01, 0.01), (0.985, 0.005, 0.005, 0.005), (0.9, 0.05, 0.04, 0.01)])
@pytest.mark.parametrize("least", [0.0, 1.0])
def test_skewed_domains_meet_targets(spark, shares, least):
    rows = [(int(1e6 * s / 20), [float(i == d) for i in range(4)]) for d, s in enumerate(shares) for _ in range(20)]
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    want = np.array(list(mixing.TARGETS.values()))
    total = None if least == 0 else float((1e6 * np.array(shares) / want).max())
    _, report = mixing.fit_rates(df, want, total, least)
    assert np.allclose(report["reached"], want * (total or 1e6), rtol=mixing.RESIDUAL)


def test_copies_follow_rates():
    rng = np.random.default_rng(3)
    domain, tokens, rate = rng.integers(0, 4, 5000), rng.integers(0, 3000, 5000), rng.random(5000) * 3
    for cuts in ([0, 5000], [0, 1, 700, 701, 5000]):  # batches of a task do not matter
        whole = mixing.Copies(17)
        got = np.concatenate([whole(domain[a:b], tokens[a:b], rate[a:b]) for a, b in zip(cuts, cuts[1:])])
        assert ((got == np.floor(rate)) | (got == np.ceil(rate))).all()
        for d in range(4):
            mine = domain == d
            assert abs(got[mine].sum() - rate[mine].sum()) < 13
            assert abs((got * tokens)[mine].sum() / (rate * tokens)[mine].sum() - 1) < 0.01
    seeds = [mixing.Copies(s)(np.zeros(1, int), np.ones(1, int), np.array([0.3]))[0] for s in range(4000)]
    assert abs(np.mean(seeds) - 0.3) < 0.03


def test_zero_targets(spark):
    assert mixing.least_total(np.array([50.0, 30.0, 20.0]), np.array([0.5, 0.5, 0.0])) == 100 and mixing.least_total(np.zeros(2), np.zeros(2)) == 0
    words = {"a": "ein der die", "b": "the of and", "c": "el los las"}
    rows = [(i, " ".join([words[d]] * 20), d) for i, d in enumerate("aabbbbccccc" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed, report = mixing.mix(df, df.select("doc_id"), {"a": 1.0, "b": 1.0, "c": 0.0}, least=1.0, total_of=mixing.least_total)
    out = mixed.toPandas()
    assert out.copies.min() >= 1 and out.copies.max() < 10 and abs(report["reached"][0] / report["reached"][1] - 1) < 0.05


def brute_padding(lengths, k):
    values = sorted(set(lengths))
    cost = lambda i, j: sum(values[j] - x for x in lengths if values[i] <= x <= values[j])
    best = {(-1, 0): 0}
    for n in range(1, k + 1):
        for j in range(len(values)):
            options = [best[i, n - 1] + cost(i + 1, j) for i in range(-1, j) if (i, n - 1) in best]
            if options:
                best[j, n] = min(options)
    return min(v for (j, n), v in best.items() if j == len(values) - 1)


@pytest.mark.parametrize("seed", range(10))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(0, 9), rng.randint(0, 60), *[rng.randint(1024, 1100)] * (seed > 7)]) for _ in range(rng.randint(1, 60))]
    k = rng.randint(1, 5)
    top, count = np.unique(lengths, return_counts=True)
    tops = packing.boundaries(top, count, top * count, k)
    assert len(tops) <= k and tops[-1] == max(lengths)
    assert sum(min(t for t in tops if t >= x) - x for x in lengths) == brute_padding(lengths, k)


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 37)
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([3, 10, rng.randint(0, 200), rng.randint(1020, 1060)])) for i in range(500)] + [(900, None), (901, "w " * 3000), (7, "w w w"), (7, "w w w"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    out = packing.pack(packing.lengths(df, ["doc_id"]), 5, 512).toPandas()
    assert out.padding.sum() == brute_padding([len((t or "").split()) for _, t in rows], 5)
    assert len(out) == len(rows) and sorted(out.n_tokens) == sorted(len((t or "").split()) for _, t in rows)
    assert (out.bucket_len >= out.n_tokens).all() and (out.padding == out.bucket_len - out.n_tokens).all()
    for _, batch in out.groupby("batch_id"):
        assert batch.bucket.nunique() == 1 and sorted(batch.slot) == list(range(len(batch)))
        assert len(batch) * batch.bucket_len.iloc[0] <= 512 or len(batch) == 1
    for bucket, part in out.groupby("bucket"):
        full = max(1, 512 // max(1, part.bucket_len.iloc[0]))
        sizes = part.groupby("batch_id").size()
        assert (sizes < full).sum() <= 1 and len(sizes) == -(-len(part) // full)
    other = packing.pack(packing.lengths(df, ["doc_id"]), 5, 512).toPandas()  # the same with other ranges
    key = ["doc_id", "n_tokens", "batch_id", "slot"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, other[key].values.tolist()))
    assert packing.pack(packing.lengths(df.limit(0), ["doc_id"])).count() == 0


def brute_edit(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        k = len(text) // 3
        yield doc, text, text[: len(text) - k] + after[:k], after


def brute_fingerprint(text):
    """Votes one term and one bit at a time; hashes as the module defines them."""
    mask = 2**64 - 1

    def mix(x):
        for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * mult) & mask
        return x ^ (x >> 33)

    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", fold)
    hashes = [mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & mask) for w in words]
    terms = [(h, min(3, 1 + len(w) // 4)) for h, w in zip(hashes, words)]
    terms += [(mix((a * 0x9E3779B97F4A7C15 + b) & mask), 4) for a, b in zip(hashes, hashes[1:])]
    bits = [[0] * 64, [0] * 64]
    for h, weight in terms:
        for half, x in enumerate((h, mix(h ^ 0xA5A5A5A55A5A5A5A))):
            for k in range(64):
                bits[half][k] += weight if x >> k & 1 else -weight
    lo, hi = (sum(1 << k for k in range(64) if b[k] > 0) for b in bits)
    return f"{hi:016x}{lo:016x}"


def test_simhash_edits(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(simhash, "BUCKET_BYTES", 2000)
    rng = random.Random(9)
    rows = [(3 * i, text_of(rng, rng.randint(1, 80)) + rng.choice(["", "é😀", " \n"])) for i in range(120)] + [(1, None), (2, ""), (4, "ab"), (1000, "same text here"), (1001, "same text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("guest", F.lit(1))
    got = {r.doc_id: r for r in simhash.fingerprint_edits(df).collect()}
    assert len(got) == len(rows)
    for doc, text, changed, after in brute_edit(rows):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        fp = simhash.fingerprints(*textkit.text_buffers(pa.array([text, changed, after])))
        assert [r.fingerprint, r.edited_fingerprint] == simhash.render(fp[:2]) == [brute_fingerprint(text), brute_fingerprint(changed)]
        assert np.isclose(r.near_edited, simhash.likeness(fp[:1], fp[1:2])[0]) and np.isclose(r.near_next, simhash.likeness(fp[:1], fp[2:])[0])
    assert got[1000].fingerprint == got[1001].fingerprint and got[1].near_edited == 1
    for few in ([], [(5, "one two three four")], [(5, "a b c"), (None, "d e f"), (5, "a b c")]):
        assert simhash.fingerprint_edits(spark.createDataFrame(few, "doc_id long, text string")).count() == len(few)


@pytest.mark.parametrize("size", [10, 300, 10**6])
def test_many_rows_of_one_id(spark, monkeypatch, size):
    """Null and repeated ids are spread over ranges; every row still meets the next one, ties by hash."""
    monkeypatch.setattr(simhash, "BUCKET_BYTES", size)
    rng = random.Random(size)
    rows = [(rng.choice([None, None, 7, 7, -(2**62), rng.randrange(10**6)]), text_of(rng, rng.randint(1, 20))) for _ in range(150)] + [(None, None), (None, ""), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = simhash.with_next(df)
    assert placed.where("guest = 0").count() == len(rows)
    if size == 10:
        assert placed.where("guest = 0 AND doc_id IS NULL").select("bucket").distinct().count() > 5
    order = [r.text or "" for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = sorted((brute_fingerprint(t), brute_fingerprint(t[: len(t) - len(t) // 3] + after[: len(t) // 3])) for t, after in zip(order, order[1:] + order[:1]))
    got = simhash.fingerprint_edits(df).select("fingerprint", "edited_fingerprint").collect()
    assert sorted(map(tuple, got)) == want


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (40, 2))
    rows = [tuple(map(int, b)) for b in base]
    for b in base:
        for _ in range(6):
            x = b.copy().view(np.uint64)
            for bit in rng.choice(128, rng.integers(0, 7), replace=False):
                x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append(tuple(map(int, x.view(np.int64))))
    rows = sorted(set(rows))
    df = spark.createDataFrame([(lo, hi, 1) for lo, hi in rows], "lo long, hi long, weight long")
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    for radius, blocks in ((3, 5), (4, 6), (0, 1)):
        got = sorted((r.lo, r.hi, r.other_lo, r.other_hi) for r in simhash.neighbours(df, df, radius, blocks).collect())
        assert got == sorted((*a, *b) for a in rows for b in rows if bits(a, b) <= radius)


def test_neighbours_hold_edited_copies(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(250)) for _ in range(40)]
    copies = []
    for t in texts:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        copies.append(" ".join(words))
    fps = simhash.fingerprints(*textkit.text_buffers(pa.array(texts + copies))).view(np.int64).tolist()
    df = spark.createDataFrame([(lo, hi, 1) for lo, hi in fps], "lo long, hi long, weight long").distinct()
    got = {(r.lo, r.hi, r.other_lo, r.other_hi) for r in simhash.neighbours(df, df).collect()}
    assert sum((*a, *b) in got for a, b in zip(fps[:40], fps[40:])) >= 38
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    assert got == {(*a, *b) for a in fps for b in fps if bits(a, b) <= simhash.RADIUS}


def test_held_out_bucket(spark):
    rows = spark.range(50).select("id", textkit.sql_crc_bucket("id", 3).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
