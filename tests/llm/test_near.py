import random
import re
from collections import Counter

import pytest
import xxhash

from spindrift.llm import golay, shared

FIXTURE_WORDS = "of the and to in is that for on with as by this be are from or at it was".split()


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and bin(fps[i] ^ fps[j]).count("1") <= 4] for i in range(n)]
    root = {}
    for i in range(n):
        if i not in root:
            todo, group = [i], set()
            while todo:
                k = todo.pop()
                if k not in group:
                    group.add(k)
                    todo += near[k]
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                root[k] = least
    return sorted((str(rows[i][0]), f"{fps[i]:016x}", len(near[i]), root[i]) for i in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one two THREE"), (905, "É é  x\x0by")]
    base = [" ".join(rng.choice(FIXTURE_WORDS) + rng.choice("abcd") for _ in range(rng.randint(1, 400))) for _ in range(25)]
    for i, text in enumerate(base):
        rows.append((i, text))
        for k in range(rng.randint(0, 6)):
            words = text.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "edit"
            rows.append((100 + 10 * i + k, " ".join(words).upper() if k % 2 else " ".join(words)))
    rows += [(7, rows[10][1]), (None, rows[12][1]), (None, rows[12][1]), (903, "One")]
    rows.append((999, "word " * 30000))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "'x' AS component_id", "2 AS root")
    fps = golay.fingerprint_column(df, ["doc_id"])
    out = golay.joined(fps, golay.classes(fps))
    return sorted((str(r.doc_id), f"{r.fp % 2**64:016x}", r.n_near, r.component_id) for r in out.collect())


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_heavy_keys_in_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(golay, "BLOCK", 2)
    if hot:
        monkeypatch.setattr(golay.shared, "hot_keys", lambda c, k, n, share=0: [r[0] for r in c.where(f"{n} > 1").select(k).collect()])
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 3)], "a long, b long")
    assert {(r.v, r.root) for r in golay.components(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100), (103, 100)}


def test_code_is_perfect_and_keys_find_all_close_pairs():
    import numpy as np

    lead, extra = golay.golay_tables()
    assert (lead >= 0).all()
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 3000)
    other = fp.view(np.uint64).copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    filed = golay.filed_keys(fp, lead)
    row, key = golay.sought_keys(other.view(np.int64), lead, extra)
    hit = np.zeros(len(fp), bool)
    hit[row[(filed[row] == key[:, None]).any(1)]] = True
    assert hit.all()


def brute_wide(text):
    """The wide fingerprint, one word and one bit at a time."""
    mask, prime = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * mult) & mask
        return x ^ (x >> 33)

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode()
    counts = Counter(re.findall(rb"[^\x20\x09-\x0D]+", text))
    out = 0
    hashed = {w: mix(sum((b + 1) * pow(prime, k, 1 << 64) for k, b in enumerate(w)) & mask) for w in counts}
    weight = {w: min(15, round(4 * n**0.5)) for w, n in counts.items()}
    for k in range(golay.WIDE):
        h = {w: mix((hashed[w] + k * prime) & mask) for w in counts}
        for b in range(64):
            out |= (sum(weight[w] for w in counts if h[w] >> b & 1) * 2 > sum(weight.values())) << (64 * k + b)
    return out


def brute_classes(texts, radius=None):
    """Smallest position of the class of every text, by all pairs."""
    fps = [brute_wide(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= (golay.WIDE_RADIUS if radius is None else radius) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = "".join(rng.choice("abcdefghij") for _ in range(6))
    return " ".join(words)


def prose(rng, n):
    return [rng.choice(FIXTURE_WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7))) for _ in range(n)]


@pytest.mark.parametrize("hot", [False, True])
def test_stage_against_all_pairs(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(golay.shared, "hot_keys", lambda c, k, n, share=0: [r[0] for r in c.where(f"{n} > 1 AND {k} IS NOT NULL").select(k).limit(500).collect()])
    rng = random.Random(21)
    texts = [None, "", " ", "one", "ONE", "two words", "x" * 200_000, "word " * 30000, "WORD " * 29000]
    for _ in range(30):
        words = prose(rng, rng.randint(20, 250))
        texts += [" ".join(words)] + [edited(rng, words, max(1, len(words) * 6 // 100)) for _ in range(rng.choice([0, 1, 4]))]
    shared_part = prose(rng, 60)  # a passage of many documents does not make them copies
    texts += [" ".join([*prose(rng, 70), *shared_part, *prose(rng, 70)]) for _ in range(12)]
    root = brute_classes(texts)
    ids = [1000 - k for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, v string")
    got = {r.doc_id for r in golay.filter_neardup(spark, df, "").collect()}
    assert got == {min(i for i, r in zip(ids, root) if r == k) for k in set(root)}
    assert golay.filter_neardup(spark, df.limit(0), "").collect() == []


def test_stage_recall(spark):
    """Copies with 4 to 10 % of their words changed; a dense family; unrelated texts stay."""
    rng = random.Random(22)
    rows, copies = [], 0
    for k in range(150):
        words = prose(rng, rng.randint(40, 300))
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, edited(rng, words, max(1, int(len(words) * rng.uniform(0.04, 0.1))))))
    family = prose(rng, 200)
    rows += [(2000 + k, edited(rng, family, 6)) for k in range(300)]
    kept = {r.doc_id for r in golay.filter_neardup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert set(range(150)) <= kept and sum(1000 + k in kept for k in range(150)) <= 15
    assert sum(i >= 2000 for i in kept) <= 2


def spread(rng, wide, n, bits=range(512)):
    """The fingerprint with ``n`` of its bits changed."""
    for b in rng.sample(list(bits), n):
        wide ^= 1 << b
    return wide


@pytest.mark.parametrize("tile", [4096, 7])
def test_wide_classes_lose_no_link(spark, monkeypatch, tile):
    """Pairs at the very radius, spread over all bits, in one word or in half of them; one bit more is no link; a chain; a dense family."""
    monkeypatch.setattr(golay, "TILE", tile, raising=False)
    rng = random.Random(31)
    prints = []
    for n, bits in [(96, range(512)), (97, range(512))] * 12 + [(64, range(64)), (30, range(64)), (96, range(256)), (97, range(256)), (96, range(256, 512))]:
        prints += [x := rng.getrandbits(512), spread(rng, x, n, bits)]
    for _ in range(12):
        prints.append(spread(rng, prints[-1], 90))
    family = rng.getrandbits(512)
    prints += [spread(rng, family, 40) for _ in range(40)] + [family ^ ((1 << 512) - 1)]
    rng.shuffle(prints)
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 96 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    words = [[(x >> 64 * k & (1 << 64) - 1) - (x >> 64 * k + 63 & 1) * (1 << 64) for k in range(8)] for x in prints]
    names = ["v", *[f"w{k}" for k in range(8)], "m0", "m1", "m2"]
    vertices = spark.createDataFrame([(v, *w, 0, 0, 0) for v, w in enumerate(words)], ", ".join(f"{c} long" for c in names))
    assert {(r.v, r.root) for r in golay.wide_classes(vertices).collect()} == set(enumerate(root))


def test_tasks_run_one_python_function_each(spark, monkeypatch):
    """Two in a row would keep twice as many Python workers on an executor."""
    plans, materialize = [], shared.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)

    monkeypatch.setattr(shared, "materialize", noted)
    monkeypatch.setattr(golay, "TILE", 7)
    vertices = spark.range(40).selectExpr("id AS v", *[f"xxhash64(id DIV 2, {k}) AS w{k}" for k in range(8)])
    assert {(r.v, r.root) for r in golay.wide_classes(vertices).collect()} == {(i, i - i % 2) for i in range(40)}
    assert any("CartesianProduct" in p for p in plans)
    assert [p for p in plans if p.count("MapInArrow") > 1] == []


def test_stage_joins_heavily_edited_copies_as_all_pairs_do(spark):
    """Copies near the radius, with some 15 % of their words changed."""
    rng = random.Random(32)
    texts = []
    for _ in range(60):
        words = prose(rng, rng.randint(60, 160))
        texts += [" ".join(words), edited(rng, words, len(words) * 15 // 100)]
    root = brute_classes(texts)
    assert len(set(root)) < 100
    kept = {r.doc_id for r in golay.filter_neardup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    assert kept == set(root)


def test_filter_keeps_unrelated_rows_with_null_or_repeated_ids(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(FIXTURE_WORDS) + rng.choice("abcdefgh") for _ in range(80)) for _ in range(12)]
    ids = [None] * 4 + [7] * 4 + [20, 21, 22, 7]
    rows = list(zip(ids, texts))
    rows += [(None, texts[0]), (None, texts[0]), (7, texts[4]), (30, texts[8]), (3, texts[5]), (None, texts[6]), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, root int")
    got = golay.filter_neardup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted((r.text or "", str(r.doc_id)) for r in got.collect())
    want = {t: i for i, t in zip(ids, texts)} | {texts[5]: 3, "": 7}
    assert kept == sorted((t, str(i)) for t, i in want.items())
