"""Every registered query on a small folder: contract columns, held-out rows, clashing columns, nulls, repeats, empty tables."""

import hashlib
import random
import zlib

import pytest

from spindrift.llm import queries
from tests.llm.test_exact import fold
from tests.llm.test_models import text_of
from tests.llm.test_near import brute
from tests.llm.test_scans import brute_pii, brute_secrets, digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, kept string, fp string, root int, bucket string, key string, h string, v string, p string"
EXTRA = ("s", 1, "k", "f", 2, "b", "k", "h", "v", "p")


def tables(spark, out, rows, labels, pages):
    docs = [(i, t, lang, "src0", len(t or ""), *EXTRA) for i, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y string").coalesce(1).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, host string").coalesce(1).write.parquet(f"{out}/pages.parquet")
    return str(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = [(i, text_of(rng, rng.randint(5, 90), 3 if i % 6 == 0 else 0) if i % 5 else " | ".join(text_of(rng, 30).upper().split()), rng.choice(["en", "fr", "de", "es"])) for i in range(200)]
    out += [(300, "mail a.b@c.de token='abcdefghijkl99' 10.0.0.7 +1 (555) 123-4567", "en"), (301, None, "en"), (302, "", None), (303, "x" * 300_000, "en"), (304, "word " * 60_000, "de")]
    out += [(400 + i, out[i][1].swapcase() if i % 2 else out[i][1], "en") for i in range(9)]
    return out + [(7, out[7][1], "en"), (7, "another text of that id", "fr"), (None, "a text without an id", "en"), (None, "a text without an id", "en"), (None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    labels = [(i, int(i % 5 != 0), int(i % 6 == 0), "z") for i in range(200)] + [(None, 1, 0, "z"), (3, None, None, "z"), (5, 0, 0, "z")]
    page = lambda t: f"<article><h1>t</h1><p>{t}</p></article>"
    pages = [(i, f"http://{'spam' if i % 5 == 0 else 'good'}.example.org/x/{i}", page(rows[i][1])) for i in range(200)] + [(500, None, None), (501, "http://a.example.com/en/1", ""), (502, "nothing", "x"), (500, "http://net/fr/2", None)]
    return tables(spark, tmp_path_factory.mktemp("small"), rows, labels, pages)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def result(spark, name, folder):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def ids(found, key="doc_id"):
    return sorted(str(r[key]) for r in found)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert result(spark, name, empty) == []


@pytest.mark.parametrize("name, mod, rest, least", [("op2_toxicity", 4, 2, 0.3), ("op7_quality", 3, 1, 0.5)])
def test_classifiers(spark, folder, rows, name, mod, rest, least):
    found = result(spark, name, folder)
    assert ids(found) == sorted(str(i) for i, *_ in rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    if name == "op7_quality":
        held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] not in (3, 5, 7)]
        assert sum(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held) > 0.9 * len(held) > 20


def test_labels_of_held_out_rows_do_not_matter(spark, folder, tmp_path):
    """The same scores with the held-out labels turned round, and with other lang, source and ids' order."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs.selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source", "0L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    turned.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_toxicity", "op7_quality"):
        one, two = ({(r["doc_id"], r["score"]) for r in result(spark, name, f)} for f in (folder, str(tmp_path)))
        assert one == two


def test_exact_dedup(spark, folder, rows):
    found = result(spark, "op3_exact_dedup", folder)
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256(fold(t).encode()).hexdigest(), []).append(i)
    assert ids(found) == sorted(str(i) for i, *_ in rows)
    for r in found:
        own = groups[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == max((i for i in own if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)


def test_mixing(spark, folder, rows):
    found = result(spark, "op1_mixing", folder)
    assert ids(found) == sorted(str(i) for i, *_ in rows)
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 and r["wanted_tokens"] > 0 for r in found)


def test_urls(spark, folder):
    found = result(spark, "op4_url_filter", folder)
    assert len(found) == 204 and {r["verdict"] for r in found} <= {"allow", "block"}
    by = {r["page_id"]: r for r in found if r["page_id"] != 500}
    assert by[501]["rule"] == "example.com/en/" and by[501]["verdict"] == "block" and by[502]["host"] == ""
    assert sorted(r["verdict"] for r in found if r["page_id"] == 500) == ["allow", "block"]
    # The mined half: hosts whose pages hold junk.
    assert all(by[i]["verdict"] == ("block" if i % 5 == 0 else "allow") and by[i]["rule"] is None for i in range(200) if i not in (3, 5, 7) and i % 6)


def test_scans(spark, folder, rows):
    for name, brute_spans, kinds in (("op5_secrets", brute_secrets, ("assign", "access", "hex", "entropy")), ("op6_pii", brute_pii, ("email", "ip", "card", "phone", "context"))):
        found = result(spark, name, folder)
        want = sorted((str(i), digest(brute_spans(t or ""), kinds)) for i, t, _ in rows)
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in found) == want
        for r in found:
            assert sum(r[f"n_{k}"] for k in kinds[:-1]) <= len([s for s in r["spans"].split(",") if s])


def test_simhash(spark, folder, rows):
    found = result(spark, "op8_simhash", folder)
    assert ids(found) == sorted(str(i) for i, *_ in rows)
    prints = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 32
        assert (r["n_within"] is None) == (r["doc_id"] is None or r["doc_id"] % 100 != 0)
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[301] == prints[302] == {"0" * 32}
    texts = {i: t for i, t, _ in rows}
    assert all(prints[400 + i] == prints[i] for i in range(9) if i != 7 and texts[i])


def test_packing(spark, folder, rows):
    found = result(spark, "op9_packing", folder)
    assert ids(found) == sorted(str(i) for i, *_ in rows)
    assert sorted(r["n_tokens"] for r in found) == sorted(len((t or "").split()) for _, t, _ in rows) and all(r["bucket_len"] >= r["n_tokens"] for r in found)


def test_near(spark, folder, rows):
    found = result(spark, "op10_simhash_neardup", folder)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["n_near"], r["component_id"]) for r in found) == brute([(i, t) for i, t, _ in rows])
