"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import katz, lattice, licenses, mixing, pieces, quality, simhash, token_counts, token_files, topk
from tessera.llm.util import fresh_path

LONG = "lorem ipsum dolor " * 20_000
CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, node string, size string, row string, bucket string, score string, n_tokens string, seq string"
ROWS = [
    (1, "alpha beta gamma delta epsilon", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here at all", "en", "b"),
    (4, "alpha beta gamma delta epsilon", "en", "b"), (5, LONG, "en", "a"), (6, "x", "de", None), (1, "alpha beta gamma delta epsilon", "en", "a"), (7, "  \t\n ", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 1, "k", "n", "z", "r", "b", "s", "t", "q") for r in ROWS], CLASH)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(simhash.near_duplicates(docs))
    assert got[1].component_id == got[4].component_id == 1
    assert got[2].fp == got[3].fp == got[7].fp == 0 and got[7].component_id == 2
    assert got[None].component_id is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({g.component_id for k, g in got.items() if k})
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_token_files(spark, docs):
    rows = token_files.read_token_files(token_files.write_token_files(docs, "word_bpe_49k.json", fresh_path(spark, "t"))).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), "word_bpe_49k.json", fresh_path(spark, "t"))).count() == 0


def test_pieces(spark, docs):
    assert all(r.lossless for r in pieces.piece_digest(docs).collect())
    got = pieces.encode_pieces(docs)
    assert got.columns == [*docs.columns, "piece_ids"] and got.count() == len(ROWS)
    back = pieces.decode_pieces(got).collect()
    assert all((r.decoded or "") == (r.text or "") for r in back)
    assert pieces.piece_digest(empty(spark)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame([(*x, 1, "k") for x in v], "vec_id long, embedding array<double>, node int, key string")
    rows = lattice.near_vectors(df).collect()
    assert len(rows) == len(v)
    got = {r.vec_id: r for r in rows}
    assert got[1].n_links == 3 and got[2].n_links == 3 and got[3].n_links == 3
    assert {got[k].component_id for k in (1, 2, 3)} == {1} and got[3].kept is False and got[9].n_links == 0
    for k in (4, 5, 6, 7, 8):
        assert got[k].n_links == 0 and got[k].component_id == k and got[k].kept
    assert got[None].component_id is None and not got[None].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(none).count() == 0
    top = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 2, 131072), (2, 3, 256 * 256 + 256 * 25), (3, 1, 65536), (4, 1, 65536), (5, 9, 65536)]
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    total = sum(r["size"] for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) <= total + 1e-6
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert [tuple(r) for r in sorted(rows, key=str)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(3)).collect(), key=str)]
    assert mixing.mix(empty(spark)).count() == 0


def test_licenses(spark, docs):
    assert licenses.license_scan(docs).count() == 0
    hit = spark.createDataFrame([(None, "Released under the MIT License."), (2, "foo. Licensed under CC BY-NC 4.0. Released under the MIT License. bar"), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.license, r.exact) for r in licenses.license_scan(hit).collect()) == [("2", "CC-BY-NC-4.0", True), ("2", "MIT", True), ("None", "MIT", True)]
    assert licenses.license_scan(empty(spark)).count() == 0


def test_token_counts(spark, docs):
    path = fresh_path(spark, "cache")
    rows = token_counts.token_counts(docs, "byte_bpe_50k.json", path).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].n_bytes == 0 and got[5].over_limit and got[None].n_tokens > 0
    stored = spark.read.parquet(path).count()
    again = token_counts.token_counts(docs, "byte_bpe_50k.json", path)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows)) and spark.read.parquet(path).count() == stored
    assert token_counts.token_counts(empty(spark), "byte_bpe_50k.json", fresh_path(spark, "cache")).count() == 0
    same, path = spark.createDataFrame([(7, "one text")] * 50 + [(None, "one text")] * 5 + [(7, f"text {k}") for k in range(20)], "doc_id long, text string"), fresh_path(spark, "cache")
    assert token_counts.token_counts(same, "byte_bpe_50k.json", path).count() == 75
    assert spark.read.parquet(path).count() == 21


def test_katz(spark, docs):
    rows = katz.score_texts(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[2].n_tokens == got[3].n_tokens == 1 and got[2].score == got[3].score and got[None].held_out is False
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert katz.score_texts(empty(spark)).count() == 0
    alone = spark.createDataFrame([(k, "a b") for k in range(40)], "doc_id long, text string")
    held = katz.score_texts(alone.where(quality.held_out("doc_id", 7, 2)))
    assert all(r.score == 0 and r.train_tokens == 0 for r in held.collect())


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (99, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3)} == {r.score for r in rows if r.doc_id == 3}
    assert quality.accept(docs, model).columns == docs.columns
    assert quality.score(empty(spark), model).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in quality.score(docs, blank).collect())


def test_quality_bound_holds_for_pairs(spark, monkeypatch):
    """Ids of many documents and labels without a document do not exceed or use up the bound."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, quality int")
    quality.train(docs, labels, max_train=10)
    quality.train(docs, labels, max_train=1000)
    usable = [k for k in range(5) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert seen == [10, 100 * len(usable)]


def test_license_scan_with_a_complete_license_text(spark):
    """A template of 1500 words, whole, with two words changed, and once more behind 40,000 other words."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]
    changed = [*words[:700], "otherwise", *words[701:1200], *words[1201:]]
    other = ["".join(rng.choice("vwxyz") for _ in range(5)) for _ in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "head " + " ".join(changed)), (3, " ".join(other + words)), (4, " ".join(other)), (5, None)], "doc_id long, text string")
    templates = [*licenses.TEMPLATES, ("Own-1.0", " ".join(words))]
    got = {r.doc_id: r for r in licenses.license_scan(docs, templates=templates, tags=[]).collect()}
    assert got.keys() == {1, 2, 3} and {r.license for r in got.values()} == {"Own-1.0"}
    assert got[1].exact and got[3].exact and got[3].first_word == 40_000 and got[1].words == 1500
    assert not got[2].exact and got[2].first_word == 1 and got[2].missing.split() == [words[700], words[1200]] and got[2].extra == "otherwise"
    assert licenses.license_scan(docs).count() == 0
