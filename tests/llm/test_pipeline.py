"""The pipeline, stage by stage, against plain restatements on the smallest tables."""

import numpy as np
import corpus_pipeline
from tessera.llm import mixing, pieces, quality, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.orderBy("doc_id").collect()
    s = model.score(np.array([quality.features(r.text) for r in rows]))
    kept = [r for r, x in zip(rows, s, strict=True) if x >= 0.7]
    assert 0 < len(kept) < len(rows)
    got = corpus_pipeline.quality_filter(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in kept]

    sets = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in kept]
    root = list(range(len(kept)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    one = [r for i, r in enumerate(kept) if root[i] == i]
    frame = spark.createDataFrame(kept, docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()) == [r.doc_id for r in one]

    frame = spark.createDataFrame(one, docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    mixed = corpus_pipeline.mix_sources(spark, frame, SF)
    want = sorted(k for k, n in copies.items() for _ in range(n))
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == want

    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == want
    codec = pieces.PieceCodec(tokens.tokenizer_path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in one}
    assert all(codec.decode(r.piece_ids) == text[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in out)


HARD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "quite another text under an id in use", "en", "b"),
    (2, None, None, None), (3, "", "en", "a"), (None, "no id here at all but some words", "en", "b"), (None, "no id here at all but some words", "en", "b"), (4, "alpha beta gamma delta epsilon zeta", "en", "b"),
    (5, "lorem ipsum dolor sit amet " * 8000, "en", "a"), (6, "x", "de", None), (7, " \t\n ", "en", "c"),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, kept_id string, mix_id string, mix_copies string, mix_copy string, n_pieces string, piece_ids string, fp string, size string, tags map<string,int>"


def test_stages_on_hard_rows(spark):
    """Nulls, repeats, long and empty texts and columns named like the stages' own."""
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f", "g", "h", {"k": 1}) for r in HARD], NAMES)
    filtered = corpus_pipeline.quality_filter(spark, docs, SF)
    assert filtered.columns == docs.columns
    once = corpus_pipeline.near_dedup(spark, docs, SF)
    assert once.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect())
    assert [k for n, k in ids if not n] == [1, 2, 5, 6] and sum(n for n, _ in ids) == 2
    assert sorted(map(str, once.collect())) == sorted(map(str, corpus_pipeline.near_dedup(spark, docs.repartition(3), SF).collect()))
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.text_hash, r.source] = taken.get((r.doc_id, r.text_hash, r.source), 0) + r.copies
    assert mixed.count() == sum(taken.values()) > 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(3), SF).collect()))
    encoded = corpus_pipeline.encode_pieces(spark, docs, SF)
    assert sorted(encoded.columns) == sorted(c for c in docs.columns if c != "text") and encoded.count() == len(HARD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_go_and_others_stay(spark):
    """Copies with a few words changed are dropped; documents with nothing in common are kept."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(240)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        copy = list(b)
        for at in rng.choice(240, 3, replace=False):
            copy[at] = word()
        rows.append((100 + i, " ".join(copy)))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
