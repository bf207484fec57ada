"""Stages and operators do the whole of their job, not an estimate or a cut of it."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from tessera.llm import mixing, simhash
from test_brute_force import classes


def test_written_words_come_near_the_targets(spark):
    """Whole documents as the stage writes them, with a hot source of a third of the rows."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(50, 400))), "s00" if i % 3 == 0 else f"s{1 + i % 19:02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    target = {source[r.doc_id]: r.target for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r.source] += len(r.text.split())
    assert min(target.values()) > 1000
    for s, t in target.items():
        assert abs(words[s] - t) <= 400 * 2, (s, words[s], t)


def test_documents_fill_the_quota():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(0, 60, rng.integers(1, 40))
        quota = int(rng.integers(0, 3 * sizes.sum() + 1))
        got = mixing.take_documents(sizes, quota)
        assert abs(int((got * sizes).sum()) - quota) <= sizes.max() / 2 and got.max() <= 3 and got.min() >= 0


def test_links_are_exact_similarities(spark):
    """Components against brute force over shingle sets, with pairs on both sides of 0.8, repeats and a large chain."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for n in [4, 5, 8, 12, 20, 60, 200] * 12:
        base = [word() for _ in range(n + 4)]
        texts.append(base)
        for share in (0.03, 0.05, 0.1, 0.2):
            texts.append([*base[: len(base) - int(share * n)], *(word() for _ in range(int(share * n)))])
        texts.append(base[: len(base) - n // 5])
        texts.append([*base, *base[:n] * 6])
    chain = [word() for _ in range(160)]
    texts += [chain[k : k + 90] for k in range(70)]
    texts += [[*chain[:80], word()] for _ in range(80)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert got == {k: find(k) for k in range(len(rows))}
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(got.values()))


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Candidate components beyond the whole ones: near copies of a hub, others that reach it over several steps only,
    and some that the candidates join but no link does."""
    monkeypatch.setattr(simhash, "WHOLE_COMPONENT", 12)
    monkeypatch.setattr(simhash, "REST_BLOCK", 5)
    monkeypatch.setattr(simhash, "ALL_BLOCK", 16)
    monkeypatch.setattr(simhash, "CANDIDATE_SLACK", 70)
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    chain = [word() for _ in range(400)]
    texts = [[*chain[:90], word()] for _ in range(40)] + [chain[3 * k : 3 * k + 90] for k in range(60)] + [[*chain[:60], *(word() for _ in range(30))] for _ in range(20)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert got == {k: find(k) for k in range(len(rows))}


def test_partitions_and_bands_share_the_candidates(spark, monkeypatch):
    """Partitions find what lies within their distance and bands the rest: the classes are those of exact similarity
    however far the partitions are made to reach, and each finds links of its own."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for changes in (0, 1, 2, 3):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])
    far = [int.bit_count(simhash.vote(np.array(sorted(sets[i]), dtype=np.uint64)) ^ simhash.vote(np.array(sorted(sets[j]), dtype=np.uint64))) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert any(f <= 4 for f in far) and any(f > 4 for f in far)
    for work in (0.0, 1e9):
        monkeypatch.setattr(simhash.affordable, "__defaults__", (work, 4, 8))
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
        assert [got[k] for k in range(len(texts))] == want
