"""Product codes, the prefix forest and source divergence: the registered queries, brute force, and hard rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import codes, divergence, forest, queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
BAD = [(4, None), (6, [NAN, 1.0]), (7, [INF, 1.0]), (8, [None, 1.0])]
CLASH = "vec_id long, embedding array<double>, label int, v int, code string, error string, ids string, node int, key string, cell int, level int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "e", "i", 2, "k", 3, 4) for r in rows], CLASH)


@pytest.mark.parametrize(("name", "sql", "table"), [("op11_vector_codes", codes.OP11_SQL, "embeddings"), ("op13_source_divergence", divergence.OP13_SQL, "documents")])
def test_sql(spark, name, sql, table):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = c.sql(sql)
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


# --- product codes


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 12), st.integers(1, 9), st.integers(0, 70), st.integers(0, 2**32))
def test_bounds_never_drop_the_nearest(width, entries, bits, seed):
    """Against plain distances, for small numbers with many ties and for numbers beyond 64 bits."""
    rng = np.random.default_rng(seed)
    make = lambda n: np.array([[int(v) << max(0, bits - 30) for v in row] for row in rng.integers(-(2 ** min(bits, 30)), 2 ** min(bits, 30) + 1, (n, width))], dtype=object)
    x, book = make(9), make(entries)
    if bits < 60:
        x, book = x.astype(np.int64), book.astype(np.int64)
    code, d = codes.nearest(x, book)
    for row, k, far in zip(x.tolist(), code, d, strict=True):
        plain = [sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in book.tolist()]
        assert int(far) == min(plain) and k == plain.index(min(plain))


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    book = rng.integers(-3000, 3000, (16, 8))
    x = book[rng.integers(0, 16, 500)] + rng.integers(-200, 200, (500, 8))
    spared = []
    codes.nearest(x, book, spared)
    assert spared[0] > 0.8 * x.shape[0] * 16


def test_integers_are_exact_beyond_doubles_of_integers():
    got = codes.integers(pa.array([[1e300, -0.3], [2.0**60 + 2**10]], type=pa.list_(pa.float64())), 3, 4096)
    assert got.tolist() == [[int(1e300) * 4096, -1229, 0], [(2**60 + 2**10) * 4096, 0, 0]]
    assert sum(v << (32 * k) for k, v in enumerate(codes._limbs(-(10**40)))) == -(10**40)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    ints = [[int(np.floor(4096 * x)) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in order] for p in range(parts)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in ints:
                own[assign(v, p)[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    found = [[assign(v, p) for p in range(parts)] for v in ints]
    total = Counter()
    for (_, _, label), f in zip(rows, found, strict=True):
        total[label] += sum(d for _, d in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k, _ in f), sum(d for _, d in f), total[r[2]], sha) for r, f in zip(rows, found, strict=True)]


def test_codes_of_hard_rows(spark):
    """Null and repeated ids and labels, zero, empty, short, equal and very large vectors; unusable ones are dropped."""
    rng = np.random.default_rng(3)
    good = [(int(i), [float(x) for x in rng.normal(size=11)], int(i) % 3 or None) for i in rng.integers(0, 60, 80)]
    good += [(None, [1.0] * 11, 1), (3, [], 1), (3, [], 1), (5, [0.0] * 11, None), (-7, [1e200, -1e200], 2), (99, [3.0], 2)]
    df = vectors(spark, [*good, *((k, v, 1) for k, v in BAD)]).repartition(5)
    got = codes.vector_codes(df).collect()
    want = [(i, c, min(e, 2**63 - 1), t, s) for i, c, e, t, s in plain_codes(good)]
    top = 2**63 - 1
    error = defaultdict(int)
    for (_, _, label), w in zip(good, want, strict=True):
        error[label] += w[2]
    want = [(*w[:3], min(error[g[2]], top), w[4]) for g, w in zip(good, want, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert codes.vector_codes(df.limit(0)).count() == 0 and codes.vector_codes(vectors(spark, [(1, None, 1)])).count() == 0
    few = codes.vector_codes(vectors(spark, good[:3])).collect()
    assert sorted(map(tuple, few), key=str) == sorted(plain_codes(good[:3]), key=str)


def test_encode_keeps_columns(spark):
    df = vectors(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 4.0], 1)])
    books = codes.learn(df, parts=2, entries=2)
    assert codes.encode(df, books).columns == [c for c in df.columns if c not in ("embedding", "code", "error")] + ["code", "error"]
    assert [r.error for r in codes.encode(df, books).collect()] == [0, 0]
    assert codes.encode(df, []).count() == 0


# --- prefix forest


def recall(df, got, k, mod):
    """Share of the true neighbours found; ranks, scores and their order are checked on the way."""
    rows = [r for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    dims = max(len(r.embedding) for r in rows)
    one = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.embedding)):
        one.setdefault(r.vec_id, np.array([*r.embedding, *[0.0] * (dims - len(r.embedding))]))
    ids, x = np.array(sorted(one)), np.array([one[i] for i in sorted(one)])
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in ids.tolist() if i % mod == 0}
    hit = 0
    for q, found in by.items():
        score = (x * one[q]).sum(axis=1)
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(k, len(ids) - 1) + 1)) and q not in [f[1] for f in found]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(f[2] == score[np.searchsorted(ids, f[1])] for f in found)
        hit += len({f[1] for f in found} & set(ids[[i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]].tolist())) / len(found)
    return hit / len(by)


def test_op12(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert recall(df, queries.QUERIES["op12_prefix_forest"](spark, SF).collect(), 20, 20) >= 0.9


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 64, "block": 32}])
def test_forest_of_clusters_and_copies(spark, sizes):
    """Norms that differ by a factor of ten, close clusters (deep levels), a hot vector under many ids, cut cells."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(60, 24)) * rng.uniform(0.3, 3, (60, 1)), 25, axis=0)
    x += 0.02 * rng.normal(size=x.shape)
    x[200:500] = x[200]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(df, forest.nearest(df, F.col("vec_id") % 20 == 0, k=10, **sizes).collect(), 10, 20) >= 0.9


def test_deep_levels_are_where_plain_counts_say(spark, monkeypatch):
    """The level of every query, from counts within cells and cuts of cells, against counting shared prefixes."""
    monkeypatch.setattr(forest, "KEY_BLOCK", 16)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, (300, 3), dtype=np.uint64)
    keys[:200] &= ~np.uint64((1 << 58) - 1)  # the last bits agree
    keys[150:200] = keys[150]
    stored = spark.createDataFrame([([i], [1.0], [int(v) for v in row.view(np.int64)]) for i, row in enumerate(keys)], "ids array<long>, embedding array<double>, keys array<long>")
    counts = forest.cell_counts(stored, 3, 2)
    assert counts.sum() == 900 and all(counts[t, c] == (keys[:, t] >> np.uint64(62) == c).sum() for t in range(3) for c in range(4))
    asked = spark.createDataFrame([(i, [1.0], [int(v) for v in keys[i].view(np.int64)], 2) for i in range(0, 300, 10)], "node long, embedding array<double>, keys array<long>, level int")
    got = {r.node: r.level for r in forest.deep_levels(stored, asked, spark.sparkContext.broadcast(counts), 3, 2, 40, 16).collect()}
    shared = lambda i, x: sum(int(v) >> (64 - x) == int(keys[i, t]) >> (64 - x) for t in range(3) for v in keys[:, t])
    assert got == {i: max([x for x in range(2, 65) if shared(i, x) >= 40], default=2) for i in range(0, 300, 10)}


def test_forest_of_hard_rows(spark):
    good = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 5.0, 0.0]), (20, [1.0, 0.0, 0.0]), (20, [9.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (5, [-1.0])]
    df = vectors(spark, [(k, v, 1) for k, v in [*good, *BAD, (None, [1.0, 0.0]), (60, [0.0, 0.0, 0.0]), (80, [])]])
    assert recall(df, forest.nearest(df, F.col("vec_id") % 20 == 0).collect(), 20, 20) == 1
    assert forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(df, F.col("vec_id") == 77).count() == 0
    assert forest.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


# --- source divergence


def plain_divergence(rows, min_docs=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        groups = sorted(s for la, s in n if la == lang)
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in groups}, share(sum((n[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            over = [(q[t] - p[s][t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, t, -v, r) for part, found, most in (("pair", pairs, None), ("term", over, top)) for r, (v, t) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"term_block": 3, "team": 2, "teams": 99, "at_once": 2}])
def test_divergence_of_hard_rows(spark, monkeypatch, sizes):
    """Null and empty columns, groups without terms, a language without kept terms, one with a single source, ties,
    non-ASCII terms, a very long text; odd and even numbers of teams, several blocks and several jobs of rounds."""
    monkeypatch.setattr(divergence, "FLUSH", 20)
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "gamma-delta", "Été", "straße7x", "naïve\x7f", "中文", "z", "Z", "x_y"]
    rows = [(lang, f"s{rng.integers(0, n)}", " ".join(rng.choice(words, rng.integers(0, 12)))) for lang, n in (("en", 7), ("de", 4)) for _ in range(60)]
    rows += [(None, None, "alpha"), ("", "", "alpha beta"), ("", None, None), ("en", "silent", "123 !!"), ("en", None, ""), ("fr", "a", "rare words"), ("fr", "b", None), ("it", "only", "z " * 200_000)]
    df = spark.createDataFrame([(k, t, la, s, 1, "t", 2, 3, 4, 5) for k, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, total int, team int, round int, value int")
    got = divergence.source_divergence(df.repartition(3), min_docs=2, **sizes).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows, 2)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_every_pair_of_teams_meets_once():
    for teams in (2, 4, 6, 10, 16):
        met = Counter()
        for r in range(teams - 1):
            for t in range(teams):
                o = divergence.partner(t, r, teams)
                assert o != t and divergence.partner(o, r, teams) == t
                met[frozenset((t, o))] += 1
        assert len(met) == teams * (teams - 1) // 2 and set(met.values()) == {2}


def test_shares_are_exact():
    n, total, kept = 7_999_999_999_999, 8_000_000_000_000_000, 10**8
    assert int(divergence.shares(n, total, kept)) == 1 + 10**9 * (n + 5) // (total + 5 * kept)
    assert divergence.shares(np.array([total]), total, 0).tolist() == [1 + 10**9 * (total + 5) // total]


# --- pieces: the memo's bound


@pytest.mark.parametrize("most", [0, 5, 400])
def test_memo_is_bounded_inside_a_batch(monkeypatch, most):
    from tessera.llm import pieces, tokens

    texts = [f"some words {k} and others {k % 7}, repeated words and words" for k in range(40)]
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    want = pieces.PieceCodec(path, 0.3).encode_many(texts, list(range(40)))
    monkeypatch.setattr(pieces, "MEMO_AGENDAS", most // 2)
    monkeypatch.setattr(pieces, "MEMO_MOST", most)
    codec = pieces.PieceCodec(path, 0.3)
    assert [x for at in range(0, 40, 8) for x in codec.encode_many(texts[at : at + 8], list(range(at, at + 8)))] == want
    assert len(codec.node_ids) <= most


# --- exact top-k: bounds


@pytest.mark.parametrize(("make", "least"), [("random", 0.05), ("clusters", 0.25), ("decaying", 0.5), ("norms", 0.25)])
def test_bounds_strike_candidates(make, least):
    """Products saved of all, and results as by plain scores, on random, clustered and uneven vectors."""
    from tessera.llm import topk

    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(9000, 64)))
    if make == "clusters":
        x = unit(unit(rng.normal(size=(150, 64)))[rng.integers(0, 150, 9000)] + 0.05 * rng.normal(size=(9000, 64)))
    x = {"decaying": x * 0.9 ** np.arange(64), "norms": x * rng.uniform(0.1, 3, (9000, 1))}.get(make, x)
    v, ids, struck = np.floor(256 * x), rng.permutation(9000), []
    a, b, s = topk.block_topk(ids[:64], v[:64].T.copy(), ids, v.T.copy(), 5, struck=struck)
    scores = v[:64] @ v.T
    scores[np.arange(64), np.arange(64)] = -np.inf
    want = [(int(ids[i]), int(ids[j]), int(scores[i, j])) for i in range(64) for j in np.lexsort((ids, -scores[i]))[:5]]
    assert sorted(zip(a.tolist(), b.tolist(), s, strict=True)) == sorted(want)
    assert sum(struck) >= least * 64 * 9000 * 64


# --- token files: several a task


def test_token_files_roll_over(spark):
    """Files end at a number of documents or of ids; what is read back is the same as from one file a task."""
    from tessera.llm import token_files
    from tessera.llm.util import fresh_path

    docs = spark.createDataFrame([(k // 2, None if k % 11 == 0 else f"some words {k} " * (k % 5)) for k in range(200)], "doc_id long, text string").repartition(3)

    def rows(**bounds):
        manifest = token_files.write_token_files(docs, "word_bpe_49k.json", fresh_path(spark, "rolled"), **bounds)
        files = manifest.orderBy("shard").collect()
        return files, [tuple(r) for r in token_files.read_token_files(manifest).orderBy("start", "n_tokens").collect()]

    whole = rows()
    assert all(f.start == sum(g.n_tokens for g in whole[0][:k]) for k, f in enumerate(whole[0]))
    for bounds in ({"file_docs": 7}, {"file_ids": 40}):
        files, got = rows(**bounds)
        assert got == whole[1] and len(files) > len(whole[0]) and sum(f.n_docs for f in files) == 200
        assert all(f.n_docs <= 7 for f in files) if "file_docs" in bounds else all(f.n_tokens < 40 + 40 for f in files)
