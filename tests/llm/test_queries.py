"""Every registered query of this subpackage against SQL or a plain restatement, over the whole smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tessera.llm import lattice, licenses, mixing, pieces, quality, queries, simhash, tokens, topk
from test_brute_force import classes, naive_fingerprint, plain_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def rows(spark, name, key="doc_id"):
    return sorted(queries.QUERIES[name](spark, SF).collect(), key=lambda r: r[key])


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_op1(spark, docs):
    fps = [naive_fingerprint(r.text or "") for r in docs]
    root = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op1_simhash")] == [(d.doc_id, f"{f:016x}", docs[k].doc_id) for d, f, k in zip(docs, fps, root, strict=True)]


def test_op3(spark, docs):
    codec = pieces.PieceCodec(tokens.tokenizer_path("piece_bpe_32k.model"), pieces.DROPOUT)
    for r, d in zip(rows(spark, "op3_pieces"), docs, strict=True):
        ids = np.array(plain_pieces(codec, d.text or "", d.doc_id), dtype="<u4")
        assert (r.doc_id, r.n_pieces, r.ids_crc32, r.text_crc32, r.lossless) == (d.doc_id, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32((d.text or "").encode()), True)


@pytest.mark.parametrize(("name", "sql"), [("op4_lattice", lattice.OP4_SQL), ("op10_exact_topk", topk.OP10_SQL)])
def test_sql(spark, name, sql):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = c.sql(sql)
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op5(spark, docs):
    """Targets by the contract; taken by dealing seats one by one and words one by one."""
    size = {d.doc_id: len(re.findall("[^\x20\x09-\x0d]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    total = Counter()
    for k, s in source.items():
        total[s] += size[k]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            open_.discard(s)
    target |= share
    got = {r.doc_id: r for r in rows(spark, "op5_mixing")}
    assert len(got) == len(docs)
    taken = Counter()
    for k, r in got.items():
        assert (r["size"], r.source_size) == (size[k], total[source[k]]) and abs(r.target - target[source[k]]) < 1e-6 and 0 <= r.taken <= 3 * size[k]
        taken[source[k]] += r.taken
    seats = dict.fromkeys(names, 0)
    for _ in range(int(sum(target.values()) / 32 + 0.5)):
        seats[max(names, key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    assert {s: taken[s] for s in names} == {s: min(32 * seats[s], 3 * total[s]) for s in names}
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, rows(spark, "op5_mixing")))


def test_op6(spark, docs):
    """Exact notices: a plain search for the words of every template; a longer notice hides those inside it."""
    known = licenses.LicenseScanner().templates
    want = set()
    for d in docs:
        w = licenses.wording(d.text or "")
        found = [(i, i + len(t), name) for name, t in known for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]
        want |= {(d.doc_id, a, b - a, name) for a, b, name in found if not any((x, y) != (a, b) and x <= a and b <= y for x, y, _ in found)}
    got = {(r.doc_id, r.first_word, r.words, r.license) for r in rows(spark, "op6_licenses") if r.exact}
    assert got == want and want


def test_op7(spark, docs):
    lib = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json")).lib
    for r, d in zip(rows(spark, "op7_token_counts"), docs, strict=True):
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        assert tuple(r) == (d.doc_id, len((d.text or "").encode()), n, n > 1024)


def test_op9(spark, docs):
    """The labels learnt from are those not held out, and a score is the sum of one entry a table."""
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    text = {d.doc_id: d.text for d in docs}
    ids = sorted(k for k, y in label.items() if y in (0, 1) and k in text and crc(k, 4) != 2)
    model = quality.fit(np.array([quality.features(text[k]) for k in ids]), np.array([label[k] for k in ids], dtype=float))
    for r, d in zip(rows(spark, "op9_quality"), docs, strict=True):
        x = quality.features(d.text)
        place = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        z = model.intercept + sum(t[p] for t, p in zip(model.tables, place, strict=True)) + sum(t[place[i], place[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        want = 1 / (1 + np.exp(-z))
        assert (r.doc_id, r.held_out, r.predicted) == (d.doc_id, crc(d.doc_id, 4) == 2, int(r.score >= 0.7)) and abs(r.score - want) < 1e-9


def test_every_pair_of_a_probe_heavy_bucket_meets_once(spark):
    """A bucket of few homes and many probes, one of many homes, and one of probes only, dealt as blocks."""
    import pyarrow as pa

    data = [(1, 0, k) for k in range(7)] + [(1, 1, 100 + k) for k in range(300)] + [(2, 0, k) for k in range(130)] + [(3, 1, k) for k in range(90)] + [(4, 0, 1), (4, 1, 2)]
    df = spark.createDataFrame(data, "key long, side byte, node long")
    got = simhash.with_blocks(df, df, 40).orderBy("key", "sub", "side").collect()
    load = Counter((r.key, r["sub"]) for r in got)
    assert max(load.values()) <= 160
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in got[k : k + 33]], schema=pa.schema([("key", pa.int64()), ("node", pa.int64()), ("sub", pa.int64()), ("side", pa.int8())])) for k in range(0, len(got), 33)]
    met = Counter()
    for g in simhash.sorted_groups(batches, ["key", "sub"], ["side", "node"]):
        for i, j in simhash.group_pairs(g, 50):
            met.update((int(g["key"][a]), *sorted((int(g["node"][a]), int(g["node"][b])))) for a, b in zip(i, j, strict=True))
    want = defaultdict(int)
    for key in (1, 2, 4):
        home, probe = ([n for k, s, n in data if k == key and s == side] for side in (0, 1))
        want |= {(key, *sorted((a, b))): 1 for x, a in enumerate(home) for b in [*home[x + 1 :], *probe]}
    assert met == want


def test_estimate_knows_correlated_bits():
    """Copies of one bit differ together: the estimate of few differing bits follows the sample, not independence."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (4000, 64)).astype(float)
    x[:, 8:16] = x[:, :1]
    both = x.T @ x
    bits = list(range(8, 24))
    d = np.abs(x[:2000, bits] - x[2000:, bits]).sum(axis=1)
    got = np.cumsum(simhash.differing(4000, both, bits))
    assert all(abs(got[k] - (d <= k).mean()) < 0.04 for k in range(17)) and abs(got[-1] - 1) < 1e-9


def test_word_bytes_are_the_words_of_the_contract():
    text = "A\x1cB\x85c \xa0 É\tz\x0bq\x0c\r\n K İ"
    want = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    assert [w.decode() for w in simhash.word_bytes(text.encode())] == want
    assert xxhash.xxh64_intdigest("a b c d".encode(), 42) == int(simhash.shingle_hashes("A b\nc d", 4)[0])
    assert mixing.take_documents(np.array([3, 0, 5]), 8).tolist() == [1, 0, 1]
