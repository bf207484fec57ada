"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits are put into partitions so that correlated bits share one. For a distance tau the partition
thresholds may be any integers >= -1 that sum to tau - m + 1: two fingerprints within tau agree to within its
threshold in at least one partition. A dynamic program picks the thresholds (and the number of partitions)
that minimise the estimated work; partitions are then probed and every candidate pair is verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, group_runs, local_roots
from .mixing import _mixed
from .util import as_bytes, materialize, row_hash, unused, word_bytes

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Work of one shuffled probe row and of one verified candidate pair, in microseconds.
PROBE_COST, PAIR_COST = 3.0, 0.02
#: A bucket with more rows than this is dealt as pairs of blocks of about this size.
BLOCK_ROWS = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SUB = 1 << 24
#: For links by similarity: pairs whose fingerprints differ in at most as many bits as partitions can find for
#: PARTITION_WORK microseconds a fingerprint, and pairs beyond that meet in one of BANDS bands of BAND_ROWS minima of the
#: shingle set, are candidates if their fingerprint and SKETCHES further ones together differ in at most CANDIDATE_SLACK
#: bits more than the similarity gives on average; they link if their exact Jaccard similarity is reached.
PARTITION_WORK = 60.0
SKETCHES, BANDS, BAND_ROWS, CANDIDATE_SLACK = 3, 32, 5, 38
#: A candidate component with more nodes than this is compared with its hub first; blocks of its further comparisons.
WHOLE_COMPONENT, REST_BLOCK, ALL_BLOCK = 64, 64, 256


def shingle_hashes(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; the whole sequence if it is shorter than a shingle."""
    words = word_bytes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    end = list(itertools.accumulate(map(len, words)))
    first = itertools.accumulate(map(len, words), initial=0)
    # word k starts behind k spaces, and the shingle from it ends with word k + shingle - 1
    return np.fromiter((digest(joined[a + k : b + k + shingle - 1], seed) for k, (a, b) in enumerate(zip(first, end[shingle - 1 :], strict=False))), dtype=np.uint64, count=len(words) - shingle + 1)


def vote(h: np.ndarray) -> int:
    """64-bit SimHash: bit b is set when it is set in over half of the hashes; no hashes give 0."""
    n = len(h)
    grid = np.ascontiguousarray(h).view(np.uint8).reshape(n, 8)
    if n < 256:
        ones = np.unpackbits(grid, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(grid[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return vote(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, sketches: int = 0) -> DataFrame:
    """``doc_id, fp`` (fp: the 64 bits as a signed long), one row per row of ``docs``; null texts are empty.
    ``sketches`` further fingerprints s0, s1, ... come from the same hashes, mixed anew."""
    names = ["fp", *(f"s{k}" for k in range(sketches))]

    def run(it):
        for b in it:
            got = np.zeros((b.num_rows, 1 + sketches), dtype=np.uint64)
            for i, t in enumerate(as_bytes(b.column(1))):
                h = shingle_hashes(t.as_py(), shingle, seed)
                got[i, 0] = vote(h)
                for k in range(sketches):
                    got[i, 1 + k] = vote(_mixed(h ^ np.uint64(k + 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in range(1 + sketches))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))


def _odd(n: int) -> np.ndarray:
    return _mixed(np.arange(n, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)


def set_sketches(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, fp, s0.., set_id, bands`` of the distinct shingles of every row: votes without weights, the XXH64 of
    the sorted set, and one key a band (the mixed minima of ``band_rows`` multiplicative permutations)."""
    names = ["fp", *(f"s{k}" for k in range(SKETCHES)), "set_id"]
    factors = _odd(bands * band_rows)[:, None]

    def keys(h: np.ndarray) -> np.ndarray:
        low = np.full(bands * band_rows, 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(h), 512):
            with np.errstate(over="ignore"):
                np.minimum(low, (factors * h[None, at : at + 512]).min(axis=1), out=low)
        out = np.arange(bands, dtype=np.uint64)
        for column in low.reshape(bands, band_rows).T:
            out = _mixed(out ^ column)
        return out

    def run(it):
        for b in it:
            got = np.zeros((b.num_rows, len(names)), dtype=np.uint64)
            band = np.zeros((b.num_rows, bands), dtype=np.uint64)
            for i, t in enumerate(as_bytes(b.column(1))):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                got[i, 0] = vote(h)
                for k in range(SKETCHES):
                    got[i, 1 + k] = vote(_mixed(h ^ np.uint64(k + 1)))
                got[i, -1] = xxhash.xxh64_intdigest(h.tobytes())
                band[i] = keys(h)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * bands
            columns = [pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel().view(np.int64)))], ["doc_id", *names, "bands"])

    schema = "".join(f"{c} long, " for c in ["doc_id", *names])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema + "bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach a Jaccard similarity; empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def linked_in(sets: list[np.ndarray], bits: np.ndarray, block: np.ndarray, similarity: float, most: int, cross: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that reach ``similarity`` (of different blocks, with ``cross``), by exact
    comparison of all pairs within ``most`` differing bits that the forest does not link yet; nearest first."""
    size = np.array([len(x) for x in sets])
    root, links = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    i, j = np.triu_indices(len(sets), 1)
    keep = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    if cross:
        keep &= block[i] != block[j]
    i, j = i[keep], j[keep]
    far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    for k in order[: np.searchsorted(far[order], most, side="right")].tolist():
        x, y = find(int(i[k])), find(int(j[k]))
        if x != y and similar(sets[i[k]], sets[j[k]], similarity):
            root[max(x, y)] = min(x, y)
            links.append((int(i[k]), int(j[k])))
    return links


def similar_documents(docs: DataFrame, similarity: float, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`near_duplicates` by exact Jaccard similarity of the sets of shingles.

    Plan: equal sets are one node. Nodes meet in the probed partitions of their fingerprints first, at the largest
    distance that :func:`affordable` finds; what lies beyond it (on average two sets at 0.8 differ in 10 of 64 bits,
    where partitions would make a fifth of all pairs candidates) meets in the bands of its minima. Only a spanning forest
    of the pairs near enough by all fingerprint bits leaves a task. Every true link lies inside one component of these candidates, so
    the shingle sets of components of two or more nodes are gathered by component and compared exactly. In a large
    component every set is compared with the one of its smallest node first, which work follows its size; what that
    links is one class. Only the sets left over are compared with all others of their component, block by block, so no
    task holds a component.
    """
    extra = [f"s{k}" for k in range(SKETCHES)]
    most = allowed_bits(similarity, 64 * (1 + SKETCHES))
    fps = materialize(set_sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle), "sketches")
    known = fps.where("doc_id is not null")
    nodes = materialize(known.groupBy("set_id", "fp", *extra).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "sketch-nodes")
    shape_, schema = ["side", "fp", "node", *extra], "key long, side byte, fp long, node long" + "".join(f", {c} long" for c in extra)
    tau, layout = affordable(*bit_statistics(nodes))
    probed = nodes.select("fp", "node", *extra).mapInArrow(probes(layout, extra), schema)
    banded = nodes.select(F.explode("bands").alias("key"), F.lit(0).cast("byte").alias("side"), "fp", "node", *extra)

    def met(rows: DataFrame, reached: bool) -> DataFrame:
        """A forest of the candidates among rows of equal key that partitions at ``tau`` reach, or that they do not."""

        def near(it):
            for g in sorted_groups(it, ["key", "sub"], shape_):
                bits, node = [g[c].astype(np.int64).view(np.uint64) for c in ("fp", *extra)], g["node"]
                left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for i, j in group_pairs(g):
                    far = np.bitwise_count(bits[0][i] ^ bits[0][j]).astype(np.int64)
                    use = (far <= tau) == reached
                    i, j, far = i[use], j[use], far[use]
                    close = far + sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in bits[1:]) <= most
                    if close.any():
                        root = local_roots(len(node), i[close], j[close])
                        at = np.flatnonzero(root != np.arange(len(node)))
                        left.append(at)
                        right.append(root[at])
                root = local_roots(len(node), np.concatenate(left), np.concatenate(right))
                i = np.flatnonzero(root != np.arange(len(node)))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root[i]])], ["a", "b"])

        dealt = with_blocks(rows, rows.select("key", "side")).repartition("key", "sub").sortWithinPartitions("key", "sub", "side")
        return dealt.mapInArrow(near, "a long, b long")

    groups = materialize(components(met(probed, True).unionByName(met(banded, False))), "candidate-groups")
    hot = materialize(groups.groupBy("component").count().where(F.col("count") > WHOLE_COMPONENT).select(F.col("component").alias("hot"), F.ceil(F.col("count") / ALL_BLOCK).cast("long").alias("n")), "large-groups")
    members = groups.join(hot, F.col("component") == F.col("hot"), "left").select("component", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("node").alias("member"))
    members = materialize(members.join(nodes.select("node", "set_id", "fp", *extra), F.col("member") == F.col("node")).drop("node"), "candidates").hint("shuffle_hash")
    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.col(text_col).alias("text")).join(members, F.col("text_id") == F.col("member"))
    carried = ["component", "n", "member", "set_id", "fp", *extra]

    def shingled(it):
        for b in it:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in as_bytes(part.column(0))]
                # an id that repeats with another text is another node
                same = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64) == part.column(4).to_numpy()
                ends = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)))
                out = pa.RecordBatch.from_arrays([*part.columns[1:], lists], [*carried, "shingles"])
                yield out.filter(pa.array(same))

    sets = materialize(texts.select("text", *carried).mapInArrow(shingled, ", ".join(f"{c} long" for c in carried) + ", shingles array<long>").drop("set_id"), "shingle-sets")
    shape, zero = ["fp", *extra, "shingles"], F.lit(0).cast("long")
    small = sets.where("n = 0").select("component", zero.alias("x"), zero.alias("y"), zero.alias("own"), "member", *shape)
    large = sets.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("n")))

    # the hub's set, once however often its row is repeated, goes to every salt of its component
    hub = large.where("member = component").groupBy("component", "n").agg(F.first("shingles").alias("shingles"))
    hub = hub.select(F.col("component").alias("hub"), F.explode(F.sequence(zero, F.col("n") - 1)).alias("hub_salt"), F.col("shingles").alias("hub_shingles"))

    def with_hub(it):
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                near = [similar(np.sort(x.values.to_numpy()), np.sort(y.values.to_numpy()), similarity) for x, y in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(near, pa.bool_())], [*part.schema.names[:-1], "near"])

    names = ["component", "n", "salt", "member", "fp", *extra]
    checked = large.join(hub, (F.col("component") == F.col("hub")) & (F.col("salt") == F.col("hub_salt"))).select(*names, "shingles", "hub_shingles")
    checked = materialize(checked.mapInArrow(with_hub, ", ".join(f"{c} long" for c in names) + ", shingles array<long>, near boolean"), "hub-links")
    to_hub = checked.where("near AND member <> component").select(F.col("component").alias("a"), F.col("member").alias("b"))
    left = materialize(checked.where("NOT near").groupBy(F.col("component").alias("open")).agg(F.ceil(F.count("*") / REST_BLOCK).cast("long").alias("k")), "left-over")
    others = checked.join(left, F.col("component") == F.col("open"))
    own = F.pmod(F.xxhash64("member", F.lit(1)), F.col("k"))
    beyond = F.lit(_SUB)  # blocks of all others are numbered from here on, apart from blocks of those left over
    every = others.select("component", F.explode(F.sequence(zero, F.col("k") - 1)).alias("x"), (F.col("salt") + beyond).alias("y"), F.lit(1).cast("long").alias("own"), "member", *shape)
    rest = others.where("NOT near").select("component", own.alias("x"), F.explode(F.sequence(zero, F.col("n") - 1)).alias("y"), zero.alias("own"), "member", *shape).withColumn("y", F.col("y") + beyond)
    dealt = small.unionByName(every).unionByName(rest)

    def exact(it):
        group, key = [], None

        def links():
            found = linked_in([g[3] for g in group], np.array([g[2] for g in group], dtype=np.int64).view(np.uint64), np.array([g[0] for g in group]), similarity, most, key[1] != key[2]) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([group[k][1] for k in side], pa.int64()) for side in zip(*found, strict=True)], ["a", "b"])

        for b in it:
            plain = np.stack([b.column(k).to_numpy() for k in range(b.num_columns - 1)], axis=1)
            lists = b.column(b.num_columns - 1)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for r in range(b.num_rows):
                now = tuple(plain[r, :3].tolist())
                if now != key:
                    yield from links()
                    group, key = [], now
                group.append((plain[r, 3], plain[r, 4], plain[r, 5:], np.sort(values[at[r] : at[r + 1]].copy())))
        yield from links()

    edges = dealt.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y").mapInArrow(exact, "a long, b long")
    classes = nodes.join(components(edges.unionByName(to_hub)), "node", "left").select(F.col("set_id").alias("class_id"), F.coalesce("component", "node").alias("component"))
    found = fps.join(classes, F.col("set_id") == F.col("class_id"), "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every bit pair, in how many both bits are set; over all rows."""

    def run(it):
        total, n = np.zeros((64, 64)), 0
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(x), 65536):
                bits = np.unpackbits(np.ascontiguousarray(x[k : k + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * 64 + j, -1)), pa.array(np.append(total[i, j], n).astype(np.int64))], ["cell", "c"])

    both, n = np.zeros((64, 64)), 0
    for cell, c in fps.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c")).collect():  # 2081 sums
        if cell < 0:
            n = int(c)
        else:
            both[cell // 64, cell % 64] = both[cell % 64, cell // 64] = c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits; each grows from the most correlated free bit by the strongest correlation."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for g in range(m):
        width = 64 // m + (g < 64 % m)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < width:
            b = max(sorted(free), key=lambda x: corr[x, group].sum())
            group.append(b)
            free.discard(b)
        out.append(sorted(group))
    return out


def _variants(width: int, e: int) -> int:
    return sum(math.comb(width, k) for k in range(1, e + 1))


def differing(n: int, both: np.ndarray, bits: list[int]) -> np.ndarray:
    """Estimated distribution of the number of differing bits among ``bits`` of two fingerprints drawn from all.

    From the joint counts of bit pairs follows for each two bits how often they differ together. The dependence among
    all bits is taken as the tree of the strongest such correlations, on which the sum's distribution is exact."""
    n = max(n, 1)
    p = np.diag(both) / n
    p11 = both / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    joint = np.clip(2 * (p11 * (1 - p11 - p10 - p01) + p10 * p01), 0, 1)
    q = 2 * p * (1 - p)
    sd = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    corr = np.abs(joint - np.outer(q, q)) / np.outer(sd, sd)
    # the tree, root first; every further bit hangs on the reached bit that it is most correlated with
    reached, parent = [bits[0]], {}
    while len(reached) < len(bits):
        b, a = max(((b, a) for b in bits if b not in reached for a in reached), key=lambda e: corr[e])
        parent[b] = a
        reached.append(b)
    # below[b][d]: distribution of the number of differing bits in the part below b and b itself, if b differs (d = 1)
    below = {b: [np.array([1.0]), np.array([0.0, 1.0])] for b in bits}
    for b in reversed(reached[1:]):
        a = parent[b]
        for d in (0, 1):
            base = q[a] if d else 1 - q[a]
            together = joint[a, b] if d else q[b] - joint[a, b]
            differs = min(max(together / base, 0.0), 1.0) if base > 1e-12 else q[b]
            mixed = np.zeros(len(below[b][1]))
            mixed[: len(below[b][0])] += (1 - differs) * below[b][0]
            mixed += differs * below[b][1]
            below[a][d] = np.convolve(below[a][d], mixed)
    out = np.zeros(len(bits) + 1)
    for d, weight in ((0, 1 - q[bits[0]]), (1, q[bits[0]])):
        out[: len(below[bits[0]][d])] += weight * below[bits[0]][d][: len(out)]
    return out


def allocate(n: int, both: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """(estimated work, thresholds) of least work with sum tau - m + 1, by dynamic programming.

    The candidate pairs of a partition at threshold e are estimated as n(n-1)/2 times the probability that at most e
    of its bits differ (:func:`differing`).
    """
    options = []
    for bits in parts:
        within = np.cumsum(differing(n, both, bits))
        options.append([0.0] + [PAIR_COST * n * (n - 1) / 2 * within[min(e, len(bits))] + PROBE_COST * n * (1 + _variants(len(bits), e) / 2) for e in range(tau + 1)])
    target = tau + 1  # sum of (threshold + 1)
    best = {0: (0.0, [])}
    for cost in options:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for e1, x in enumerate(cost):
                if used + e1 <= target and (used + e1 not in nxt or c + x < nxt[used + e1][0]):
                    nxt[used + e1] = (c + x, [*chosen, e1 - 1])
        best = nxt
    return best[target]


def plan(n: int, both: np.ndarray, tau: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every probed partition; the number of partitions with the least estimated work."""
    return cheapest(n, both, tau)[1]


def affordable(n: int, both: np.ndarray, work: float = PARTITION_WORK, least: int = DISTANCE, most: int = 12) -> tuple[int, list[tuple[list[int], int]]]:
    """The largest distance, from ``least`` on, whose partitions take at most ``work`` microseconds a fingerprint by
    estimate, and its layout."""
    n = max(n, 1)  # without rows every layout would be free
    best = (least, cheapest(n, both, least)[1])
    for tau in range(least + 1, most + 1):
        cost, layout = cheapest(n, both, tau)
        if cost > work * n:
            break
        best = (tau, layout)
    return best


def cheapest(n: int, both: np.ndarray, tau: int) -> tuple[float, list[tuple[list[int], int]]]:
    """Estimated work and layout of :func:`plan`."""
    found = []
    for m in range(2, tau + 2):
        parts = group_bits(n, both, m)
        work, thresholds = allocate(n, both, parts, tau)
        found.append((work, m, [(b, t) for b, t in zip(parts, thresholds, strict=True) if t >= 0]))
    work, _, layout = min(found, key=lambda f: f[:2])
    return work, layout


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def probes(layout: list[tuple[list[int], int]], extra: list[str] | tuple = ()) -> Callable:
    """Arrow function from ``fp, node`` (and ``extra`` long columns) to ``key, side, fp, node`` (and these): the home row
    of every partition (side 0) and its variants within the threshold (side 1). Of two fingerprints the one with the
    smaller value probes."""
    masks = [[sum(1 << b for b in c) for k in range(1, t + 1) for c in itertools.combinations(range(len(bits)), k)] for bits, t in layout]

    def emit(key, side, carried):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), side, dtype=np.int8)), *map(pa.array, carried)], ["key", "side", "fp", "node", *extra])

    def run(it):
        for b in it:
            every = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2 + len(extra))]
            for k in range(0, b.num_rows, 16384):
                carried = [x[k : k + 16384] for x in every]
                for g, (bits, _) in enumerate(layout):
                    v = _values(carried[0].view(np.uint64), bits)
                    yield emit(g << 40 | v, 0, carried)
                    for part in range(0, len(masks[g]), 32):
                        w = v[:, None] ^ np.array(masks[g][part : part + 32], dtype=np.int64)[None, :]
                        r, c = np.nonzero(w > v[:, None])
                        yield emit(g << 40 | w[r, c], 1, [x[r] for x in carried])

    return run


def ranged_pairs(left: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1 << 20):
    """Index pairs (left[k], j) for low[k] <= j < high[k], about ``most`` at once."""
    count = np.maximum(high - low, 0)
    cuts = np.cumsum(count)
    at = 0
    while at < len(left):
        done = cuts[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cuts, done + most, side="right")))
        n = count[at:to]
        i = np.repeat(left[at:to], n)
        offset = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, np.repeat(low[at:to], n) + offset
        at = to


def sorted_groups(it, keys: list[str], columns: list[str]):
    """From Arrow batches sorted by ``keys``: dicts of numpy columns that hold whole groups; the pieces of a group
    that crosses batches are put together once, when it ends."""
    pieces: list[dict] = []

    def joined(parts: list[dict]) -> dict:
        return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for b in it:
        now = {c: b.column(b.schema.get_field_index(c)) for c in [*keys, *columns]}
        now = {c: (v.to_numpy(zero_copy_only=False) if not pa.types.is_list(v.type) else v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)) for c, v in now.items()}
        if not len(now[keys[0]]):
            continue
        last = np.ones(len(now[keys[0]]), dtype=bool)
        for k in keys:
            last &= now[k] == now[k][-1]
        cut = int(len(last) - np.argmin(last[::-1])) if not last.all() else 0
        goes_on = bool(pieces) and all(pieces[-1][k][-1] == now[k][0] for k in keys)
        if cut == 0 and goes_on:
            pieces.append(now)
            continue
        if pieces or cut:
            yield joined([*pieces, {c: v[:cut] for c, v in now.items()}] if cut else pieces)
        pieces = [{c: v[cut:] for c, v in now.items()}]
    if pieces:
        yield joined(pieces)


def group_pairs(g: dict, most: int = 1 << 20):
    """Candidate index pairs of sorted groups (key, sub, side): home rows (side 0) with each other, unless the
    group is a cross block (sub >= 0 with x <> y), and with the rows of side 1."""
    changed = np.concatenate([[True], (g["key"][1:] != g["key"][:-1]) | (g["sub"][1:] != g["sub"][:-1])])
    start, length = group_runs(np.cumsum(changed))
    end = np.repeat(start + length, length)
    homes = np.repeat(np.add.reduceat((g["side"] == 0).astype(np.int64), start), length)
    first_other = np.repeat(start, length) + homes
    at = np.flatnonzero((g["side"] == 0) & (np.repeat(length, length) > 1))
    cross = (g["sub"][at] >= 0) & (g["sub"][at] // _SUB != g["sub"][at] % _SUB)
    yield from ranged_pairs(at, np.where(cross, first_other[at], at + 1), end[at], most)


def with_blocks(rows: DataFrame, sides: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``sub``: -1, or for buckets with over ``block_rows`` rows the block pair x * 2**24 + y. ``sides`` has the
    ``key, side`` of every row.

    Home rows (side 0) of such a bucket are dealt to n blocks, probe rows (side 1) to q more, both of about
    ``block_rows``. A home block meets itself, every other home block and every probe block once, so every pair of
    rows that shared the bucket, but two probes, meets in exactly one block pair. Probes without a home go.
    """
    home = F.count_if(F.col("side") == 0)
    hot = sides.groupBy("key").agg(home.alias("homes"), (F.count("*") - home).alias("probes")).where(F.col("homes") + F.col("probes") > block_rows)
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("long")
    hot = materialize(hot.select(F.col("key").alias("hot_key"), blocks("homes").alias("n"), blocks("probes").alias("q")), "hot-buckets")
    joined = rows.join(hot, rows.key == hot.hot_key, "left")
    zero, pick = F.lit(0).cast("long"), F.xxhash64("node")
    own, probe = F.pmod(pick, F.greatest("n", F.lit(1))), F.col("n") + F.pmod(pick, F.greatest("q", F.lit(1)))
    entry = lambda sub, side: F.struct(sub.alias("sub"), side.cast("byte").alias("side"))
    none = F.array().cast("array<struct<sub:bigint,side:tinyint>>")
    homes = F.transform(F.sequence(zero, F.col("n") - 1), lambda o: entry(F.least(own, o) * _SUB + F.greatest(own, o), own > o))
    asked = F.when(F.col("q") > 0, F.transform(F.sequence(F.col("n"), F.col("n") + F.col("q") - 1), lambda o: entry(own * _SUB + o, F.lit(0)))).otherwise(none)
    probes = F.transform(F.sequence(zero, F.col("n") - 1), lambda o: entry(o * _SUB + probe, F.lit(1)))
    plain = F.array(entry(F.lit(-1).cast("long"), F.col("side")))
    dealt = F.when(F.col("n").isNull(), plain).when(F.col("n") == 0, none).when(F.col("side") == 0, F.concat(homes, asked)).otherwise(probes)
    keep = [c for c in rows.columns if c != "side"]
    return joined.select(*keep, F.explode(dealt).alias("d")).select(*keep, "d.sub", "d.side")


def allowed_bits(similarity: float, bits: int, slack: int = CANDIDATE_SLACK) -> int:
    """Differing bits of SimHashes of ``bits`` bits at a Jaccard similarity of shingles: the angle of sets of equal
    size that share it, plus ``slack``."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi) + slack


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id reachable over links of at most
    ``distance`` differing bits, itself included).

    With ``similarity`` pairs link whose sets of shingles have at least this Jaccard similarity
    (:func:`similar_documents`); fp is then the vote of the distinct shingles.

    Null and wordless texts have fingerprint 0 and link like any other; a text of fewer words than a shingle
    is one shingle. Repeated ids and repeated texts are fine. Rows with a null id get a fingerprint, link
    nothing and have a null component. Other columns are ignored; an empty table gives no rows.

    Plan: equal fingerprints are one node (its smallest id), so copies never meet each other. Buckets hold
    distinct fingerprints; pairs are compared inside the task and only a spanning forest of the verified links
    leaves it. A bucket too large for one task is dealt as block pairs. Nothing but 2081 bit sums reaches the
    driver.
    """
    if similarity is not None:
        return similar_documents(docs, similarity, shingle=shingle, id_col=id_col, text_col=text_col)
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", "node"), "simhash-nodes")
    n, both = bit_statistics(nodes)
    layout = plan(n, both, distance)
    schema = "key long, side byte, fp long, node long"
    rows = nodes.mapInArrow(probes(layout), schema)
    rows = with_blocks(rows, rows.select("key", "side"))

    def verify(it):
        for g in sorted_groups(it, ["key", "sub"], ["side", "fp", "node"]):
            fp, node = g["fp"].astype(np.int64).view(np.uint64), g["node"]
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for i, j in group_pairs(g):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                if near.any():
                    i, j = i[near], j[near]
                    root = local_roots(len(fp), i, j) if len(i) > 4096 else None
                    if root is not None:  # a dense piece shrinks to its forest at once
                        i = np.flatnonzero(root != np.arange(len(fp)))
                        j = root[i]
                    left.append(i)
                    right.append(j)
            i, j = np.concatenate(left), np.concatenate(right)
            if len(i):
                root = local_roots(len(fp), i, j)
                i = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root[i]])], ["a", "b"])

    # Few bits of the key spread badly under a plain hash of (key, sub); the sort keeps groups whole.
    edges = rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "side").mapInArrow(verify, "a long, b long")
    linked = components(edges)
    classes = nodes.join(linked, "node", "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "node").alias("component"))
    found = fps.join(classes, F.col("fp") == F.col("class_fp"), "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate group (the smallest id) and rows without an id.

    Same rules as :func:`near_duplicates`. Of rows that repeat such an id one stays: the first by a hash of all its
    columns, so reruns agree. Columns of ``docs`` may have any names.
    """
    id_col = settings.get("id_col", "doc_id")
    found = near_duplicates(docs, **settings)
    name, first = unused(docs, "kept_id"), unused(docs, "kept_row")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = materialize(kept.select(F.col("doc_id").alias(name), "n"), "simhash-kept")
    # Ids are joined to texts by a shuffled hash join at every size: the texts are dealt once and never sorted.
    once, again = kept.where("n = 1").select(name).hint("shuffle_hash"), kept.where("n > 1").select(name)
    out = docs.join(once, docs[id_col] == once[name], "left_semi")
    if not again.isEmpty():
        repeats = docs.join(again.hint("shuffle_hash"), docs[id_col] == again[name], "left_semi")
        out = out.unionByName(repeats.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), row_hash(docs)).alias(first)).select(f"{first}.*"))
    return out.unionByName(docs.where(docs[id_col].isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
