"""Katz backoff language-model scoring.

A model of any order (three by default) with Good-Turing discounts. Seen n-grams have discounted relative
frequencies; the mass that the discounts free in a context goes to all other words in proportion to their
probability one order below, with the weight that makes every context sum to exactly one. Unigrams are discounted
the same way and leave their mass to the unknown word. A document's first token has the begin mark as its only
context, its second the begin mark and the first token, and so on.

How it is spread: a task cuts its documents into slices, numbers a slice's distinct words and n-grams, and writes
the numbered sequence once to the shared folder. Order by order, what is shuffled is one entry per distinct n-gram
of a slice (its training count is pre-aggregated, held-out n-grams ask with count 0), packed by bucket of its
context. Bucket tasks add the counts of all slices and answer each slice in the order of its request: the count,
and per context the total, the numbers of types seen 1, 2, ... times and the lower-order mass of its types. The
next order's entries carry their suffix's count, so that every bucket can sum lower-order probabilities by itself.
The slices evaluate the recursion per token. A context that makes up over 1/4096 of the tokens, or over a quarter of a
bucket where there are many buckets, has its words dealt over all buckets and its sums added afterwards; there are at
most 65,536 such contexts an order, whatever the corpus.

The merged counts are the model. They are kept as Parquet tables by order and bucket (``save_to``) and score other
texts later (``model``). Words are told apart by their XXH64; n-grams by the numbers that the count tables give
to words, most frequent first, so that packed entries are small.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import _mixed
from .util import as_bytes, bucket_count, filesystem, fresh_path, materialize, path_exists, word_bytes

ORDER = 3
SLICE_TOKENS = 1_000_000
BUCKET_BYTES = 8 << 20
#: A context that makes up over 1/HOT_SHARE of the tokens is hot, or over a quarter of a bucket's share where there are
#: more buckets, down to 1/HOT_MOST: the bound on the table of hot contexts.
HOT_SHARE, HOT_MOST = 4096, 65_536
#: Partitions of an exchange; more buckets or slices than these share them, one after the other.
PARTITIONS = 16_384
#: Counts up to CUTOFF are discounted.
CUTOFF = 5
BEGIN, END = 0, 1
_R = [f"n{r}" for r in range(1, CUTOFF + 2)]
_REQUEST = "bucket long, slice_id long, blob binary"
_STORED = -1


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discount ratios by count, from the numbers n of types seen 1, 2, ... times: entries 0 to CUTOFF + 1,
    where 0 is unused and the last (1.0) holds for all larger counts. The cutoff falls until the Good-Turing
    ratios are proper; tables too small for any (or without singletons) get absolute discounts of one half."""
    out = np.ones(CUTOFF + 2)
    out[0] = 0.0
    for k in range(min(CUTOFF, len(n) - 1), 0, -1):
        if any(x <= 0 for x in n[: k + 1]):
            continue
        a = (k + 1) * n[k] / n[0]
        if a >= 1:
            continue
        d = [((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            out[1 : k + 1] = d
            return out
    for r in range(1, CUTOFF + 1):
        out[r] = (r - 0.5) / r
    return out


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, CUTOFF + 1)] * c


class Unigrams:
    """Discounted unigram probabilities by count; ``unknown`` is what they leave."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types, self.n, self.d = tokens, types, n, discounts(n)
        freed = sum(x * r * (1 - self.d[r]) for r, x in enumerate(n[:CUTOFF], 1))
        self.den = tokens if freed > 0 else tokens + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.den

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d) / self.den, self.unknown)


class Contexts:
    """What the recursion needs of each context: totals, numbers of types by count, lower-order mass of its types."""

    def __init__(self, n: int):
        self.total, self.seen, self.m = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros((n, CUTOFF), dtype=np.int64)

    def freed(self, d: np.ndarray) -> np.ndarray:
        return self.m @ (np.arange(1, CUTOFF + 1) * (1 - d[1 : CUTOFF + 1]))

    def den(self, d: np.ndarray) -> np.ndarray:
        """Denominators: the total, or one more where the discounts free nothing; 1 for contexts never seen."""
        return np.maximum(np.where(self.freed(d) > 0, self.total, self.total + 1), 1)

    def alpha(self, d: np.ndarray, least: float) -> np.ndarray:
        """Backoff weights: the freed mass over the lower-order mass of the words not seen; 1 without any count."""
        freed = self.freed(d)
        return np.where(self.total > 0, np.where(freed > 0, freed, 1.0) / self.den(d) / np.maximum(1 - self.seen, least), 1.0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 64-bit integers or of doubles as byte planes, one zstandard frame. No plane is stored for
    bytes that no number uses."""
    head, body = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        real = x.dtype == np.float64
        x = np.ascontiguousarray(x).view("<u8") if real else x.astype("<u8")
        used = 8 if real else -(-int(x.max(initial=0)).bit_length() // 8)
        head.append(struct.pack("<BI", used | (128 if real else 0), len(x)))
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(head + body))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + 5 * raw[0], []
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<BI", raw, 1 + 5 * k)
        used = kind & 15
        grid = np.zeros((n, 8), dtype=np.uint8)
        grid[:, :used] = np.frombuffer(raw, dtype=np.uint8, count=used * n, offset=at).reshape(used, n).T
        at += used * n
        out.append(grid.reshape(-1).view(np.float64 if kind & 128 else np.int64))
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences to the entry before, modulo 2**64; small where x is in runs or ascends."""
    x = x.astype(np.uint64)
    return np.diff(x, prepend=np.uint64(0))


def _back(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64).view(np.int64)


def _save(path: str, data: bytes) -> None:
    """Write under another name, then move: a retried task leaves the same file."""
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part = f"{p}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, p)


def _load(path: str) -> list[np.ndarray]:
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return _unpack(f.read())


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key in ascending order of keys, and the place of one entry of each number."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
    number = np.empty(len(s), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _joint(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each distinct row of columns of non-negative integers, in the order of the rows."""
    key = columns[0]
    for x in columns[1:]:
        key, x = (_numbered(y)[0] if int(y.max(initial=0)) >= 1 << 31 else y for y in (key, x))
        key = key << 31 | x
    return key


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(x)))


def _blobs(bucket: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice of the bucket-sorted order) of every bucket that has entries."""
    start, length = _runs(bucket)
    return [(int(bucket[a]), slice(a, a + n)) for a, n in zip(start.tolist(), length.tolist(), strict=True)]


class _Level:
    """Distinct n-grams of one order in a slice: context (a number of the level below), word, suffix (another number
    of the level below), training count in the slice, and each token's n-gram (-1 where the context is too long)."""

    def __init__(self, at: np.ndarray, ctx: np.ndarray, below: np.ndarray, seq: np.ndarray, words: int, learn: np.ndarray, tokens: int):
        number, first = _numbered(ctx * words + seq[at])
        self.of = np.full(tokens, -1, dtype=np.int64)
        self.of[at] = number
        self.ctx, self.word, self.suffix = ctx[first], seq[at[first]], below[at[first]]
        self.n = np.bincount(number[learn[at]], minlength=len(first))


class _Slice:
    """A slice as read back: token sequence, its words in request order with their buckets (the begin mark is no
    word), document rows, and its n-grams of every order."""

    def __init__(self, path: str, order: int = 1):
        self.seq, self.order, bucket, self.length, self.doc, self.known_id, held = _load(path)
        self.bucket, self.held, self.words = _back(bucket), held.astype(bool), len(self.order) + 1
        self.starts = np.cumsum(self.length) - self.length
        place = np.arange(len(self.seq)) - np.repeat(self.starts, self.length)
        learn = np.repeat(~self.held, self.length)
        self.n_words = np.bincount(self.seq[learn], minlength=self.words)
        self.levels: list[_Level] = []
        below = self.seq
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 2)
            before = np.where(place[at] > 0, below[at - 1], BEGIN) if k == 2 else below[at - 1]
            self.levels.append(_Level(at, before, below, self.seq, self.words, learn, len(self.seq)))
            below = self.levels[-1].of


def hot_share(buckets: int) -> int:
    """Contexts with at least one of this many parts of the tokens are dealt over all buckets."""
    return max(HOT_SHARE, min(HOT_MOST, 4 * buckets))


def _slice_path(folder: str, slice_id: int) -> str:
    return f"{folder}/slice-{slice_id >> 20:06d}-{slice_id & 0xFFFFF:05d}"


class _Recursion:
    """A slice's probabilities, order by order, from the answers to its requests."""

    def __init__(self, s: _Slice, answers: dict[int, dict[int, bytes]], uni: Unigrams, levels: list[tuple[np.ndarray, dict]], buckets: int):
        self.s, self.buckets, self.tokens = s, buckets, uni.tokens
        got = [_unpack(answers[1][k]) for k, _ in _blobs(s.bucket, buckets)]
        self.ids, self.c1 = (np.zeros(s.words, dtype=np.int64) for _ in range(2))
        self.ids[s.order], self.c1[s.order] = (np.concatenate([g[k] for g in got]) for k in range(2))
        self.p1 = uni.p(self.c1)
        # of the level reached: counts, probabilities, denominators of the context, columns of word numbers
        self.c, self.p, self.den, self.columns = self.c1, self.p1, np.full(s.words, uni.den), [self.ids]
        self.log = np.log10(self.p1)[s.seq]  # of every token, by the highest order its context allows so far
        for k, (d, hot) in enumerate(levels, 2):
            self._climb(k, answers[k], d, hot, uni.unknown)

    def request(self, k: int):
        """Of the level above the one reached: columns of the context, whether it is hot, whether it goes without the
        others of its suffix, and the n-grams in request order with their buckets."""
        v = self.s.levels[k - 2]
        context = self.columns
        hot_context = self.c * hot_share(self.buckets) >= max(self.tokens, 1)
        if k == 2:
            hot_context[BEGIN] = True
        suffix = np.zeros(len(context[0]), dtype=np.uint64)
        for x in context[1:]:
            suffix = _mixed(suffix ^ x.view(np.uint64))
        mix = _mixed(suffix ^ context[0].view(np.uint64))
        # contexts go where those of the same suffix go, or by themselves where there are many
        alone = np.ones(len(mix), dtype=bool) if k == 2 else self.hot_below[self.s.levels[k - 3].suffix]
        spread = np.where(hot_context[v.ctx], _mixed(mix[v.ctx] ^ self.ids[v.word].view(np.uint64)), np.where(alone, mix, suffix)[v.ctx])
        b = (spread % np.uint64(self.buckets)).astype(np.int64)
        # by bucket, then by the context's last word, so that its columns pack well
        rank = np.empty(len(mix), dtype=np.int64)
        rank[np.argsort(_joint(context[::-1]), kind="stable")] = np.arange(len(mix))
        n, words = len(mix), self.s.words
        if self.buckets * n < (1 << 62) // words:
            order = np.argsort((b * n + rank[v.ctx]) * words + v.word)
        else:
            order = np.lexsort((v.word, rank[v.ctx], b))
        return context, hot_context, alone, order, b[order]

    def _climb(self, k: int, answers: dict[int, bytes], d: np.ndarray, hot: dict[tuple, tuple], least: float) -> None:
        v = self.s.levels[k - 2]
        context, hot_context, _, order, b = self.request(k)
        c, at_context = np.zeros(len(order), dtype=np.int64), Contexts(len(context[0]))
        for bucket, at in _blobs(b, self.buckets):
            mine = order[at]
            start, _ = _runs(v.ctx[mine])
            cold = v.ctx[mine][start]
            cold = cold[~hot_context[cold]]
            c[mine], at_context.seen[cold], *m = _unpack(answers[bucket])
            # every occurrence of a context but the begin mark is a token, and one follows it
            at_context.total[cold], at_context.m[cold] = self.c[cold], np.stack(m, axis=1)
        for x in np.flatnonzero(hot_context):
            if found := hot.get(tuple(int(col[x]) for col in context)):
                at_context.total[x], at_context.seen[x], at_context.m[x] = found
        den, alpha = at_context.den(d), at_context.alpha(d, least)
        p = np.where(c > 0, _discounted(c, d) / den[v.ctx], alpha[v.ctx] * self.p[v.suffix])
        self.columns = [*(x[v.ctx] for x in context), self.ids[v.word]]
        self.c, self.p, self.den, self.hot_below = c, p, den[v.ctx], hot_context
        reached = v.of >= 0
        self.log[reached] = np.log10(p)[v.of[reached]]


def _slice_documents(folder: str, buckets: int, slice_tokens: int, held_out):
    """Arrow function: documents to unigram requests; writes the slice files."""

    def flush(state, k):
        slice_id = (TaskContext.get().partitionId() << 20) + k
        path = _slice_path(folder, slice_id)
        words, docs = state
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
        flag = lambda x: np.array(x, dtype=np.int64)
        b = (hashes[1:].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
        b, order = b[order], order + 1
        _save(path, _pack(np.concatenate([s for _, s in docs]), order, _steps(b), flag([len(s) for _, s in docs]), flag([d or 0 for d, _ in docs]), flag([d is not None for d, _ in docs]), flag([held_out(d) for d, _ in docs])))
        s = _Slice(path)
        rows = [(bucket, _pack(hashes[order[at]], s.n_words[order[at]])) for bucket, at in _blobs(b, buckets)]
        return _rows(rows, slice_id)

    def fresh():
        words: dict = defaultdict()
        words[b" begin"], words[b" end"] = BEGIN, END
        words.default_factory = words.__len__
        return words, []

    def run(it):
        state, n, k = fresh(), 0, 0
        for b in it:
            for d, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                found = word_bytes(t.as_py())
                found.append(b" end")
                state[1].append((d, np.fromiter(map(state[0].__getitem__, found), dtype=np.int32, count=len(found))))
                n += len(found)
                if n >= slice_tokens:
                    yield flush(state, k)
                    state, n, k = fresh(), 0, k + 1
        if state[1]:
            yield flush(state, k)

    return run


def _rows(rows: list[tuple[int, bytes]], slice_id: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([slice_id] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "slice_id", "blob"])


def _sorted_rows(t: pa.Table, *by: str) -> list[dict]:
    return t.sort_by([(c, "ascending") for c in by]).to_pylist()


def _by_count(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, CUTOFF + 2)]


def _count_words(buckets: int, keep: bool):
    """One bucket's unigrams: total counts and numbers by frequency, answered per slice, with the bucket's sums."""

    def run(t: pa.Table) -> pa.Table:
        rows = _sorted_rows(t, "slice_id")
        parts = [_unpack(r["blob"]) for r in rows]
        number, first = _numbered(np.concatenate([p[0] for p in parts]))
        key = np.concatenate([p[0] for p in parts])[first]
        c = np.zeros(len(key), dtype=np.int64)
        np.add.at(c, number, np.concatenate([p[1] for p in parts]))
        ids = np.empty(len(key), dtype=np.int64)
        ids[np.lexsort((key, -c))] = np.arange(len(key)) * buckets + rows[0]["bucket"] + 1
        sums = [int((c > 0).sum()), int(c.sum()), *_by_count(c)]
        at, out = 0, []
        for r, p in zip(rows, parts, strict=True):
            mine = number[at : at + len(p[0])]
            at += len(p[0])
            if r["slice_id"] != _STORED:
                out.append((r["slice_id"], r["bucket"], _pack(ids[mine], c[mine]), *[0] * len(sums)))
        known = np.flatnonzero(c)
        out.append((_STORED, rows[0]["bucket"], _pack(key[known], c[known]) if keep else None, *sums))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(sums)]
        return pa.table([pa.array(x, y) for x, y in zip(cols, kinds, strict=True)], names=["slice_id", "bucket", "blob", "types", "tokens", *_R])

    return run


def _answers(rows: list[dict]) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = defaultdict(dict)
    for r in rows:
        out[r["level"]][r["bucket"]] = r["blob"]
    return out


def _request(k: int, folder: str, uni: Unigrams, levels: list, buckets: int):
    """A slice's answers so far to its requests of order k."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        s = _Slice(_slice_path(folder, rows[0]["slice_id"]), k)
        so_far = _Recursion(s, _answers(rows), uni, levels, buckets)
        v = s.levels[k - 2]
        context, hot, alone, order, b = so_far.request(k)
        out = []
        for bucket, at in _blobs(b, buckets):
            mine = order[at]
            start, length = _runs(v.ctx[mine])
            head = mine[start]
            # a bucket that has all contexts of a suffix counts it by itself
            den = np.where(alone[v.ctx[head]], so_far.den[v.suffix[head]], 0)
            low = np.where(alone[v.ctx[mine]], so_far.c[v.suffix[mine]], 0)
            out.append((bucket, _pack(*(_steps(x[v.ctx[head]]) for x in context), hot[v.ctx[head]], length, den, so_far.ids[v.word[mine]], v.n[mine], low)))
        return pa.Table.from_batches([_rows(out, rows[0]["slice_id"])])

    return run


def _count(k: int, d_low: np.ndarray, keep: bool):
    """One bucket's n-grams of order k: counts and context sums, answered per slice."""

    def run(t: pa.Table) -> pa.Table:
        rows = _sorted_rows(t, "slice_id")
        parts = [_unpack(r["blob"]) for r in rows]
        for p in parts:
            p[: k - 1] = [_back(x) for x in p[: k - 1]]
        *context, hot, run_length, den, word, n, low = (np.concatenate([p[x] for p in parts]) for x in range(len(parts[0])))
        run_ctx, ctx_first = _numbered(_joint(context))
        contexts = len(ctx_first)
        entry_ctx = np.repeat(run_ctx, run_length)
        number, first = _numbered(_joint([entry_ctx, word]))
        c = np.zeros(len(first), dtype=np.int64)
        np.add.at(c, number, n)
        of = entry_ctx[first]
        sums = Contexts(contexts)
        np.add.at(sums.total, of, c)
        low, den = low[first], den[ctx_first]
        shared = den == 0
        if shared.any():
            # the order below, from this one: the counts of suffix and word, and each suffix's denominator
            suffix, heads = _numbered(_joint([x[ctx_first] for x in context[1:]]))
            below, below_first = _numbered(_joint([suffix[of], word[first]]))
            count = np.zeros(len(below_first), dtype=np.int64)
            np.add.at(count, below, c)
            of_suffix, lower = suffix[of][below_first], Contexts(len(heads))
            np.add.at(lower.total, of_suffix, count)
            for r in range(CUTOFF):
                lower.m[:, r] = np.bincount(of_suffix[count == r + 1], minlength=len(heads))
            low, den = np.where(shared[of], count[below], low), np.where(shared, lower.den(d_low)[suffix], den)
        sums.seen = np.bincount(of, weights=np.where(c > 0, _discounted(low, d_low) / den[of], 0.0), minlength=contexts)
        for r in range(CUTOFF):
            sums.m[:, r] = np.bincount(of[c == r + 1], minlength=contexts)
        at = at_run = 0
        out, none = [], [None] * 4
        for r, p in zip(rows, parts, strict=True):
            mine, heads = number[at : at + len(p[-1])], run_ctx[at_run : at_run + len(p[k])]
            at, at_run = at + len(p[-1]), at_run + len(p[k])
            if r["slice_id"] == _STORED:
                continue
            cold = p[k - 1] == 0
            # the lower-order mass is of use only where the slice backs off
            off = np.add.reduceat(c[mine] == 0, np.cumsum(p[k]) - p[k]) > 0
            seen = np.where(off, sums.seen[heads], 0.0)[cold]
            out.append((r["slice_id"], r["bucket"], _pack(c[mine], seen, *(sums.m[heads, x][cold] for x in range(CUTOFF))), *none, *[0] * len(_R)))
        for h in np.flatnonzero(hot[ctx_first]):
            out.append((None, None, None, [int(x[ctx_first[h]]) for x in context], int(sums.total[h]), float(sums.seen[h]), [int(x) for x in sums.m[h]], *[0] * len(_R)))
        blob = None
        if keep:
            known = np.flatnonzero(c)
            start, length = _runs(of[known])
            head = ctx_first[of[known][start]]
            blob = _pack(*(_steps(x[head]) for x in context), hot[head], length, np.where(shared, 0, den)[of[known][start]], word[first[known]], c[known], np.where(shared[of], 0, low)[known])
        out.append((_STORED, rows[0]["bucket"], blob, *none, *_by_count(c)))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.list_(pa.int64()), *[pa.int64()] * len(_R)]
        return pa.table([pa.array(x, y) for x, y in zip(cols, kinds, strict=True)], names=["slice_id", "bucket", "blob", "hot", "total", "seen", "m", *_R])

    return run


def _score_slice(folder: str, uni: Unigrams, levels: list, buckets: int):
    """A slice's answers to one row per document."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        s = _Slice(_slice_path(folder, rows[0]["slice_id"]), len(levels) + 1)
        r = _Recursion(s, _answers(rows), uni, levels, buckets)
        base = np.log10((r.c1 + 1) / (uni.tokens + uni.types + 1))
        add = lambda x: np.add.reduceat(x, s.starts)  # noqa: E731  every document has at least its end token
        return pa.table({"doc_id": pa.array(s.doc, mask=s.known_id == 0), "held_out": s.held, "n_tokens": s.length, "n_known": add((r.c1 > 0).astype(np.int64)[s.seq]), "train_tokens": np.full(len(s.doc), uni.tokens, dtype=np.int64), "base_score": add(base[s.seq]), "score": add(r.log)})

    return run


def score_texts(docs: DataFrame, *, order: int = ORDER, mod: int = 7, rest: int = 2, model: str | None = None, save_to: str | None = None, slice_tokens: int | None = None, bucket_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows whose crc32(id as text) mod ``mod`` is not ``rest``; held_out marks the others
    (a null id is never held out). With ``model``, the folder of an earlier run's ``save_to``, nothing is learned and
    every row is held out; the order is then the stored one. Texts are taken whole, A-Z lower-cased, cut at ASCII
    white space; each ends in one end token, which counts. Null texts are empty: their only token is the end.
    base_score: add-one unigram log10 probability; score: the Katz model's, unknown words sharing one entry in both.
    Repeated rows count each time. An empty table gives no rows; without training rows every probability is that of
    the unknown word alone (score 0). Other columns are ignored. Words with equal XXH64 count as one word (among
    10**9 distinct words, 3 % chance that any two do). Counts are 64-bit.

    Shuffled entries follow the number of distinct n-grams of a slice; they are packed in one row per slice and
    bucket with entries. Buckets are of about ``bucket_bytes`` of text (``BUCKET_BYTES``) at every size, slices of
    ``slice_tokens`` (``SLICE_TOKENS``); a row holds about 0.6 * slice_tokens * bucket_bytes / (bytes of all texts)
    n-grams. Where that falls below some 100, beyond about 50 GB, give larger ones as the executors' memory allows: a
    task holds a slice, or a bucket. An exchange has at most ``PARTITIONS`` partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is not None:
        meta = spark.read.parquet(f"{model}/meta").first()
        buckets, order = meta["buckets"], meta["order"]
        held_out = lambda d: True
    else:
        buckets = bucket_count(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, bucket_bytes or BUCKET_BYTES)
        held_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % mod == rest
    counts = ", ".join(f"{x} long" for x in _R)
    keep = save_to is not None

    def counted(k: int, requests: DataFrame, count, schema: str) -> DataFrame:
        """Requests (with the stored table, if there is one) to answers, written; the table is kept on demand."""
        if model is not None and path_exists(spark, f"{model}/order={k}"):
            requests = requests.unionByName(spark.read.parquet(f"{model}/order={k}").select("bucket", F.lit(_STORED).cast("long").alias("slice_id"), "blob"))
        found = materialize(requests.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(count, f"slice_id long, bucket long, blob binary, {schema}{counts}"), f"katz-{k}")
        if keep:
            found.where(f"slice_id = {_STORED}").select("bucket", "blob").write.parquet(f"{save_to}/order={k}")
        return found

    folder = fresh_path(spark, "katz-slices")
    asked = rows.mapInArrow(_slice_documents(folder, buckets, slice_tokens or SLICE_TOKENS, held_out), _REQUEST)
    found = [counted(1, asked, _count_words(buckets, keep), "types long, tokens long, ")]
    s = found[0].agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "types", *_R))).first()
    uni = Unigrams(int(s["tokens"]), int(s["types"]), [int(s[x]) for x in _R])
    # A slice's rows are small and its work is not: a number of partitions keeps AQE from merging slices.
    slices = max(1, found[0].where("slice_id >= 0").select("slice_id").distinct().count())

    def by_slice() -> DataFrame:
        union = found[0].select("slice_id", "bucket", "blob", F.lit(1).alias("level"))
        for k, f in enumerate(found[1:], 2):
            union = union.unionByName(f.select("slice_id", "bucket", "blob", F.lit(k).alias("level")))
        return union.where("slice_id >= 0").repartition(min(slices, PARTITIONS), "slice_id").groupBy("slice_id")

    levels: list[tuple[np.ndarray, dict]] = []
    for k in range(2, order + 1):
        asked = by_slice().applyInArrow(_request(k, folder, uni, levels, buckets), _REQUEST)
        found.append(counted(k, asked, _count(k, levels[-1][0] if levels else uni.d, keep), "hot array<long>, total long, seen double, m array<long>, "))
        n = found[-1].agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in _R)).first()
        # At most hot_share(buckets) contexts hold that part of the tokens each, and the begin mark: this table's bound.
        sums = found[-1].where("hot is not null").groupBy("hot").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), *(F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(CUTOFF))).collect()
        levels.append((discounts([int(n[x]) for x in _R]), {tuple(r["hot"]): (r["total"], r["seen"], [r[f"m{i}"] for i in range(CUTOFF)]) for r in sums}))
    if keep:
        spark.createDataFrame([(buckets, order)], "buckets long, order long").coalesce(1).write.parquet(f"{save_to}/meta")
    return by_slice().applyInArrow(_score_slice(folder, uni, levels, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
