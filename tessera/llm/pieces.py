"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the model's agenda: candidate merges wait in a queue by score, then position. When a
candidate comes up, a hash keyed by (seed, document, position of the chunk, span) may skip it; the rest of the
agenda goes on. A skipped merge never loses text, so every segmentation decodes to the same text. A span is skipped
or not once and for all, also if it comes up again by another split.

The symbols are cut beforehand where no piece of the vocabulary can reach across (before a run of spaces, and
around line feeds if no piece holds one). Every occurrence of a chunk makes its own choices. What is remembered is
a tree of agendas for each distinct chunk: the root is the agenda without skips, with its merges in order; an
occurrence tests them by its own hashes, and its first skip leads to the child agenda in which that span is skipped,
whose later merges are tested in turn. So occurrences that skip the same spans share the work, and no others.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import re
import sys
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import _mixed
from .tokens import tokenizer_path
from .util import crc32_py

DROPOUT, SEED = 0.1, 20240917
#: Agendas beyond which a batch begins anew, and at most at any time (what needs a further one runs its own); chunks of more characters than CHUNK_CHARS run their agenda at every occurrence.
MEMO_AGENDAS, MEMO_MOST, CHUNK_CHARS = 500_000, 650_000, 48
#: Texts are encoded in batches of so many documents or characters, whichever is less (a longer text is one batch).
BATCH_DOCS, BATCH_CHARS = 1000, 1_700_000
_SPAN, _STIR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ALL = 2**64 - 1
_PAD = -(1 << 30)
_WIDTHS = np.array([6, 10, 14, 20, 32, CHUNK_CHARS])
SPACE = "▁"

_loaded: dict[tuple, "PieceCodec"] = {}


class PieceCodec:
    """Encoder and decoder for one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, self.limit = dropout, seed, int(dropout * 2**32)
        n = sp.get_piece_size()
        self.piece: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.out: list[bytes] = [b""] * n
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_id[value], self.out[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[text] = (-sp.get_score(i), i)
                self.out[i] = text.replace(SPACE, " ").encode()
        # Every way to join two pieces to a third: (left id, right id) to the rank of the result by score.
        ranked = sorted(self.piece.values())
        self.of_rank, self.none = [i for _, i in ranked], len(ranked)
        rank = {i: r for r, i in enumerate(self.of_rank)}
        ids = {p: i for p, (_, i) in self.piece.items()}
        self.merge = {(ids[p[:k]], ids[p[k:]]): rank[i] for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.char = {p: i for p, i in ids.items() if len(p) == 1 and p != SPACE} | ({" ": ids[SPACE]} if SPACE in ids else {})
        if len(self.byte_id) < 256:
            raise ValueError("the model has no byte fallback, so decoding would not be lossless")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece):
            raise ValueError("a piece reaches across a word border")
        lines = not any("\n" in p for p in self.piece)
        self.cut = re.compile("\n| *[^ \n]+| +" if lines else " *[^ ]+| +")
        self._forget()
        # The same as an open hash table for arrays: keys left << 20 | right, at the first free slot from their hash on.
        keys = np.array([a << 20 | b for a, b in self.merge], dtype=np.int64)
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        self.slot_keys = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.slot_ranks = np.full(len(self.slot_keys), self.none, dtype=np.int32)
        ranks, slot = np.array(list(self.merge.values()), dtype=np.int32), self._slot(keys)
        while len(keys):
            free = self.slot_keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.slot_keys[slot[taken]], self.slot_ranks[slot[taken]] = keys[taken], ranks[taken]
            left = np.ones(len(keys), dtype=bool)
            left[taken] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) % len(self.slot_keys)
        self.rank_ids = np.array(self.of_rank, dtype=np.int64)
        self.char_table = -np.arange(0x110000, dtype=np.int64) - 1
        for c, i in self.char.items():
            self.char_table[ord(c)] = i

    def _symbols(self, chunk: str) -> list[int]:
        """Ids of single characters; those outside the vocabulary are negative and never merge. U+2581 in the
        text itself stays apart from the space marker: it is written in bytes."""
        get = self.char.get
        return [get(c) or -ord(c) - 1 for c in chunk]

    def _ids(self, symbols) -> bytes:
        ids: list[int] = []
        for s in symbols:
            if s >= 0:
                ids.append(s)
            else:
                ids += [self.byte_id[b] for b in chr(-s - 1).encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def _forget(self) -> None:
        """An empty forest of agendas: chunk, skipped spans, ids and merges (a run of the flat arrays) of each."""
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.node_chunk: list[str] = []
        self.node_skips: list[tuple[int, ...]] = []
        self.node_ids: list[bytes] = []
        self.run_start, self.run_length = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.spans, self.used = np.zeros(8192, dtype=np.int64), 0

    def skips(self, key, start, end):
        """Whether the occurrence with this key skips the span: arrays of unsigned 64-bit integers."""
        with np.errstate(over="ignore"):
            x = (key ^ ((start << np.uint64(32) | end) * np.uint64(_SPAN))) * np.uint64(_STIR)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(_STIR)
        return (x >> np.uint64(32)) < np.uint64(self.limit)

    def _skips_one(self, key: int, start: int, end: int) -> bool:
        x = (key ^ ((start << 32 | end) * _SPAN & _ALL)) * _STIR & _ALL
        x = (x ^ x >> 32) * _STIR & _ALL
        return x >> 32 < self.limit

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(_SPAN)) >> self.shift).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols; ``none`` if no piece is their text."""
        k = np.where((a >= 0) & (b >= 0), (a << 20) | b, np.int64(1) << 62).ravel()
        slot = self._slot(k)
        found = self.slot_keys[slot]
        out = np.where(found == k, self.slot_ranks[slot], np.int32(self.none))
        open_ = np.flatnonzero((found != k) & (found >= 0))
        while len(open_):
            at = slot[open_] = (slot[open_] + 1) % len(self.slot_keys)
            found = self.slot_keys[at]
            hit = found == k[open_]
            out[open_[hit]] = self.slot_ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(a.shape)

    def _grow(self, chunks: list[str], skips: list[tuple[int, ...]] | None = None) -> range:
        """Adds the agendas of chunks (and their skipped spans) to the forest; their numbers."""
        at, n = len(self.node_ids), len(chunks)
        out: list[bytes] = [b""] * n
        owner, span = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        width = _WIDTHS[np.searchsorted(_WIDTHS, size)]
        for w in _WIDTHS:
            members = np.flatnonzero(width == w)
            for m in range(0, len(members), 20_000):
                mine = members[m : m + 20_000]
                picked = mine.tolist()
                who, what = self._matrix(int(w), mine, size[mine], [chunks[k] for k in picked], [skips[k] for k in picked] if skips else None, out)
                owner.append(who)
                span.append(what)
        self.node_chunk += chunks
        self.node_skips += skips or [()] * n
        self.node_ids += out
        who = np.concatenate(owner)
        flat, length = np.concatenate(span)[np.argsort(who, kind="stable")], np.bincount(who, minlength=n)
        while len(self.run_start) < at + n:
            self.run_start, self.run_length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.run_start, self.run_length))
        while len(self.spans) < self.used + len(flat):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.run_length[at : at + n], self.run_start[at : at + n] = length, self.used + np.cumsum(length) - length
        self.spans[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return range(at, at + n)

    def _settle(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The agenda that each occurrence (its chunk's root, its key) ends in; -1 where the memo had no room for it."""
        node, open_ = node.copy(), np.flatnonzero(self.run_length[node])
        while len(open_):
            here = node[open_]
            count = self.run_length[here]
            begin = np.cumsum(count) - count
            of = np.repeat(np.arange(len(open_)), count)
            place = np.arange(len(of)) - np.repeat(begin, count)
            span = self.spans[np.repeat(self.run_start[here], count) + place].view(np.uint64)
            hit = np.flatnonzero(self.skips(np.repeat(key[open_], count), span >> np.uint64(6), span & np.uint64(63)))
            who = of[hit]
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else who
            who = who[first]
            step = here[who] << 6 | place[hit[first]]
            ways, back = np.unique(step, return_inverse=True)
            to = list(map(self.child.get, ways.tolist()))
            lacking = [k for k, x in enumerate(to) if x is None]
            room = max(0, MEMO_MOST - len(self.node_ids))
            for k in lacking[room:]:
                to[k] = -1
            lacking = lacking[:room]
            if lacking:
                new = ways[lacking]
                parent = new >> 6
                last = self.spans[self.run_start[parent] + (new & 63)].tolist()
                parent = parent.tolist()
                grown = self._grow([self.node_chunk[p] for p in parent], [(*self.node_skips[p], x) for p, x in zip(parent, last, strict=True)])
                self.child.update(zip(new.tolist(), grown, strict=True))
                for k, x in zip(lacking, grown, strict=True):
                    to[k] = x
            open_ = open_[who]
            node[open_] = np.array(to, dtype=np.int64)[back]
            open_ = open_[node[open_] >= 0]
            open_ = open_[self.run_length[node[open_]] > 0]
        return node

    def _matrix(self, width: int, members: np.ndarray, size: np.ndarray, chunks: list[str], skips: list[tuple[int, ...]] | None, out: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many agendas at once: every row of a matrix is one. A round takes each row's best candidate (best rank,
        then leftmost), which is dropped if its span is among the row's skipped ones, and merged if not. Returned are
        the merges after the last skip, in order: the agenda and start << 6 | end."""
        n, pad, none = len(chunks), _PAD, self.none
        free = np.full(n, skips is None)  # whether the last skip is behind
        if skips is not None:
            depth = np.fromiter(map(len, skips), dtype=np.int64, count=n)
            skipped = np.full((n, int(depth.max())), -1, dtype=np.int64)
            skipped[np.arange(skipped.shape[1])[None, :] < depth[:, None]] = np.fromiter(itertools.chain.from_iterable(skips), dtype=np.int64)
            last = skipped[np.arange(n), depth - 1]
        log_row, log_span = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        place = np.arange(width + 1)
        sym = np.full((n, width + 1), pad, dtype=np.int32)
        text = "".join(chunks)
        sym[place[None, :] < size[:, None]] = self.char_table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        start = np.tile(np.arange(width + 2, dtype=np.int16), (n, 1))
        rank = self._ranks(sym[:, :-1].astype(np.int64), sym[:, 1:].astype(np.int64)).astype(np.int32)
        done = np.full((n, width + 1), pad, dtype=np.int32)
        live = np.arange(n)
        while len(live):
            row = np.arange(len(live))
            col = rank.argmin(axis=1)
            best = rank[row, col]
            act = best < none
            if np.count_nonzero(act) < 0.7 * len(live):
                done[live[~act]] = sym[~act]
                live, sym, start, rank = live[act], sym[act], start[act], rank[act]
                continue
            span = start[row, col].astype(np.int64) << 6 | start[row, col + 2]
            if skips is not None:
                skip = act & (skipped[live] == span[:, None]).any(axis=1)
                free[live] |= skip & (span == last[live])
                rank[row[skip], col[skip]] = none
                act &= ~skip
            logged = act & free[live]
            log_row.append(live[logged])
            log_span.append(span[logged])
            # the merged pair's right symbol goes: what is behind it moves up by one
            c = np.where(act, col, width + 2)[:, None]
            behind = place[None, :] > c
            np.copyto(sym[:, :-1], sym[:, 1:], where=behind[:, :-1])
            np.copyto(start[:, :-1], start[:, 1:], where=behind)
            np.copyto(rank[:, :-1], rank[:, 1:], where=place[None, : width - 1] >= c)
            row, col, best = row[act], col[act], best[act]
            rank[row, -1] = none
            sym[row, col] = self.rank_ids[best]
            around = [(row, col)]
            left = col > 0
            around.append((row[left], col[left] - 1))
            for r, k in around:
                fits = k < width
                r, k = r[fits], k[fits]
                rank[r, k] = self._ranks(sym[r, k].astype(np.int64), sym[r, k + 1].astype(np.int64))
        valid = done != pad
        odd = ((done < 0) & valid).any(axis=1)
        flat = done[valid & ~odd[:, None]].astype("<u4").tobytes()
        ends = np.cumsum(np.where(odd, 0, valid.sum(axis=1))) * 4
        begin = 0
        for k, e, o, r in zip(members.tolist(), ends.tolist(), odd.tolist(), range(n), strict=True):
            out[k] = self._ids(done[r][valid[r]].tolist()) if o else flat[begin:e]
            begin = e
        if not self.limit:
            return log_row[0], log_span[0]
        return members[np.concatenate(log_row)], np.concatenate(log_span)

    def _long(self, sym: list, key: int) -> bytes:
        """One occurrence's agenda as a queue, for chunks of any length."""
        n, merge, limit = len(sym), self.merge.get, self.limit
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        agenda = [(r, i, i + 1, end[i + 1]) for i in range(n - 1) if (r := merge((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, j, e = heapq.heappop(agenda)
            if sym[i] is None or sym[j] is None or nxt[i] != j or end[j] != e or merge((sym[i], sym[j])) != r:
                continue
            if limit and self._skips_one(key, i, e):
                continue
            sym[i], sym[j], end[i] = self.of_rank[r], None, e
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (x := merge((sym[i], sym[k]))) is not None:
                    heapq.heappush(agenda, (x, i, k, end[k]))
            p = prv[i]
            if p >= 0 and (x := merge((sym[p], sym[i]))) is not None:
                heapq.heappush(agenda, (x, p, i, e))
        return self._ids(s for s in sym if s is not None)

    def encode_many(self, texts: list[str | None], keys: list) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; null and empty texts have none. ``keys``
        tell the documents apart: equal (key, text) have equal ids."""
        collecting = gc.isenabled()
        gc.disable()  # a batch makes many small objects and no cycles
        try:
            return self._encode_batch(texts, keys)
        finally:
            if collecting:
                gc.enable()

    def _encode_batch(self, texts: list[str | None], keys: list) -> list[bytes]:
        if len(self.node_ids) >= MEMO_AGENDAS:
            self._forget()
        cut = [self.cut.findall(" " + t) if t else [] for t in texts]
        chunks, cuts = list(itertools.chain.from_iterable(cut)), np.cumsum([0, *map(len, cut)])
        nodes = list(map(self.root.get, chunks))
        long: list[int] = []
        if None in nodes:
            lacking = list(dict.fromkeys(c for c, r in zip(chunks, nodes, strict=True) if r is None and len(c) <= CHUNK_CHARS))
            lacking = lacking[: max(0, MEMO_MOST - len(self.node_ids))]
            if lacking:
                self.root.update(zip(lacking, self._grow(lacking), strict=True))
            nodes = list(map(self.root.get, chunks))
            long = [k for k, r in enumerate(nodes) if r is None]
        place = np.arange(len(chunks)) - np.repeat(cuts[:-1], np.diff(cuts))
        begin = np.array([xxhash.xxh64_intdigest(str(key).encode(), self.seed) for key in keys], dtype=np.uint64)
        with np.errstate(over="ignore"):
            occurrence = _mixed(place.astype(np.uint64) + np.repeat(begin, np.diff(cuts)))
        special = {k: self._long(self._symbols(chunks[k]), int(occurrence[k])) for k in long}
        if self.limit and chunks:
            for k in long:
                nodes[k] = -1
            flat = np.array(nodes, dtype=np.int64)
            short = np.flatnonzero(flat >= 0)
            flat[short] = self._settle(flat[short], occurrence[short])
            nodes = flat.tolist()
            special |= {k: self._long(self._symbols(chunks[k]), int(occurrence[k])) for k in short[flat[short] < 0].tolist()}
        ids = self.node_ids
        parts = [special[k] if k in special else ids[r] for k, r in enumerate(nodes)] if special else list(map(ids.__getitem__, nodes))
        ends = cuts.tolist()
        return [b"".join(parts[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, text: str | None, doc_key: int | str | None = None) -> bytes:
        return self.encode_many([text], [doc_key])[0]

    def decode(self, ids) -> str:
        """The text of ids (any integers of the vocabulary); control ids are empty."""
        out = self.out
        data = b"".join(map(out.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@contextmanager
def task_codec(model: str, dropout: float, seed: int):
    """The process's codec for one task; what it remembers goes with the task, so that an idle worker holds none of it."""
    c = codec(model, dropout, seed)
    try:
        yield c
    finally:
        c._forget()


def batches(texts: list[str | None]):
    """(first, end) of runs of texts within the batch bounds."""
    first = chars = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and (k - first >= BATCH_DOCS or chars + n > BATCH_CHARS):
            yield first, k
            first, chars = k, 0
        chars += n
    if first < len(texts):
        yield first, len(texts)


def codec(model: str, dropout: float, seed: int) -> PieceCodec:
    key = (model, dropout, seed)
    if key not in _loaded:
        _loaded[key] = PieceCodec(tokenizer_path(model), dropout, seed)
    return _loaded[key]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", *, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` with a column of piece ids (array<int>) behind it; one pass, no shuffle.

    Null and empty texts have no ids. dropout 0 is the model's own segmentation. Equal (seed, id, text) rows
    get equal ids. A column named ``out_col`` is replaced; all others stay as they are.
    """
    docs = docs.drop(out_col)
    t, i = docs.columns.index(text_col), docs.columns.index(id_col)

    def encoded(c, it):
        for b in it:
            texts, keys = b.column(t).to_pylist(), b.column(i).to_pylist()
            for first, end in batches(texts):
                part = b.slice(first, end - first)
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in c.encode_many(texts[first:end], keys[first:end])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*part.schema.names, out_col])

    def run(it):
        with task_codec(model, dropout, seed) as c:
            yield from encoded(c, it)

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def decode_pieces(rows: DataFrame, model: str = "piece_bpe_32k.model", *, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id array behind it; a null array has a null text."""
    from pyspark.sql import types as T

    rows = rows.drop(out_col)
    at = rows.columns.index(ids_col)

    def run(it):
        c = codec(model, 0.0, SEED)
        for b in it:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                texts = [None if x is None else c.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def piece_digest(docs: DataFrame, model: str = "piece_bpe_32k.model", *, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: ``doc_id, n_pieces, ids_crc32, text_crc32, lossless``.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers; text_crc32: of the decoded text in UTF-8;
    lossless: the decoded text equals the text (null: empty).
    """

    def digests(c, it):
        for b in it:
            rows, all_texts, keys = [], [x or "" for x in b.column(1).to_pylist()], b.column(0).to_pylist()
            for first, end in batches(all_texts):
                texts = all_texts[first:end]
                for text, ids in zip(texts, c.encode_many(texts, keys[first:end]), strict=True):
                    back = c.decode(np.frombuffer(ids, dtype="<u4").tolist())
                    rows.append((len(ids) // 4, crc32_py(ids), crc32_py(back.encode()), back == text))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    def run(it):
        with task_codec(model, dropout, seed) as c:
            yield from digests(c, it)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
