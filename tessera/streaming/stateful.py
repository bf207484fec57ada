"""Streaming operators with state of their own: a bounded shuffle buffer, and groups of responses that complete."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    """Rows as an Arrow stream, so that every Spark type survives in the state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_table(pa.Table.from_pandas(frame, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas(date_as_object=True)


def shuffle_buffer(rows: DataFrame, size: int, *key: str, seed: int = 0, buffers: int = 8, end: Column | None = None) -> DataFrame:
    """A stream in shuffled order: rows fill a buffer of ``size``; from then on every arrival takes a drawn row's place,
    and that row leaves.

    Buffers are ``buffers`` keys of state, each of ``size // buffers`` rows, to which rows are dealt by a hash of
    ``key``. Within a micro-batch a buffer's rows arrive in the order of a seeded hash of ``key``, and the place of an
    arrival is a hash of the seed and its number, so that a batch that is run again after a failure leaves the same
    rows. A row leaves once, never before it arrives, and the state never holds more than ``size`` rows.
    ``end`` marks rows that are no data but end an epoch: each empties every buffer in drawn order. Without one
    the buffers keep their last rows, as a stream that does not end should.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, per = rows.schema, max(1, size // buffers)
    arrow = to_arrow_schema(schema)
    mark = F.lit(False) if end is None else F.coalesce(end, F.lit(False))
    own = F.array(F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(buffers)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buffers - 1))
    dealt = rows.withColumn("__end", mark).withColumn("__order", F.xxhash64(F.lit(seed), *key)).withColumn("__buffer", F.explode(F.when(F.col("__end"), every).otherwise(own)))

    def draw(number: int, n: int) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(number.to_bytes(8, "little"), seed & (2**64 - 1)) % n

    def run(_, frames, state: GroupState):
        held, seen = (_unpacked(state.get[0]), state.get[1]) if state.exists else (None, 0)
        arrived = pd.concat(list(frames), ignore_index=True).sort_values(["__end", "__order"], kind="stable")
        ends = bool(arrived["__end"].any())
        new = arrived.loc[~arrived["__end"], schema.names].reset_index(drop=True)
        whole = new if held is None else pd.concat([held, new], ignore_index=True) if len(new) else held
        places, out = list(range(0 if held is None else len(held))), []
        for at in range(len(places), len(whole)):
            seen += 1
            if len(places) < per:
                places.append(at)
            else:
                k = draw(seen, per)
                out.append(places[k])
                places[k] = at
        if ends:  # the rest in drawn order
            for n in range(len(places), 0, -1):
                seen += 1
                k = draw(seen, n)
                places[k], places[n - 1] = places[n - 1], places[k]
                out.append(places.pop())
        if places:
            state.update((_packed(whole.iloc[places], arrow), seen))
        else:
            state.update((_packed(whole.iloc[:0], arrow), seen))
        yield whole.iloc[out].reset_index(drop=True)

    return dealt.groupBy("__buffer").applyInPandasWithState(run, schema, "rows binary, seen long", "append", GroupStateTimeout.NoTimeout)


def merged_moments(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """(count, mean, M2) of two sets together; M2 is the sum of squared deviations."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def completed_groups(rows: DataFrame, uid: str, ident: str, score: str, size: str, *, timeout: str | None = None, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """Group-relative advantages of a stream: ``uid, ident, score, advantage, complete, late``.

    The responses of a prompt (rows of equal ``uid``) wait in the state with their count, mean and M2, which every
    micro-batch merges with its own, until as many as the column ``size`` says have arrived; then they leave
    with (score - mean) / (sample std + eps), as the batch estimator gives. With ``timeout`` (say "10 minutes", of
    processing time since the last arrival) an incomplete group leaves as it is (``complete`` false). What arrives for a
    group that has left comes out alone with a null advantage and the number of late ones so far in ``late``. Null
    scores count as arrived, and have no part in the moments and no advantage. A group left by a timer is forgotten
    at the next timer, a complete one too, if there is a timeout.
    """
    kinds = dict(rows.select(uid, ident).dtypes)
    schema = f"`{uid}` {kinds[uid]}, `{ident}` {kinds[ident]}, score double, advantage double, complete boolean, late long"
    wait = None if timeout is None else timeout

    def released(key, ids, scores, moments, complete):
        n, mean, m2 = moments
        std = 1.0 if n <= 1 else math.sqrt(m2 / (n - 1))
        if n <= 1:
            mean = 0.0
        adv = [None if s is None else (s - mean) / (std + eps) if by_std else s - mean for s in scores]
        return pd.DataFrame({uid: [key] * len(ids), ident: ids, "score": pd.array(scores, dtype="Float64"), "advantage": pd.array(adv, dtype="Float64"), "complete": complete, "late": 0})

    def run(key, frames, state: GroupState):
        ids, scores, moments, done, late = ([], [], (0, 0.0, 0.0), False, 0)
        if state.exists:
            kept_ids, kept, n, mean, m2, done, late = state.get
            ids, scores, moments = list(kept_ids), list(kept), (n, mean, m2)
        if state.hasTimedOut:
            if not done and ids:
                yield released(key[0], ids, scores, moments, False)
                state.update(([], [], 0, 0.0, 0.0, True, 0))
                state.setTimeoutDuration(wait)
            else:
                state.remove()
            return
        arrived = pd.concat(list(frames), ignore_index=True).sort_values(ident, kind="stable")
        mine = [None if pd.isna(s) else float(s) for s in arrived["__score"]]
        if done:
            late += len(arrived)
            yield pd.DataFrame({uid: [key[0]] * len(arrived), ident: arrived[ident].tolist(), "score": pd.array(mine, dtype="Float64"), "advantage": pd.array([None] * len(arrived), dtype="Float64"), "complete": False, "late": range(late - len(arrived) + 1, late + 1)})
            ids, scores = [], []
        else:
            known = [s for s in mine if s is not None]
            mean = sum(known) / len(known) if known else 0.0
            moments = merged_moments(moments, (len(known), mean, sum((s - mean) ** 2 for s in known)))
            ids, scores = [*ids, *arrived[ident].tolist()], [*scores, *mine]
            if len(ids) >= int(arrived["__size"].iloc[-1]):
                yield released(key[0], ids, scores, moments, True)
                ids, scores, moments, done = [], [], (0, 0.0, 0.0), True
        state.update((ids, scores, *moments, done, late))
        if wait is not None:
            state.setTimeoutDuration(wait)

    picked = rows.select(uid, ident, F.col(score).cast("double").alias("__score"), F.col(size).alias("__size"))
    held = f"ids array<{kinds[ident]}>, scores array<double>, n long, mean double, m2 double, done boolean, late long"
    kind = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return picked.groupBy(uid).applyInPandasWithState(run, schema, held, "append", kind)
