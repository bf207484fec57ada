"""Divergence of sources within a language, by rotating compressed count vectors past resident groups.

A (lang, source) group is a vector of counts over its language's kept terms. Vectors are cut into blocks of terms
and compressed. Groups sit in teams; in each round of a round-robin tournament every team hosts, or visits, one
other team. Hosts stay in their partition with their vectors opened, visitors stream past in the order of the
rounds, and each meeting is evaluated for both sides. A group's most over-used terms are ranked by bounded heaps
in the tasks that read the counts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import fresh_path, materialize, write_parquet

MIN_DOCS, TOP, SHARE, EXTRA = 30, 50, 1_000_000_000, 5
#: Terms of a block, groups of a team at most, teams wanted (more where a team is full), rounds that one job streams.
TERM_BLOCK, TEAM, TEAMS, ROUNDS = 4096, 64, 16, 16
#: Entries of a task's counts, and heaps, before they are sent on.
FLUSH, HEAPS = 400_000, 10_000

#: Bytes of a text in UTF-8: letters are lower-cased, bytes from 0x80 kept, all others become spaces.
_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and other characters from U+0080, A-Z lower-cased, in UTF-8."""
    return text.translate(_BYTES).split() if text else []


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exact for totals below 9 * 10^15: long division by
    thousands, so that no product leaves 64 bits."""
    below = np.maximum(np.asarray(total, dtype=np.int64) + EXTRA * np.asarray(kept, dtype=np.int64), 1)
    quotient, rest = np.divmod(np.asarray(count, dtype=np.int64) + EXTRA, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + digit
    return 1 + quotient


def _count(it):
    """Rows (lang, source, term, n, docs): a task's counts by group and term, sent on whenever they fill up."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        out = [(lang, source, t.decode(), k, docs[t]) for (lang, source), (n, docs) in held.items() for t, k in n.items()]
        for at in range(0, len(out), 50_000):
            part = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(part[c], type=pa.string()) for c in range(3)), *(pa.array(part[c], type=pa.int64()) for c in (3, 4))], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in it:
        texts = b.column(2).cast(pa.large_binary() if pa.types.is_large_string(b.column(2).type) else pa.binary())
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
            words = terms(text.as_py())
            if words:
                n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > FLUSH:
            yield from rows()
    yield from rows()


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: occurrences in the group and in the language of every term that is in
    at least ``min_docs`` of the language's documents; first marks one row of each term. ``docs``: lang, source, text
    without nulls in the first two. One shuffle, of rows that tasks have added up."""
    by_term = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    w = Window.partitionBy("lang", "term")
    found = by_term.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.select("lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("df"), (F.min("source").over(w) == F.col("source")).alias("first"))
    return materialize(found.where(F.col("df") >= min_docs).drop("df"), "terms")


def _numbered(docs: DataFrame, kept: DataFrame, team: int, teams: int) -> DataFrame:
    """One row a group: its and its language's totals, kept terms, number in the language, team and number of teams."""
    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    w = Window.partitionBy("lang")
    seats = F.least(F.lit(team).cast("long"), F.greatest(F.ceil(F.col("groups") / teams), F.lit(1).cast("long")))
    rows = docs.select("lang", "source").distinct().join(group, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    rows = rows.withColumn("groups", F.count("*").over(w)).withColumn("number", F.row_number().over(w.orderBy("source")) - 1).withColumn("seats", seats)
    return materialize(rows.select("lang", "source", "total", "lang_total", "kept", F.floor(F.col("number") / F.col("seats")).alias("team"), F.ceil(F.col("groups") / F.col("seats")).alias("teams")), "groups")


def _pack(it):
    """Compressed slices: sorted term numbers as steps, and counts, of a group's block."""
    for b in it:
        out = []
        for numbers, counts in zip(b.column("numbers"), b.column("counts"), strict=True):
            t = np.asarray(numbers.values if numbers.is_valid else [], dtype=np.int64)
            n = np.asarray(counts.values if counts.is_valid else [], dtype=np.int64)
            out.append(zlib.compress(np.concatenate([np.diff(t, prepend=0), n]).astype("<i8").tobytes(), 1))
        keep = [c for c in b.schema.names if c not in ("numbers", "counts")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, type=pa.binary())], [*keep, "slice"])


def _slices(kept: DataFrame, groups: DataFrame, term_block: int) -> DataFrame:
    """One compressed slice for every group and block of its language's terms, empty ones included."""
    blocks = F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1).cast("long"))
    lang = groups.groupBy("lang").agg(F.first("kept").alias("kept")).select("lang", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    words = kept.where("first").join(lang, "lang").select("lang", "term", block.alias("block"))
    words = materialize(words.withColumn("number", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "words")
    widths = words.groupBy("lang", "block").agg(F.count("*").alias("width"))
    rows = kept.join(words, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("pairs"))
    frame = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = frame.join(rows, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left")
    rows = rows.select("lang", "source", "total", "kept", "team", "teams", "block", F.coalesce("width", F.lit(0)).cast("long").alias("width"), F.col("pairs.number").alias("numbers"), F.col("pairs.n").alias("counts"))
    return materialize(rows.mapInArrow(_pack, "lang string, source string, total long, kept long, team long, teams long, block long, width long, slice binary"), "slices")


def partner(team, round_, teams):
    """The circle method: whom ``team`` meets in a round among ``teams`` teams (an even number), which is never itself;
    each pair of teams meets in exactly one of the ``teams`` - 1 rounds. Works on numbers; ``_visits`` states it in columns."""
    circle = teams - 1
    if team == circle:
        return round_
    other = (2 * round_ - team) % circle
    return circle if other == team else other


def _visits(slices: DataFrame, first: int, last: int) -> DataFrame:
    """The slices once for each of the rounds in which their team visits: host, round. Lower teams host in even rounds."""
    even = F.col("teams") + F.col("teams") % 2
    circle = even - 1
    other = F.pmod(2 * F.col("round") - F.col("team"), circle)
    meets = F.when(F.col("team") == circle, F.col("round")).when(other == F.col("team"), circle).otherwise(other)
    rows = slices.withColumn("round", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))).where(F.col("round") < circle)
    rows = rows.withColumn("host", meets).where((F.col("host") < F.col("teams")) & ((F.col("round") % 2 == 0) == (F.col("host") < F.col("team"))))
    return rows


def _meet(it):
    """Rows (lang, source, item, value) of every meeting. Input sorted by (lang, block, host, round): a host team comes
    first and sits down, with round -1 meeting its own members too; then its visitors pass one by one."""
    key, home, matrix, out = None, [], None, ([], [], [], [])

    def rows():
        batch = pa.RecordBatch.from_arrays([*(pa.array(out[c], type=pa.string()) for c in range(3)), pa.array(out[3], type=pa.int64())], ["lang", "source", "item", "value"])
        for c in out:
            c.clear()
        return batch

    for r in (r for b in it for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist()):
        if (r["lang"], r["block"], r["host"]) != key:
            key, home, matrix = (r["lang"], r["block"], r["host"]), [], np.zeros((0, r["width"]), dtype=np.int64)
        flat = np.frombuffer(zlib.decompress(r["slice"]), dtype="<i8")
        at, n = np.cumsum(flat[: len(flat) // 2]), flat[len(flat) // 2 :]
        row = np.full(r["width"], shares(0, r["total"], r["kept"]), dtype=np.int64)
        row[at] = shares(n, r["total"], r["kept"])
        if home and r["round"] > -2:
            value = np.abs(matrix[: len(home)] - row).sum(axis=1).tolist()
            out[0].extend([r["lang"]] * (2 * len(home)))
            out[1].extend([*home, *[r["source"]] * len(home)])
            out[2].extend([*[r["source"]] * len(home), *home])
            out[3].extend([*value, *value])
            if len(out[3]) > 50_000:
                yield rows()
        if r["round"] < 0:
            home.append(r["source"])
            if len(home) > len(matrix):
                matrix = np.concatenate([matrix, np.zeros((max(4, len(matrix)), r["width"]), dtype=np.int64)])
            matrix[len(home) - 1] = row
    yield rows()


def pair_values(slices: DataFrame, rounds: int, at_once: int = ROUNDS) -> DataFrame:
    """``lang, source, item, value`` for all ordered pairs of groups of a language, a row for each block of terms.
    One job streams ``at_once`` rounds past the residents and writes what they give, so that neither the shuffle
    nor what a lost executor costs grows with the number of rounds."""
    spark, path = slices.sparkSession, fresh_path(slices.sparkSession, "meetings")
    for first in range(0, max(rounds, 1), at_once):
        seats = slices.withColumn("round", F.lit(-1 if first == 0 else -2).cast("long")).withColumn("host", F.col("team"))
        seated = seats.unionByName(_visits(slices, first, first + at_once - 1)).repartition("lang", "block", "host")
        met = seated.sortWithinPartitions("lang", "block", "host", "round", "source").mapInArrow(_meet, "lang string, source string, item string, value long")
        write_parquet(met, f"{path}/step={first}")
    return spark.read.parquet(path).drop("step")


def _heaps(top: int):
    """Rows (lang, source, item, value): per group the ``top`` largest shares above the language's that a task has read."""

    def run(it):
        held: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def rows():
            flat = [(lang, source, item, -value) for (lang, source), heap in held.items() for value, item in heap]
            held.clear()
            cols = list(zip(*flat, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(cols[c], type=pa.string()) for c in range(3)), pa.array(cols[3], type=pa.int64())], ["lang", "source", "item", "value"])

        for b in it:
            n, lang_n, total, lang_total, kept = (np.asarray(b.column(c), dtype=np.int64) for c in range(3, 8))
            value = shares(n, total, kept) - shares(lang_n, lang_total, kept)
            use = np.flatnonzero((value > 0) & (n > 0))
            new: dict[tuple[str, str], list[tuple[int, str]]] = {}
            part = b.take(pa.array(use))
            for lang, source, item, v in zip(*(part.column(c).to_pylist() for c in range(3)), value[use].tolist(), strict=True):
                new.setdefault((lang, source), []).append((-v, item))
            for k, v in new.items():
                held[k] = heapq.nsmallest(top, held.get(k, []) + v)
            if len(held) > HEAPS:
                yield rows()
        yield rows()

    return run


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, term_block: int = TERM_BLOCK, team: int = TEAM, teams: int = TEAMS, at_once: int = ROUNDS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which
    terms it differs from the language.

    Null text, lang and source count as ''. Terms are maximal runs of ASCII letters and characters from U+0080, A-Z
    lower-cased; a language keeps those in at least ``min_docs`` of its documents (rows; repeated rows count as
    often as they occur). A term's share in a group is 1 + floor(10^9 * (n + 5) / (N + 5 V)), n its occurrences, N all
    of kept terms, V the kept terms. Part ``pair``: every other source of the language, value the sum of
    differences of shares over all kept terms, 0 where there are none; all ranks. Part ``term``: the group's terms
    with a share above the language's, value the difference; ``top`` ranks. Ranks go by value downwards, then by
    item in UTF-8 order. Groups without terms take part with zeros. All numbers are exact integers, for totals below
    9 * 10^15. An empty table gives no rows.

    Plan: one scan of the texts, which tasks add up by (group, term) before the only shuffle of terms; slices of at
    most about ``term_block`` terms of a group move after that. A partition holds one team's slices of one block
    opened, and one visitor. Pairs are quadratic in the sources of a language by nature of the result.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    kept = kept_counts(read, min_docs)
    groups = _numbered(read.select("lang", "source"), kept, team, teams)
    most = groups.agg(F.max("teams")).first()[0] or 0
    if not most:
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    pairs = pair_values(_slices(kept, groups, term_block), most + most % 2 - 1, at_once).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    shared = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", "total", "lang_total", "kept")
    over = shared.mapInArrow(_heaps(top), "lang string, source string, item string, value long")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    over = over.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY lang, source, term
), k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS ln FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS n FROM f GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT f.lang, f.source, f.term, f.n,
         1 + (CAST(1000000000 AS HUGEINT) * (f.n + 5)) // (t.n + 5 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (f.ln + 5)) // (v.n + 5 * v.v) AS q
  FROM f JOIN t USING (lang, source) JOIN v USING (lang)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  GROUP BY g.lang, g.source, h.source
), o AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
