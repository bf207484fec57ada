"""Mixing, sampling, splits and ordered selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .permute import drawn
from .selection import among_smallest, hex_value, smallest


def seeded(seed: int, *columns: str) -> Column:
    """A reproducible random order: a hash of the seed and the row's key."""
    return F.xxhash64(F.lit(seed), *columns)


def shuffled(seed: int, *columns: str) -> Column:
    """A reproducible random order that SQL can restate: the MD5 of the seed and the row's key as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def interleave(parts: list[DataFrame], order: str, *, stop: str = "first", probabilities: list[float] | None = None, seed: int = 0) -> DataFrame:
    """Rows of the parts in turn with their ``part`` and ``turn``; ``order`` is each part's dense position.

    stop ``first``: until the shortest part ends; ``all``: until the longest does, shorter ones starting over.
    With probabilities every turn draws its part (:func:`interleave_drawn`).
    """
    if probabilities is not None:
        return interleave_drawn(parts, order, probabilities, stop=stop, seed=seed)
    sizes = [p.count() for p in parts]
    k = min(sizes) if stop == "first" else max(sizes)
    out = []
    for i, (p, n) in enumerate(zip(parts, sizes, strict=True)):
        if not n:
            continue
        times = -(-k // n)
        r = p.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(max(times, 1) - 1)))).withColumn("turn", F.col(order) + F.col("__c") * n).where(F.col("turn") < k).drop("__c")
        out.append(r.withColumn("part", F.lit(i)))
    return reduce(DataFrame.unionByName, out)


def choice(seed: int, turn: Column, probabilities: list[float]) -> Column:
    """The part that a turn draws: where 32 bits of the MD5 of seed and turn fall among the cumulated probabilities. It
    depends on the turn alone, so that any turn can be computed without those before it."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), turn.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, at, out = sum(probabilities), 0.0, None
    live = [i for i, q in enumerate(probabilities) if q > 0]
    for i in live[:-1]:
        at += probabilities[i] / total
        out = F.when(u < at, i) if out is None else out.when(u < at, i)
    return F.lit(live[-1]) if out is None else out.otherwise(live[-1])


def interleave_drawn(parts: list[DataFrame], order: str, probabilities: list[float], *, stop: str = "first", seed: int = 0, block: int = 65_536) -> DataFrame:
    """Every turn draws a part by its probability and takes the part's next row: the rows with ``part`` and ``turn``.

    A part that has given all its rows starts over. stop ``first``: the last turn is the one in which some part gives its
    last row; ``all``: the one in which the last of the parts does so for the first time. Parts of probability 0 give
    nothing and stop nothing. An empty part of positive probability ends ``first`` before it begins and is an error
    for ``all``.

    Choices are a function of the turn. Turns are counted in blocks by part; a block's offset is the count of those
    before it, so that a turn's row is found from its rank in its block, and the last turn from the block in which a
    part's last row falls. No sequence of choices is made in one place.
    """
    if len(probabilities) != len(parts) or not any(q > 0 for q in probabilities) or any(q < 0 for q in probabilities):
        raise ValueError("one probability a part, none negative, not all zero")
    spark, sizes = parts[0].sparkSession, [p.count() for p in parts]
    live = [i for i, q in enumerate(probabilities) if q > 0]
    numbered = [p.withColumn("part", F.lit(i)).withColumn("__at", F.col(order).cast("long")) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, numbered)
    if any(not sizes[i] for i in live):
        if stop == "all":
            raise ValueError("an empty part never gives its last row")
        return rows.drop("__at").withColumn("turn", F.lit(0).cast("long")).limit(0)
    share = {i: probabilities[i] / sum(probabilities) for i in live}
    expected = [sizes[i] / share[i] for i in live]
    blocks = int((min if stop == "first" else max)(expected) * 1.1) // block + 2
    want = spark.createDataFrame([(i, sizes[i]) for i in live], "part int, size long")

    def turns(first: int, last: int) -> DataFrame:
        t = spark.range(first, last).select(F.col("id").alias("turn"), F.call_function("div", F.col("id"), F.lit(block).cast("long")).alias("block"))
        return t.withColumn("part", choice(seed, F.col("turn"), probabilities))

    while True:
        before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
        counts = turns(0, blocks * block).groupBy("part", "block").agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ends = counts.join(F.broadcast(want), "part").where((F.col("before") < F.col("size")) & (F.col("before") + F.col("n") >= F.col("size"))).select("part", "block", "before", "size").collect()
        if len(ends) == len(live) or (ends and stop == "first"):
            break
        blocks *= 2
    if stop == "first":  # the blocks in which a part can be the first
        ends = [r for r in ends if r.block == min(e.block for e in ends)]
    else:
        ends = [r for r in ends if r.block == max(e.block for e in ends)]
    last = []
    for r in ends:
        at = turns(r.block * block, (r.block + 1) * block).where(F.col("part") == r.part).orderBy("turn").offset(r.size - r.before - 1).limit(1).first()
        last.append(at.turn + 1)
    stopped = (min if stop == "first" else max)(last)
    in_block = Window.partitionBy("part", "block").orderBy("turn")
    t = turns(0, stopped).withColumn("rank", F.row_number().over(in_block) - 1).join(counts.select("part", "block", "before"), ["part", "block"]).join(F.broadcast(want), "part")
    t = t.select("turn", F.col("part").alias("__part"), F.pmod(F.col("before") + F.col("rank"), F.col("size")).alias("__row"))
    return rows.join(t, (F.col("part") == F.col("__part")) & (F.col("__at") == F.col("__row"))).drop("__part", "__row", "__at")


def exact_sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Exactly n rows: a seeded permutation, with the rows repeated in order once all are used (``copy``)."""
    total = rows.count()
    if not total:
        return rows.withColumn("copy", F.lit(0))
    copies, rest = divmod(n, total)
    mixed = rows.withColumn("__m", shuffled(seed, *key))
    top = smallest(mixed, rest, hex_value(F.col("__m")), "__m", *key).drop("__m").withColumn("copy", F.lit(copies))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).unionByName(top) if copies else top


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Data sets one behind the other, with their ``part``."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` rows by position; all of them without a bound."""
    return rows if most is None else rows.where(F.col(order) < most)


def eval_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """Named evaluation sets as one table: ``split`` is ``validation_<name>``; columns that a set lacks are null."""
    parts = [df.withColumn("split", F.lit(f"validation_{name}")) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def appended(rows: DataFrame, generated: DataFrame, keep: Column, *key: str) -> DataFrame:
    """A growing data set after a batch: its rows and the generated ones that pass the filter and whose key is new; of
    generated rows with equal keys the first by content stays."""
    fresh = generated.where(F.coalesce(keep, F.lit(False))).join(rows.select(*key), list(key), "left_anti")
    fresh = fresh.groupBy(*key).agg(F.min(F.struct(*(c for c in generated.columns if c not in key))).alias("__r")).select(*key, "__r.*")
    return rows.unionByName(fresh.select(*rows.columns))


def group_index(rows: DataFrame, group: list[str], order: list[Column | str], name: str, parts: int = 256) -> DataFrame:
    """Adds a dense 0-based position inside each group, in the order of a part (the first 28 bits of the MD5 of ``order``
    as text, modulo ``parts``) and then of ``order``: groups are numbered in parts and a part's offset is the size of
    those before it, so that a hot group is many tasks."""
    text = F.concat_ws("|", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in order))
    part = F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), F.lit(parts))
    dealt = rows.withColumn("__part", part)
    sizes = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*group, "__part").orderBy(*order)
    numbered = dealt.withColumn("__at", F.row_number().over(w) - 1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "__part"]]
    j = numbered.alias("a").join(sizes.alias("b"), reduce(lambda x, y: x & y, same))
    return j.select(*(f"a.{c}" for c in rows.columns), (F.col("a.__at") + F.col("b.__before")).cast("long").alias(name))


def hash_split(rows: DataFrame, size: float, *key: str) -> DataFrame:
    """Adds ``split``: validation for the rows of smallest md5 of the key; a size over 1 is a number of rows, under 1 a share."""
    h = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key)))
    n = int(size) if size > 1 else int(rows.count() * size)
    if n == 0:
        return rows.withColumn("split", F.lit("train"))
    marked = among_smallest(rows.withColumn("__m", h), "__taken", n, hex_value(F.col("__m")), "__m", *key)
    return marked.withColumn("split", F.when(F.col("__taken"), "validation").otherwise("train")).drop("__m", "__taken")


def preferred_sample(rows: DataFrame, prefer: Column, n: int, seed: int, *key: str) -> DataFrame:
    """n rows: preferred ones first, topped up from the rest, in seeded order."""
    return rows.orderBy(F.desc(prefer.cast("int")), shuffled(seed, *key), *key).limit(n)


def weighted_resample(rows: DataFrame, weight: str, draws: int, seed: int, *order: str, rows_per_part: int = 1_000_000, draws_per_task: int = 1_000_000, scale: float = 1.0) -> DataFrame:
    """``draws`` draws with replacement in proportion to whole weights: ``draw`` with the drawn row.

    weight: numbers that ``scale`` makes whole (what is left behind the point is cut off); null and negative ones weigh
    nothing.
    Draw i falls at ``shuffled(seed, i)``, 60 bits of it, modulo the total weight. Rows lie end to end in the order of a
    part (the first 28 bits of the MD5 of ``order`` as text) and then of ``order``, each as long as its weight: a draw
    takes the row on which it falls. No weight at all gives no draws.

    Parts (at most 65,536) get their draws first: they are cut at as many steps of the whole length, so that a draw meets
    about one part (2 x 65,536 steps of parts at most are broadcast). Then each part's rows and draws are merged in one sorted pass, a draw taking the last row that begins
    at or before it; a part with many draws is dealt with its rows to several tasks. The work is rows and draws, not
    their product.
    """
    spark = rows.sparkSession
    w = F.greatest(F.coalesce((F.col(weight) * scale if scale != 1 else F.col(weight)).cast("long"), F.lit(0)), F.lit(0))
    total, n = rows.agg(F.sum(w), F.count("*")).first()
    if not total:
        return rows.limit(0).select(F.lit(0).cast("long").alias("draw"), *rows.columns)
    parts = min(65_536, max(1, -(-n // rows_per_part)))
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in order))
    part = F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), F.lit(parts))
    kept = rows.select(part.alias("__part"), w.alias("__w"), F.struct(*rows.columns).alias("__row"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order))).where("__w > 0")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ends = kept.groupBy("__part").agg(F.sum("__w").alias("__all")).select("__part", "__all", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__from"))
    tasks = F.ceil(F.col("__all") * (draws / total) / draws_per_task).cast("int")
    ends = ends.withColumn("__tasks", F.greatest(tasks, F.lit(1)))

    step = -(-total // parts)
    div = lambda x: F.call_function("div", x, F.lit(step).cast("long"))
    steps = ends.withColumn("__step", F.explode(F.sequence(div(F.col("__from")), div(F.col("__from") + F.col("__all") - 1))))
    fall = spark.range(draws).select(F.col("id").alias("draw")).withColumn("__at", F.pmod(hex_value(shuffled(seed, "draw")), F.lit(total))).withColumn("__step", div(F.col("__at")))
    fall = fall.join(F.broadcast(steps), "__step").where((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__from") + F.col("__all")))
    fall = fall.select("__part", F.pmod("draw", "__tasks").cast("int").alias("__task"), "__at", "draw", F.lit(None).cast(kept.schema["__row"].dataType).alias("__row"))

    along = Window.partitionBy("__part").orderBy(*(f"__o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, -1)
    lying = kept.withColumn("__at", F.coalesce(F.sum("__w").over(along), F.lit(0))).join(F.broadcast(ends), "__part").withColumn("__at", F.col("__at") + F.col("__from"))
    lying = lying.withColumn("__task", F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1))).select("__part", "__task", "__at", F.lit(None).cast("long").alias("draw"), "__row")
    merged = Window.partitionBy("__part", "__task").orderBy("__at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = lying.unionByName(fall).withColumn("__row", F.last("__row", ignorenulls=True).over(merged))
    return met.where("draw is not null").select("draw", "__row.*")


def few_shot(tests: DataFrame, pool: DataFrame, key: str, ident: str, shots: int, seed: int) -> DataFrame:
    """``shots`` different pool rows of the same subject for each test row, in drawn order: ``key, ident, shot, shot_id``.

    The pool of a subject is numbered once (:func:`group_index`), and the shots of a test are the first places of a
    permutation of its subject's positions that is keyed by the seed and the test's id: every subset can occur, and the
    drawn positions are joined, so that no test meets its whole subject. A subject with fewer rows than shots gives all
    of them; one without rows gives none.
    """
    p = group_index(pool.select(key, F.col(ident).alias("shot_id")), [key], ["shot_id"], "__at")
    sizes = p.groupBy(F.col(key).alias("__size_key")).agg(F.count("*").alias("__size"))
    t = tests.select(key, ident).join(sizes, F.col(key) == F.col("__size_key")).withColumn("shot", F.explode(F.sequence(F.lit(1), F.least(F.lit(shots), F.col("__size")).cast("int"))))
    t = drawn(t, "__pick", F.col("shot") - 1, F.col("__size"), F.lit(str(seed)), F.col(ident).cast("string")).select(key, ident, "shot", "__pick")
    q = p.select(F.col(key).alias("__pool_key"), "__at", "shot_id")
    return t.join(q, (F.col(key) == F.col("__pool_key")) & (F.col("__pick") == F.col("__at"))).select(key, ident, "shot", "shot_id")


def full_batches(rows: DataFrame, order: str, batch: int) -> DataFrame:
    """Rows of whole batches only."""
    n = rows.count() // batch * batch
    return rows.where(F.col(order) < n)


def round_robin(order: Column, parts: int) -> Column:
    return F.pmod(order, F.lit(parts))


def page(rows: DataFrame, order: str, number: int, size: int) -> DataFrame:
    return rows.where((F.col(order) >= number * size) & (F.col(order) < (number + 1) * size))


def score_order(rows: DataFrame, order: str, ascending: bool = False, columns: tuple[str, ...] = ("score", "score_1")) -> DataFrame:
    s = F.coalesce(*(F.col(c).cast("double") for c in columns if c in rows.columns), F.lit(0.0))
    return rows.orderBy(s.asc() if ascending else s.desc(), order)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\r\x0b\x0c]+"), lambda x: x != "")), F.lit(0)).cast("long")


def not_overlong(rows: DataFrame, length: Column, most: int, *, name: str = "length") -> DataFrame:
    """Rows whose prompt has at most ``most`` units, with that length. Rows of unknown length go."""
    return rows.withColumn(name, length).where(F.col(name) <= most)


def group_members(rows: DataFrame, keys: list[str], ident: str, *, per_row: int = 1000) -> DataFrame:
    """``keys, part, first, members, ids``: the sorted ids of every group, ``per_row`` a row in order of ``part``; first is
    the group's smallest id, members its number of ids. Null keys are a group; rows without an id go.

    Places come from ranges of (keys, id), so that a group of any size is many tasks and no array outgrows ``per_row``.
    """
    from .rows import dense_index

    at = dense_index(rows.where(F.col(ident).isNotNull()).select(*keys, ident), *keys, ident, name="__at")
    groups = at.groupBy(*keys).agg(F.min("__at").alias("__from"), F.min(ident).alias("first"), F.count("*").alias("members"))
    g = groups.select(*(F.col(k).alias(f"__{k}") for k in keys), "__from", "first", "members")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    placed = at.join(g, same).withColumn("part", F.call_function("div", F.col("__at") - F.col("__from"), F.lit(per_row)))
    parts = placed.groupBy(*keys, "part").agg(F.min("first").alias("first"), F.min("members").alias("members"), F.array_sort(F.collect_list(ident)).alias("ids"))
    return parts.select(*keys, "part", "first", "members", "ids")
