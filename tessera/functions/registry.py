"""User functions: reward scorers, their registry, and table functions."""

from __future__ import annotations

import importlib.util
import json
import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import math_scorers, text

RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("acc", T.DoubleType()), T.StructField("pred", T.StringType()), T.StructField("extra", T.StringType())])
MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def manager(name: str):
    def keep(f):
        MANAGERS[name] = f
        return f

    return keep


def load_function(path: str, name: str) -> Callable:
    """A function of a Python file; a missing file or name is an error."""
    spec = importlib.util.spec_from_file_location("tessera_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def _result(r) -> tuple:
    """A scorer's float, dict or tuple as (score, acc, pred, extra)."""
    if isinstance(r, dict):
        rest = {k: v for k, v in r.items() if k not in ("score", "acc", "pred")}
        return float(r["score"]), float(r.get("acc", r["score"])), None if r.get("pred") is None else str(r["pred"]), json.dumps(rest, sort_keys=True, default=str) if rest else None
    if isinstance(r, tuple):
        return float(r[0]), float(r[0]), None, json.dumps(list(r[1:]), default=str)
    return float(r), float(r), None, None


@contextmanager
def time_limit(seconds: float | None):
    """Raises TimeoutError in a block that runs longer, where signals can be had (the main thread of a worker)."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def scorer(fn: Callable, failed: float = 0.0, timeout: float | None = None) -> Callable[..., Column]:
    """Column function of a row scorer ``fn(data_source, solution_str, ground_truth, extra_info)``; a row whose
    call fails, or takes over ``timeout`` seconds, scores ``failed``."""

    @F.pandas_udf(RESULT)
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        out = []
        for a in zip(source, solution, truth, extra, strict=True):
            try:
                with time_limit(timeout):
                    out.append(_result(fn(*a)))
            except Exception as e:  # noqa: BLE001  one bad row must not end the job
                out.append((failed, failed, None, json.dumps({"error": str(e)})))
        return pd.DataFrame(out, columns=[f.name for f in RESULT.fields])

    return run


def batch_scorer(fn: Callable) -> Callable[..., Column]:
    """Column function of a scorer of whole lists."""

    @F.pandas_udf(T.DoubleType())
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in fn(source.tolist(), solution.tolist(), truth.tolist())])

    return run


# Data sources and the scorer that each takes.
ROUTES = {
    "gsm8k": ("openai/gsm8k",),
    "math": ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"),
    "signed_math": ("math_dapo", "math", "math_dapo_reasoning"),
    "competition": ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"),
    "code": ("codecontests", "apps", "codeforces", "taco"),
    "geo3k": ("hiyouga/geometry3k",),
    "qa": ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"),
}


def rule_score(source: Column, solution: Column, truth: Column, cases: Column | None = None) -> Column:
    """Score by data source; ``aime*`` sources are signed math. Code is not run here: its score is the share of passed
    ``cases`` (an array of booleans that a sandbox gave). A source without a scorer is an error."""
    s = source
    out = F.when(s.isin(*ROUTES["gsm8k"]), text.gsm8k_score(solution, truth))
    out = out.when(s.isin(*ROUTES["qa"]), text.answer_score(solution, F.array(truth)))
    out = out.when(s.isin(*ROUTES["math"]), math_scorers.math_score(solution, truth))
    out = out.when(s.isin(*ROUTES["signed_math"]) | s.startswith("aime"), math_scorers.signed_math_score(solution, truth))
    out = out.when(s.isin(*ROUTES["competition"]), math_scorers.competition_score(solution, truth))
    out = out.when(s.isin(*ROUTES["geo3k"]), 0.9 * math_scorers.answers_graded(math_scorers.boxed_answer(solution), truth).cast("double") + 0.1 * text.boxed_format(solution))
    if cases is not None:
        out = out.when(s.isin(*ROUTES["code"]), pass_ratio(cases))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), s)).cast("double"))


@manager("naive")
def naive(rows: DataFrame, score: Column | None = None) -> DataFrame:
    """Adds ``rm_scores``; rows that have it already come back as they are."""
    if "rm_scores" in rows.columns:
        return rows
    return rows.withColumn("rm_scores", score if score is not None else rule_score(F.col("data_source"), F.col("solution"), F.col("ground_truth")))


@manager("dapo")
def dapo(rows: DataFrame, most: int, buffer: int, factor: float = 1.0, score: Column | None = None) -> DataFrame:
    from ..operators.losses import overlong_penalty

    r = naive(rows, score)
    return r.withColumn("rm_scores", F.col("rm_scores") + overlong_penalty(F.col("length"), most, buffer, factor))


@manager("batch")
def batch(rows: DataFrame, fn: Callable) -> DataFrame:
    return naive(rows, batch_scorer(fn)("data_source", "solution", "ground_truth"))


@manager("prime")
def prime(rows: DataFrame, fn: Callable, timeout: float = 300.0) -> DataFrame:
    """A scorer whose failures, and calls of over ``timeout`` seconds, score 0."""
    return naive(rows, scorer(fn, timeout=timeout)("data_source", "solution", "ground_truth", F.lit(None).cast("string"))["score"])


@manager("uvtr")
def formatted(rows: DataFrame, weight: float = 0.1, score: Column | None = None) -> DataFrame:
    r = naive(rows, score)
    return r.withColumn("format_reward", text.format_reward(F.col("solution"))).withColumn("rm_scores", F.col("rm_scores") + weight * F.col("format_reward"))


def pass_ratio(cases: Column, first: int = 10) -> Column:
    """Share of true results among the first test cases."""
    head = F.slice(cases, 1, first)
    return F.try_divide(F.size(F.filter(head, lambda c: c)).cast("double"), F.size(head))


def tool_call_rows(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row per well-formed tool call."""
    return rows.select(key, F.posexplode(text.tool_calls(F.col(text_col))).alias("call_no", "c")).select(key, "call_no", "c.name", "c.arguments")


PLUGINS: dict[str, dict[str, Callable[..., DataFrame]]] = {"dataset": {}, "sampler": {}, "generator": {}}


def plugin(kind: str, name: str):
    """Registers a data-set class, sampler or data generator: a function of a DataFrame (and settings) to a DataFrame."""

    def keep(f):
        PLUGINS[kind][name] = f
        return f

    return keep


def apply_plugin(kind: str, name: str, rows: DataFrame, **settings) -> DataFrame:
    """The rows after a registered plug-in, or one of a Python file ("path.py:function")."""
    f = PLUGINS[kind].get(name)
    if f is None and ".py:" in name:
        path, _, function = name.rpartition(":")
        f = load_function(path, function)
    if f is None:
        raise KeyError(f"unknown {kind} {name!r}; known: {sorted(PLUGINS[kind])}")
    return f(rows, **settings)


@plugin("sampler", "sequential")
def sequential(rows: DataFrame, order: str = "row") -> DataFrame:
    return rows.orderBy(order)


@plugin("sampler", "random")
def random_order(rows: DataFrame, order: str = "row", seed: int = 0, epoch: int = 0) -> DataFrame:
    """The rows with their ``place`` in a seeded permutation of one epoch. Where ``order`` is dense (from any number on)
    nothing is sorted; otherwise rows are numbered by it first."""
    from ..operators.permute import key_literal, keys, placed
    from ..operators.rows import dense_index

    n, low, high = rows.agg(F.count("*"), F.min(order), F.max(order)).first()
    dense = dict(rows.dtypes)[order] in ("int", "bigint") and n and high - low + 1 == n and rows.groupBy(order).count().where("count > 1").isEmpty()
    at = rows.withColumn("__at", F.col(order) - low) if dense else dense_index(rows, order, name="__at")
    return placed(at, "place", F.col("__at"), n, key_literal(keys(seed, epoch))).drop("__at")


@plugin("sampler", "curriculum")
def curriculum(rows: DataFrame, difficulty: str, order: str = "row", steps: int = 10) -> DataFrame:
    """Easy rows first: ``steps`` shares of the rows by difficulty, inside a share in the given order."""
    cuts = rows.agg(F.percentile_approx(difficulty, [k / steps for k in range(1, steps)], 10_000)).first()[0] or []
    stage = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(difficulty))) if cuts else F.lit(0)
    return rows.orderBy(stage, order)


@plugin("generator", "repeat")
def repeat(rows: DataFrame, times: int = 1) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
