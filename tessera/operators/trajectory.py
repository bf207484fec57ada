"""Branching trajectory search: frontier, status, lineage and record upkeep."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("answered", "expanded", "failed", "pruned", "max_step_reached", "stopped")


def frontier(candidates: DataFrame, k: int, *, order: str = "suggestion_order", score: str = "parent_score", ident: str = "trajectory_id", requested: int | None = None, parent: str = "parent_id") -> DataFrame:
    """The k best candidates: first suggestions before all others, then by parent score, order and id. With
    ``requested`` only so many suggestions of a parent compete. Sorted by a top-k plan, not a global window."""
    c = candidates
    if requested is not None:
        w = Window.partitionBy(parent).orderBy(order, ident)
        c = c.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= requested).drop("__n")
    return c.orderBy((F.col(order) > 0).cast("int"), F.desc(score), order, ident).limit(k)


def next_status(failed: Column, output: Column, keep: Column, budget: Column) -> Column:
    """Status after a step, the first that applies: failed, pruned (no output, or the judge), out of steps, running."""
    return F.when(failed, "failed").when(F.coalesce(F.trim(output), F.lit("")) == "", "pruned").when(~F.coalesce(keep, F.lit(False)), "pruned").when(budget <= 0, "max_step_reached").otherwise("running")


def child_budget(budget: Column) -> Column:
    return F.greatest(budget - 1, F.lit(0))


def latest_by_stage(parents: DataFrame, records: DataFrame, key: str, order: str, stage: str, score: str, wanted: str) -> DataFrame:
    """Adds ``latest_score``: the last record's score of a stage, 0.0 without one."""
    last = records.where(F.col(stage) == wanted).groupBy(F.col(key).alias("__k")).agg(F.max_by(score, order).alias("latest_score"))
    return parents.join(last, F.col(key) == F.col("__k"), "left").withColumn("latest_score", F.coalesce("latest_score", F.lit(0.0))).drop("__k")


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys. Of rows of ``new`` that repeat a key the one of highest
    ``order`` stays, of equal order the largest by its columns: no choice is left to chance."""
    rest = [c for c in old.columns if c not in keys]
    best = F.struct(*([order.alias("__order")] if order is not None else []), *rest)
    fresh = new.groupBy(*keys).agg(F.max(best).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))
    return old.join(fresh.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def first_by_priority(rows: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def split_parents(parents: DataFrame, selected: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(parents with a selected child, parents without)."""
    s = selected.select(F.col(parent).alias("__p")).distinct()
    on = F.col(key) == F.col("__p")
    return parents.join(s, on, "left_semi"), parents.join(s, on, "left_anti")


def resolve_artifacts(refs: DataFrame, artifacts: DataFrame, ref: str, ident: str, path: str, *, strict: bool = True) -> DataFrame:
    """Each reference with its path. One without is an error when read or, if not ``strict``, has a null path."""
    a = artifacts.select(F.col(ident).alias("__i"), F.col(path).alias("__path"))
    j = refs.join(a, F.col(ref) == F.col("__i"), "left")
    lost = F.raise_error(F.concat(F.lit("unknown artifact "), F.col(ref).cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    return j.withColumn(path, F.when(F.col("__path").isNull(), lost).otherwise(F.col("__path"))).drop("__i", "__path")


def ancestors(nodes: DataFrame, key: str, parent: str, materialize: Callable[[DataFrame], DataFrame], max_depth: int = 64) -> DataFrame:
    """``key, ancestor, depth`` of every node (depth 0: itself); one join per level, each written by
    ``materialize``, until no node has a further parent."""
    edge = nodes.select(F.col(key).alias("__c"), F.col(parent).alias("__p")).where("__p is not null")
    level = materialize(nodes.select(key, F.col(key).alias("ancestor"), F.lit(0).alias("depth")))
    out = level
    for d in range(1, max_depth + 1):
        level = materialize(level.join(edge, F.col("ancestor") == F.col("__c")).select(key, F.col("__p").alias("ancestor"), F.lit(d).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {max_depth}: a cycle?")


def lineage(nodes: DataFrame, key: str, parent: str, materialize: Callable[[DataFrame], DataFrame], score: str | None = None) -> DataFrame:
    """``key, root, depth`` of every node, and with ``score`` the ``best`` one on its path (itself and the root included).

    Pointer doubling: a node holds an ancestor and what lies before it, and takes over that ancestor's own pointer, so a
    path of any length ends in the logarithm of it in written rounds. A parent that is no node ends the path, as a null
    one does; keys are unique. Paths that are still open after as many rounds as the number of nodes has
    binary digits run in a circle, which is an error.
    """
    own = nodes.select(F.col(key).alias("key"), F.col(parent).alias("up"), (F.col(score) if score else F.lit(None)).alias("best"))
    known = own.select(F.col("key").alias("known"))
    start = own.join(known, F.col("up") == F.col("known"), "left").withColumn("up", F.col("known"))
    state = materialize(start.select("key", "up", F.when(F.col("up").isNull(), F.col("key")).alias("root"), F.col("up").isNotNull().cast("long").alias("depth"), "best"))
    for _ in range(max(1, state.count()).bit_length() + 1):
        open_ = state.where("up is not null")
        if open_.isEmpty():
            names = {key: "key", "root": "root", "depth": "depth"} | ({"best": "best"} if score else {})
            return state.select(*(F.col(c).alias(n) for n, c in names.items()))
        above = state.select(F.col("key").alias("__k"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("best").alias("__best"))
        moved = open_.join(above, F.col("up") == F.col("__k")).select("key", F.col("__up").alias("up"), F.col("__root").alias("root"), (F.col("depth") + F.col("__depth")).alias("depth"), F.greatest("best", "__best").alias("best"))
        state = materialize(state.where("up is null").unionByName(moved))
    raise ValueError("parents run in a circle")


def violations(records: DataFrame, **rules: Column) -> DataFrame:
    """Records with the names of the rules that they break; sound records are left out."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return records.withColumn("broken", broken).where(F.size("broken") > 0)


def attempt(rows: DataFrame, stage: str, failed: Column, message: Column) -> DataFrame:
    """Adds ``error`` (stage, message) where a stage failed; rows that failed before keep their error."""
    new = F.when(failed, F.struct(F.lit(stage).alias("stage"), message.alias("message")))
    return rows.withColumn("error", F.coalesce(F.col("error"), new) if "error" in rows.columns else new)


def run_rounds(roots: DataFrame, plan: Callable[[DataFrame, int], DataFrame], execute: Callable[[DataFrame, int], DataFrame], materialize: Callable[[DataFrame], DataFrame], *, width: int, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first search by rounds. ``plan`` gives candidates (trajectory_id, parent_id, parent_score,
    suggestion_order, budget, ...) for the running frontier; the best ``width`` become children, ``execute`` adds
    their ``failed, output, keep, score``; parents with a child are expanded, others answered. Every round is
    written, so a lost executor redoes one round at most. It ends when nothing runs any more; with ``max_rounds`` it is an
    error if something still does after so many."""
    columns = ["trajectory_id", "parent_id", "round", "budget", "score", "status"]
    done, front = None, materialize(roots.withColumn("round", F.lit(0)).withColumn("status", F.when(F.col("budget") <= 0, "max_step_reached").otherwise("running")).select(*columns))
    for r in itertools.count(1):
        stopped, running = front.where("status <> 'running'"), front.where("status = 'running'")
        done = stopped if done is None else done.unionByName(stopped)
        if running.isEmpty():
            return done
        if max_rounds is not None and r > max_rounds:
            raise RuntimeError(f"trajectories still run after {max_rounds} rounds")
        chosen = materialize(frontier(plan(running, r), width))
        grow, stop = split_parents(running, chosen, "trajectory_id", "parent_id")
        done = done.unionByName(grow.withColumn("status", F.lit("expanded"))).unionByName(stop.withColumn("status", F.lit("answered")))
        ran = execute(chosen, r)
        front = materialize(ran.withColumn("round", F.lit(r)).withColumn("budget", child_budget(F.col("budget"))).withColumn("status", next_status(F.col("failed"), F.col("output"), F.col("keep"), F.col("budget"))).select(*columns))
    raise AssertionError("not reached")


def resumable(trajectories: DataFrame, status: str = "status", updated: str = "updated_at", ident: str = "trajectory_id", wanted: str = "running") -> DataFrame:
    """Trajectories to go on with, longest untouched first."""
    return trajectories.where(F.col(status) == wanted).orderBy(updated, ident)


# What synthesised messages are called and how they look.
TOOL = "code_image_tool"
_MESSAGE = "struct<message_id:string,role:string,content:string,image_artifact_ids:array<string>,metadata:map<string,string>>"


def _json_text(c: Column) -> Column:
    """A text as a JSON string."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _message(ident: Column, role: str, content: Column, images: Column, **metadata: Column) -> Column:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(ident.alias("message_id"), F.lit(role).alias("role"), content.alias("content"), images.alias("image_artifact_ids"), F.create_map(*pairs).alias("metadata")).cast(_MESSAGE)


def _none() -> Column:
    return F.array().cast("array<string>")


def final_answer_message(answer: Column, round_idx: Column) -> Column:
    return _message(F.lit("m_final_answer"), "assistant", F.concat(F.lit("<answer>\n"), answer, F.lit("\n</answer>")), _none(), message_kind=F.lit("final_answer"), planner_round_idx=round_idx)


def assistant_step_message(step: Column, round_idx: Column, thought: Column, code: Column, description: Column, image_index: Column) -> Column:
    """What the executor said: its thought and the tool call, as indented JSON."""
    call = F.concat(F.lit(f'{{\n  "name": "{TOOL}",\n  "arguments": {{\n    "code": '), _json_text(code), F.lit(',\n    "description": '), _json_text(description), F.lit(',\n    "image_index": '), image_index.cast("string"), F.lit("\n  }\n}"))
    content = F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n<tool_call>\n"), call, F.lit("\n</tool_call>"))
    return _message(F.concat(F.lit("m_step_"), F.lpad(step.cast("string"), 3, "0"), F.lit("_assistant")), "assistant", content, _none(), message_kind=F.lit("executor_step"), step_idx=step, planner_round_idx=round_idx, executor_description=description, runtime_image_index=image_index)


def tool_step_message(step: Column, text: Column, images: Column) -> Column:
    """What the tool gave back; its first image, if any, is the primary one."""
    return _message(F.concat(F.lit("m_step_"), F.lpad(step.cast("string"), 3, "0"), F.lit("_tool")), "tool", F.coalesce(text, F.lit("")), F.coalesce(images, _none()), message_kind=F.lit("tool_result"), step_idx=step, tool_name=F.lit(TOOL), primary_image_artifact_id=F.get(images, F.lit(0)))


def appended_messages(messages: Column, *new: Column) -> Column:
    """A conversation with messages behind it; a null conversation is empty."""
    return F.concat(F.coalesce(messages, F.array().cast(f"array<{_MESSAGE}>")), F.array(*new))


def registered(items: Column, item: Column, key: str) -> Column:
    """An array of records with one put in: the record of an equal key goes, and the array is sorted by key."""
    kept = F.concat(F.filter(items, lambda x: x[key] != item[key]), F.array(item))
    return F.array_sort(kept, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def rebased(path: Column, old_root: Column, new_root: Column) -> Column:
    """A path below one root as a path below another; other paths stay."""
    return F.when(F.startswith(path, F.concat(old_root, F.lit("/"))), F.concat(new_root, F.substring(path, F.length(old_root) + 1, F.length(path)))).otherwise(path)


def child_of(parent: DataFrame, child_id: Column, suggestion: Column, *, root: str = "root") -> DataFrame:
    """Rows ``trajectory_id, parent_trajectory_id, root, budget, round_idx, messages, suggestion, status`` of new
    children: the parent's messages copied with image paths below the child's folder, one step less of budget."""
    new_root = F.concat(F.col(root), F.lit("/"), child_id)
    copied = F.transform("messages", lambda m: m.withField("image_artifact_ids", F.transform(m["image_artifact_ids"], lambda p: rebased(p, F.col("__old"), F.col("__new")))))
    c = parent.withColumns({"__old": F.col(root), "__new": new_root, "__child": child_id, "__plan": suggestion}).withColumn("__copied", copied)
    return c.select(F.col("__child").alias("trajectory_id"), F.col("trajectory_id").alias("parent_trajectory_id"), F.col("__new").alias("root"), child_budget(F.col("budget")).alias("budget"), "round_idx", F.col("__copied").alias("messages"), F.col("__plan").alias("suggestion"), F.lit("running").alias("status"))


def record_invariants() -> dict[str, Column]:
    """Rules of a trajectory record for :func:`violations`: an answer or suggestions and not both; a success or an error
    and not both; no negative budget."""
    suggested = F.coalesce(F.size("suggestions"), F.lit(0)) > 0
    return {"answer_xor_suggestions": F.col("final_answer").isNotNull() != suggested, "success_xor_error": F.col("success") != F.col("error").isNotNull(), "budget": F.col("budget") >= 0}


def planner_invariants() -> dict[str, Column]:
    """Rules of a planner's output: one that can answer has an answer that is not empty and no suggestions; one that can't
    has suggestions."""
    can, some = F.coalesce(F.col("can_answer_now"), F.lit(False)), F.coalesce(F.size("suggestions"), F.lit(0)) > 0
    return {"direct_answer": ~can | (F.coalesce(F.col("direct_answer"), F.lit("")) != ""), "no_suggestions": ~can | ~some, "suggestions": can | some}


def runtime_invariants() -> dict[str, Column]:
    """Rules of an executor's result: the count of helper calls is that of its list, and it is a success or has an error,
    not both."""
    calls = F.coalesce(F.size("observed_helper_calls"), F.lit(0))
    return {"helper_call_count": F.coalesce(F.col("observed_helper_call_count"), F.lit(0)) == calls, "success_xor_error": F.col("success") != F.col("error").isNotNull()}


def judge_invariants() -> dict[str, Column]:
    """A judge's record of a step names the step."""
    return {"scope_step_idx": (F.col("scope_type") != "step") | F.col("scope_step_idx").isNotNull()}


def canonical_export(trajectories: DataFrame) -> DataFrame:
    """Training rows of finished trajectories (:func:`export_ready`): ``trajectory_id, messages, final_answer`` of those
    that were answered, messages as (role, content); any unfinished trajectory is an error when read."""
    ready = export_ready(trajectories).where("status = 'answered'")
    return ready.select("trajectory_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), "final_answer")


def export_ready(trajectories: DataFrame, status: str = "status") -> DataFrame:
    """The rows, if every status is terminal; any other is an error when read."""
    return trajectories.withColumn(status, F.when(F.col(status).isin(*TERMINAL), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("not terminal: "), F.col(status))).cast("string")))
