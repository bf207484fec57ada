"""Row-format converters to one aligned conversation schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
ODD, EVEN = ("user", "observation"), ("assistant", "function")
CONVERTERS: dict[str, Callable[..., DataFrame]] = {}


def converter(name: str):
    def keep(f):
        CONVERTERS[name] = f
        return f

    return keep


def align(rows: DataFrame, name: str, **settings) -> DataFrame:
    """Rows of a registered format as ``_prompt, _response, _system, _tools, _images, _videos, _audios``; all
    original columns are dropped except those named in ``keep``."""
    if name not in CONVERTERS:
        raise KeyError(f"unknown converter {name!r}; known: {sorted(CONVERTERS)}")
    keep = settings.pop("keep", [])
    out = CONVERTERS[name](rows, **settings)
    return out.select(*keep, "_prompt", "_response", "_system", "_tools", "_images", "_videos", "_audios")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _none() -> Column:
    return F.array().cast(MESSAGES)


def _media(rows: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    return {f"_{k}": F.col(columns[k]).cast("array<string>") if k in columns and columns[k] in rows.columns else F.lit(None).cast("array<string>") for k in ("images", "videos", "audios")}


def _text(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")


@converter("alpaca")
def alpaca(rows: DataFrame, prompt: str = "instruction", query: str = "input", response: str = "output", history: str = "history", system: str = "system", tools: str = "tools", kto_tag: str | None = None, chosen: str | None = None, rejected: str | None = None, **media: str) -> DataFrame:
    """History pairs become turns; prompt and query join by a line feed (empty ones left out)."""
    turns = F.coalesce(F.flatten(F.transform(history, lambda h: F.array(message("user", h[0]), message("assistant", h[1])))), _none()) if history in rows.columns else _none()
    asked = F.array_join(F.filter(F.array(_text(rows, prompt), _text(rows, query)), lambda x: x != ""), "\n")
    one = message("assistant", F.col(response)) if response in rows.columns else None
    blank = message("assistant", F.lit(""))
    if kto_tag:
        resp = F.when(F.col(kto_tag), F.array(one, blank)).otherwise(F.array(blank, one))
    elif chosen:
        resp = F.when(F.col(chosen).isNotNull() & F.col(rejected).isNotNull(), F.array(message("assistant", F.col(chosen)), message("assistant", F.col(rejected)))).otherwise(_none())
    else:
        resp = F.when(F.col(response).isNotNull(), F.array(one)).otherwise(_none())
    return rows.withColumns({"_prompt": F.concat(turns, F.array(message("user", asked))), "_response": resp, "_system": _text(rows, system), "_tools": _text(rows, tools), **_media(rows, media)})


def _turns(messages: Column, ranking: bool) -> tuple[Column, Column, Column]:
    """(prompt, response, broken) of messages without the system message."""
    good = F.forall(F.transform(messages, lambda m, i: F.when(i % 2 == 0, m["role"].isin(*ODD)).otherwise(m["role"].isin(*EVEN))), lambda ok: ok)
    n = F.size(messages)
    broken = ~good | (n % 2 == (0 if ranking else 1)) | (n == 0)
    return F.when(broken, _none()).otherwise(F.slice(messages, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.when(broken, _none()).otherwise(F.slice(messages, F.greatest(n, F.lit(1)), F.lit(1))), broken


@converter("sharegpt")
def sharegpt(rows: DataFrame, messages: str = "conversations", role: str = "from", content: str = "value", tags: dict[str, str] | None = None, system: str = "system", tools: str = "tools", chosen: str | None = None, rejected: str | None = None, kto_tag: str | None = None, **media: str) -> DataFrame:
    """A leading system message is peeled off; roles must alternate and the last message is the response.
    Broken rows keep empty lists and are marked in ``is_broken``."""
    tags = tags or {"human": "user", "gpt": "assistant", "observation": "observation", "function_call": "function", "system": "system"}
    names = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv))
    m = F.transform(messages, lambda x: F.struct(F.coalesce(F.try_element_at(names, x[role]), x[role]).alias("role"), x[content].alias("content")))
    first = F.try_element_at(m, F.lit(1))
    led = F.coalesce(first["role"] == "system", F.lit(False))
    body = F.when(led, F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1)))).otherwise(m)
    prompt, response, broken = _turns(body, chosen is not None)
    if chosen:
        prompt = F.when(broken, _none()).otherwise(body)
        pick = lambda c: message("assistant", F.col(c)[content]) if "struct" in dict(rows.dtypes)[c] else message("assistant", F.col(c))
        response = F.when(broken, _none()).otherwise(F.array(pick(chosen), pick(rejected)))
    elif kto_tag:
        blank = message("assistant", F.lit(""))
        response = F.when(broken, _none()).when(F.col(kto_tag), F.array(response[0], blank)).otherwise(F.array(blank, response[0]))
    return rows.withColumns({"_prompt": prompt, "_response": response, "_system": F.when(led, first["content"]).otherwise(_text(rows, system)), "_tools": _text(rows, tools), "is_broken": broken, **_media(rows, media)})


def merged_observations(messages: Column) -> Column:
    """Consecutive tool responses become one observation; trailing ones without a later message are lost."""
    join = "\n</tool_response>\n<tool_response>\n"
    state = F.struct(_none().alias("out"), F.array().cast("array<string>").alias("wait"))

    def step(a, m):
        seen = m["role"] == "observation"
        flushed = F.when(F.size(a["wait"]) > 0, F.concat(a["out"], F.array(message("observation", F.array_join(a["wait"], join))))).otherwise(a["out"])
        return F.struct(F.when(seen, a["out"]).otherwise(F.concat(flushed, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content"))))).alias("out"), F.when(seen, F.concat(a["wait"], F.array(m["content"]))).otherwise(F.array().cast("array<string>")).alias("wait"))

    return F.aggregate(messages, state, step, lambda a: a["out"])


# The marks of a system prompt that turn detailed thinking on and off.
THINKING_ON, THINKING_OFF = "detailed thinking on", "detailed thinking off"


def thinking_system(system: Column, tools: Column) -> Column:
    """A system prompt that says whether to think in detail: without tools, one that does not say it gets the mark for
    "off" on a line of its own (an empty one becomes the mark); with tools, one that is not empty gets a line feed."""
    said = system.contains(THINKING_ON) | system.contains(THINKING_OFF)
    plain = F.when(system == "", F.lit(THINKING_OFF)).when(said, system).otherwise(F.concat(system, F.lit("\n" + THINKING_OFF)))
    return F.when(tools == "", plain).when(system == "", system).otherwise(F.concat(system, F.lit("\n")))


@converter("openai")
def openai(rows: DataFrame, messages: str = "messages", system: str = "system", tools: str = "tools", **media: str) -> DataFrame:
    """Role/content messages; ``tool`` roles are observations, tool calls become function messages of JSON, and the system
    prompt is that of :func:`thinking_system`."""
    kind = rows.schema[messages].dataType.elementType
    calls = "tool_calls" in kind.fieldNames()

    def one(x):
        role = F.when(x["role"] == "tool", "observation").otherwise(x["role"])
        if calls:
            has = F.coalesce(F.size(x["tool_calls"]) > 0, F.lit(False))
            return F.struct(F.when(has, "function").otherwise(role).alias("role"), F.when(has, F.to_json(F.transform(x["tool_calls"], lambda t: t["function"]))).otherwise(x["content"]).alias("content"))
        return F.struct(role.alias("role"), x["content"].alias("content"))

    m = F.transform(messages, one)
    first = F.try_element_at(m, F.lit(1))
    led = F.coalesce(first["role"] == "system", F.lit(False))
    body = merged_observations(F.when(led, F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(1)))).otherwise(m))
    prompt, response, broken = _turns(body, False)
    said = F.coalesce(F.when(led, first["content"]).otherwise(_text(rows, system)), F.lit(""))
    return rows.withColumns({"_prompt": prompt, "_response": response, "_system": thinking_system(said, _text(rows, tools)), "_tools": _text(rows, tools), "is_broken": broken, **_media(rows, media)})


def weighted_messages(rows: DataFrame, instruction: str = "instruction", query: str = "input", output: str = "output", system: str = "system") -> DataFrame:
    """``messages`` of typed content with loss weights 0, 0, 1; instruction and input join without separator."""

    def part(role, text, weight):
        return F.when(text != "", F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("value"))).alias("content"), F.lit(weight).alias("loss_weight")))

    asked = F.concat(_text(rows, instruction), _text(rows, query))
    return rows.withColumn("messages", F.filter(F.array(part("system", _text(rows, system), 0.0), part("user", asked, 0.0), part("assistant", _text(rows, output), 1.0)), lambda m: m.isNotNull()))


def content_parts(text: Column) -> Column:
    """Array of (type, text): media marks and the non-empty texts between them."""
    cut = F.split(F.regexp_replace(text, "(<image>|<video>)", "\u0001$1\u0001"), "\u0001")
    return F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")))


def with_system(messages: Column, text: str) -> Column:
    """System message replaced, or put first where there is none; one elsewhere, or two, is an error."""
    n = F.size(F.filter(messages, lambda m: m["role"] == "system"))
    new = F.array(message("system", F.lit(text)))
    fail = lambda t: F.raise_error(F.lit(t)).cast(MESSAGES)
    return F.when(n == 0, F.concat(new, messages)).when(n > 1, fail("more than one system message")).when(messages[0]["role"] != "system", fail("the system message is not first")).otherwise(F.concat(new, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))))


def valid_rows(stage: str) -> Column:
    """Predicate on aligned rows: an odd prompt and, by stage, one, at least two, or any number of responses."""
    odd = F.size("_prompt") % 2 == 1
    return {"sft": odd & (F.size("_response") == 1), "rm": odd & (F.size("_response") >= 2), "kto": odd & (F.size("_response") >= 2), "pt": odd}[stage]


def rl_row(rows: DataFrame, *, source: str, question: Column, truth: Column, ability: str, split: str, index: str, style: str = "rule", suffix: str = "") -> DataFrame:
    """Preprocessed rows ``data_source, prompt, ability, reward_model, extra_info``."""
    return rows.select(F.lit(source).alias("data_source"), F.array(message("user", F.concat(question, F.lit(suffix)))).alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"))


def gsm8k_truth(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1), ",", "")


def preference_to_sft(rows: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows a pair: the prompt with the chosen and with the rejected answer."""
    return rows.select(F.col(prompt).alias("prompt"), F.explode(F.array(F.struct(F.lit("chosen").alias("kind"), F.col(chosen).alias("response")), F.struct(F.lit("rejected").alias("kind"), F.col(rejected).alias("response")))).alias("x")).select("prompt", "x.*")


# What the prepared prompts of these sources end in.
SUFFIXES = {
    "math": " Let's think step by step and output the final answer within \\boxed{}.",
    "geo3k": " You FIRST think about the reasoning process as an internal monologue and then provide the final answer. The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \\boxed{}.",
    "gsm8k": ' Let\'s think step by step and output the final answer after "####".',
}


def math_rows(rows: DataFrame, problem: str, solution: str, index: str, split: str = "train", source: str = "DigitalLearningGmbH/MATH-lighteval") -> DataFrame:
    """Prepared rows of a competition set: the truth is the last boxed answer of the solution."""
    from ..functions.math_scorers import boxed_answer

    return rl_row(rows, source=source, question=F.col(problem), truth=boxed_answer(solution), ability="math", split=split, index=index, suffix=SUFFIXES["math"])


def geo3k_rows(rows: DataFrame, problem: str, answer: str, images: str, index: str, split: str = "train") -> DataFrame:
    """Prepared rows of geometry questions with their ``images``."""
    kept = rl_row(rows, source="hiyouga/geometry3k", question=F.col(problem), truth=F.col(answer), ability="math", split=split, index=index, suffix=SUFFIXES["geo3k"])
    shown = rows.select(F.col(index).alias("__i"), F.col(images).alias("images"))
    return kept.join(shown, kept["extra_info.index"] == shown["__i"]).drop("__i")


def search_rows(rows: DataFrame, question: str, golds: str, source: str, index: str, split: str = "train") -> DataFrame:
    """Prepared rows of open questions: any of the golden answers is right; the source is ``searchR1_<name>``."""
    asked = F.when(F.col(question).endswith("?"), F.col(question)).otherwise(F.concat(F.trim(question), F.lit("?")))
    truth = F.struct(F.col(golds).alias("target"))
    r = rows.select(F.concat(F.lit("searchR1_"), F.col(source)).alias("data_source"), F.array(message("user", asked)).alias("prompt"), F.lit("fact-reasoning").alias("ability"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"))
    return r


def few_shot_prompt(subject: Column, shots: Column, question: Column) -> Column:
    """A multiple-choice prompt: the subject's header, worked examples (an array of rendered texts), the question."""
    head = F.concat(F.lit("The following are multiple choice questions (with answers) about "), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit(".\n\n"))
    return F.concat(head, F.array_join(F.concat(F.coalesce(shots, F.array().cast("array<string>")), F.array(question)), "\n\n"))


def limited_images(images: Column, most: int | None) -> Column:
    """The first ``most`` images of a row; all without a bound."""
    return images if most is None else F.slice(images, 1, most)


def preference_blocks(rows: DataFrame, order: str) -> DataFrame:
    """A pairwise batch as 2n rows: ``kind`` chosen at positions 0..n-1, rejected at n..2n-1 (``place``), in the order of
    the pairs (a dense position)."""
    n = rows.agg(F.count("*").alias("__n"))
    both = rows.withColumn("kind", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    return both.crossJoin(F.broadcast(n)).withColumn("place", F.col(order) + F.when(F.col("kind") == "rejected", F.col("__n")).otherwise(0)).drop("__n")  # one row


def nonempty_labels(rows: DataFrame, label: str) -> DataFrame:
    """Rows whose label is there and more than blanks."""
    return rows.where(F.coalesce(F.trim(F.col(label)), F.lit("")) != "")


def head_and_tail(rows: DataFrame, order: str, share: float = 0.75) -> DataFrame:
    """Adds ``part``: head for the first ``share`` of the rows by their dense position, tail for the rest."""
    n = rows.count()
    return rows.withColumn("part", F.when(F.col(order) < int(n * share), "head").otherwise("tail"))


def pixel_bounds(images: Column, most: int, least: int) -> Column:
    """Image structs with ``max_pixels`` and ``min_pixels``; no images stay none."""
    return F.when(F.size(images) > 0, F.transform(images, lambda i: i.withField("max_pixels", F.lit(most)).withField("min_pixels", F.lit(least))))


def choice_prompt(question: Column, choices: list[Column], answer: Column | None = None) -> Column:
    """Question, lettered choices and "Answer:", with the answer for a few-shot example."""
    lines = [question, *(F.concat(F.lit(f"{chr(65 + i)}. "), c) for i, c in enumerate(choices)), F.lit("Answer:") if answer is None else F.concat(F.lit("Answer: "), answer)]
    return F.concat_ws("\n", *lines)


def samples_by_row(rows: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    """One array of samples per row, in sample order."""
    return rows.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(sample, value))).alias("s")).select(row, F.col(f"s.{value}").alias("responses"))


def template(messages: Column, formats: dict[str, str]) -> Column:
    """Messages rendered by role formats with a ``{content}`` slot, joined."""

    def render(m):
        out = F.lit("")
        for role, f in formats.items():
            a, b = f.split("{content}")
            out = F.when(m["role"] == role, F.concat(F.lit(a), m["content"], F.lit(b))).otherwise(out)
        return out

    return F.array_join(F.transform(messages, render), "")


def media_mismatch(messages: Column, media: Column, mark: str = "<image>") -> Column:
    """Number of marks in all messages minus the number of media items (0: they fit)."""
    n = F.aggregate(messages, F.lit(0), lambda a, m: a + F.size(F.split(m["content"], mark)) - 1)
    return n - F.coalesce(F.size(media), F.lit(0))
