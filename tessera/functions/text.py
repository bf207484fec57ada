"""Text scorers and extractors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCT = r"[!-/:-@\[-`{-~]"


def _last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def gsm8k_strict(text: Column) -> Column:
    """The number of the last ``#### number`` in the last 300 characters, without commas and dollar signs."""
    tail = F.right(text, F.lit(300))
    return F.regexp_replace(_last(F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))), r"[,$]", "")


def gsm8k_flexible(text: Column) -> Column:
    """The last number in the last 300 characters that is not empty or a lone dot; if all are, the first."""
    all_ = F.regexp_extract_all(F.right(text, F.lit(300)), F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(all_, lambda x: (x != "") & (x != "."))
    return F.when(F.size(good) > 0, _last(good)).otherwise(F.try_element_at(all_, F.lit(1)))


def gsm8k_score(text: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = gsm8k_strict(text) if method == "strict" else gsm8k_flexible(text)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def qa_normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    x = F.regexp_replace(F.lower(text), _PUNCT, "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    p = qa_normalize(prediction)
    return F.exists(golds, lambda g: qa_normalize(g) == p).cast("int")


def sub_exact_match(prediction: Column, golds: Column) -> Column:
    p = qa_normalize(prediction)
    return F.exists(golds, lambda g: F.contains(p, qa_normalize(g))).cast("int")


def last_tag(text: Column, tag: str) -> Column:
    """Trimmed content of the last ``<tag>...</tag>``; null if there is none."""
    return F.trim(_last(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))), F.lit(" \t\n\r\x0b\x0c"))


def answer_score(text: Column, golds: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Exact match of the last answer; a quarter of the score when over ten tags of a kind are present."""
    answer = last_tag(text, "answer")
    opening, closing = F.regexp_count(text, F.lit("<answer>")), F.regexp_count(text, F.lit("</answer>"))
    hit = F.when((opening > 10) | (closing > 10), score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(exact_match(answer, golds) == 1, hit).otherwise(format_score)


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c"))


def final_answer(text: Column) -> Column:
    """The last answer tag's content; else what follows the last opening tag; else the last line of a text of
    under 500 lines. Tool responses are removed first."""
    clean = F.regexp_replace(text, r"(?s)<tool_response>.*?</tool_response>", "")
    body = _strip(clean)
    parts = F.split(body, "<answer>")
    lines = F.split(body, r"\r\n|\n|\r")
    whole = last_tag(clean, "answer")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(whole.isNotNull(), whole).when(F.size(parts) > 1, _strip(_last(parts))).when((F.length(body) > 0) & (F.size(lines) < 500), _strip(_last(lines)))


def rule_answer(prediction: Column, truth: Column) -> Column:
    """For a choice question the last lone letter A to D; else the number itself or the last number in it."""
    up = F.upper(prediction)
    choice = _last(F.regexp_extract_all(up, F.lit(r"(?U)\b([A-D])\b"), F.lit(1)))
    number = F.coalesce(_strip(prediction).try_cast("double").cast("string"), _last(F.regexp_extract_all(up, F.lit(r"([-+]?\d*\.?\d+)"), F.lit(1))))
    return F.when(F.coalesce(prediction, F.lit("")) == "", F.lit(None)).when(F.upper(truth).isin("A", "B", "C", "D"), choice).otherwise(number)


def _fraction(c: Column) -> Column:
    f = F.split(_strip(c), "/")
    return F.when(F.size(f) == 2, F.try_divide(f[0].try_cast("double"), F.try_element_at(f, F.lit(2)).try_cast("double"))).otherwise(_strip(c).try_cast("double"))


def equivalent_answers(prediction: Column, truth: Column, tolerance: float = 1e-4) -> Column:
    p, t = prediction.try_cast("double"), truth.try_cast("double")
    direct = F.when(p.isNotNull() & t.isNotNull(), p == t).otherwise(prediction == truth)
    got = rule_answer(prediction, truth)
    near = (F.upper(got) == F.upper(_strip(truth))) | (F.abs(_fraction(got) - _fraction(truth)) <= tolerance)
    return F.coalesce(direct, F.lit(False)) | F.coalesce(near, F.lit(False))


def format_reward(text: Column) -> Column:
    """1.0 if the text starts with <think>, opens and closes it equally often (at least once), holds exactly one
    answer, at its end, and no think block reaches into the answer; tool responses are removed first."""
    x = _strip(F.regexp_replace(text, r"(?s)<tool_response>.*?</tool_response>", ""))
    opens, closes = F.regexp_count(x, F.lit("<think>")), F.regexp_count(x, F.lit("</think>"))
    answers = F.size(F.regexp_extract_all(x, F.lit(r"(?s)(<answer>.*?</answer>)"), F.lit(1)))
    end = x.rlike(r"(?s)<answer>.*?</answer>\s*$")
    # Think blocks are cut out one by one; one of them reaches in if it holds an answer's start.
    blocks = F.regexp_extract_all(x, F.lit(r"(?s)(<think>.*?</think>)"), F.lit(1))
    overlap = F.exists(blocks, lambda b: F.contains(b, F.lit("<answer>")))
    return F.when(text.isNotNull() & x.startswith("<think>") & (opens == closes) & (opens > 0) & (answers == 1) & end & ~overlap, 1.0).otherwise(0.0)


def boxed_format(text: Column) -> Column:
    """1.0 if the whole text is a think block followed by something with a boxed answer."""
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def single_tag(text: Column, tag: str) -> tuple[Column, Column]:
    """(trimmed content, error) of a tag that must occur exactly once."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    n = F.size(found)
    error = F.when(n == 0, F.lit(f"missing <{tag}>")).when(n > 1, F.lit(f"more than one <{tag}>"))
    return F.when(n == 1, _strip(found[0])), error


def _is_json(text: Column) -> Column:
    """Whether a text is one JSON value as a whole. The parser stops behind the first value, so that the text is read
    as the first of two elements with its own hash as the second."""
    mark = F.xxhash64(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.coalesce(F.try_variant_get(both, "$[1]", "long") == mark, F.lit(False))


def fenced_json(text: Column) -> Column:
    """JSON text without code fences: the whole, or else from the first brace to the last."""
    bare = _strip(F.regexp_replace(F.regexp_replace(_strip(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```\z", ""))
    outer = lambda b: _once(F.regexp_extract(b, r"(?s)\{.*\}", 0), lambda o: F.when(_is_json(o), o))
    return _once(bare, lambda b: F.when(_is_json(b), b).otherwise(outer(b)))


def planner_error(text: Column) -> Column:
    """Why a planner output breaks its contract, or null: an answer or suggestions, and not both."""
    a, s = F.regexp_count(text, F.lit("<answer>")), F.regexp_count(text, F.lit("<suggestions>"))
    return F.when((a > 0) & (s > 0), "both answer and suggestions").when((a == 0) & (s == 0), "neither answer nor suggestions").when((a > 1) | (s > 1), "repeated tag")


def _kind(v: Column, path: str) -> Column:
    """Type of a JSON value by path; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


# What stands for a thought that a planner left out or left empty.
_NO_THOUGHT = "(Model omitted 'think' in JSON; placeholder.)"
_EMPTY_THOUGHT = "(Empty think in JSON; placeholder.)"


def planner_output(text: Column) -> Column:
    """Struct ``can_answer_now, think, direct_answer, stop_reason, suggestions, error`` of a planner's text.

    A JSON object (fenced or within prose) with a mode and a thought names the mode: answer (an answer, no suggestions)
    or suggestions (an array, no answer). Other text must hold a think block before one answer block or one block of suggestions, an array. Where the
    contract is broken only ``error`` is set; suggestions are JSON texts.
    """
    block = lambda tag: F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    body = fenced_json(text)
    read = F.struct(text.alias("text"), body.alias("body"), F.try_parse_json(body).alias("v"), block("think").alias("said"), block("answer").alias("found"), block("suggestions").alias("offers"))
    return _once(read, lambda p: _once(F.struct(p.alias("p"), F.try_parse_json(F.get(p["offers"], F.lit(0))).alias("offered")), lambda q: _planner(q["p"], q["offered"])))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _planner(p: Column, offered: Column) -> Column:
    v = p["v"]
    is_json = F.coalesce(F.startswith(_kind(v, "$"), F.lit("OBJECT")) & _kind(v, "$.mode").isNotNull() & _kind(v, "$.think").isNotNull(), F.lit(False))
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    there = lambda name: F.coalesce(_kind(v, f"$.{name}") != "VOID", F.lit(False))
    array = lambda name: F.coalesce(F.startswith(_kind(v, f"$.{name}"), F.lit("ARRAY")), F.lit(False))
    mode, answer = F.lower(_strip(F.coalesce(get("mode"), F.lit("")))), F.get_json_object(p["body"], "$.answer")
    thought = F.when(~there("think"), _NO_THOUGHT).when(_strip(get("think")) == "", _EMPTY_THOUGHT).otherwise(_strip(get("think")))
    json_error = (
        F.when(there("stop_reason") & (_kind(v, "$.stop_reason") != "STRING"), "stop reason is no text")
        .when((mode == "answer") & there("suggestions"), "answer and suggestions")
        .when((mode == "answer") & ~there("answer"), "answer is missing")
        .when((mode == "answer") & (_strip(answer) == ""), "answer is empty")
        .when((mode == "suggestions") & there("answer") & (F.coalesce(answer, F.lit("x")) != ""), "answer and suggestions")
        .when((mode == "suggestions") & ~array("suggestions"), "suggestions are no array")
        .when(~mode.isin("answer", "suggestions"), "unknown mode")
    )
    said, found, offers = (F.get(p[k], F.lit(0)) for k in ("said", "found", "offers"))
    again = (F.size(p["said"]) > 1) | (F.size(p["found"]) > 1) | (F.size(p["offers"]) > 1)
    at = lambda tag: F.instr(p["text"], f"<{tag}>")
    early = F.exists(F.array(at("answer"), at("suggestions")), lambda x: (x > 0) & (x < at("think")))
    is_array = F.coalesce(F.startswith(_kind(offered, "$"), F.lit("ARRAY")), F.lit(False))
    tag_error = (
        F.when(early, "think comes late").when(again, "repeated tag").when(said.isNull(), "think is missing").when(_strip(said) == "", "think is empty").when(found.isNotNull() & offers.isNotNull(), "answer and suggestions").when(found.isNull() & offers.isNull(), "neither answer nor suggestions")
        .when(found.isNotNull() & (_strip(found) == ""), "answer is empty").when(offers.isNotNull() & ~is_array, "suggestions are no array")
    )
    texts = lambda array: F.transform(array, lambda s: F.to_json(s))
    listed = F.when(is_json, texts(F.try_variant_get(v, "$.suggestions", "array<variant>"))).otherwise(texts(F.try_variant_get(offered, "$", "array<variant>")))

    def built(e: Column) -> Column:
        can = F.when(is_json, mode == "answer").otherwise(found.isNotNull())
        good = lambda c: F.when(e["error"].isNull(), c)
        return F.struct(
            good(can).alias("can_answer_now"),
            good(F.when(is_json, thought).otherwise(_strip(said))).alias("think"),
            good(F.when(can, _strip(F.when(is_json, answer).otherwise(found)))).alias("direct_answer"),
            good(F.when(is_json, get("stop_reason"))).alias("stop_reason"),
            good(F.when(can, F.array().cast("array<string>")).otherwise(listed)).alias("suggestions"),
            F.when(p["text"].isNull(), "no text").otherwise(e["error"]).alias("error"),
        )

    return _once(F.struct(F.when(is_json, json_error).otherwise(tag_error).alias("error")), built)


def executor_output(text: Column, tool: str = "code_image_tool") -> Column:
    """Struct ``cot, code, description, error`` of an executor's text: a JSON object with a thought and a call of the
    tool with code and a description. Where the contract is broken only ``error``, the first fault, is set."""
    return _once(F.try_parse_json(fenced_json(text)), lambda v: _executor(v, tool))


def _executor(v: Column, tool: str) -> Column:
    get = lambda path: _strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    is_object = lambda path: F.coalesce(F.startswith(_kind(v, path), F.lit("OBJECT")), F.lit(False))
    call, given = "$.tool_call", "$.tool_call.arguments"
    error = (
        F.when(~is_object("$") | _kind(v, "$.think").isNull() | _kind(v, call).isNull(), "no JSON object").when(get("$.think") == "", "empty think").when(~is_object(call), "no tool call").when(get(f"{call}.name") != tool, "wrong tool name").when(~is_object(given), "no arguments")
        .when(get(f"{given}.code") == "", "empty code").when(get(f"{given}.description") == "", "empty description")
    )
    good = lambda path: F.when(error.isNull(), get(path))
    return F.struct(good("$.think").alias("cot"), good(f"{given}.code").alias("code"), good(f"{given}.description").alias("description"), error.alias("error"))


def elapsed_seconds(begin: Column, end: Column) -> Column:
    """Seconds between two times, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", begin, end) / 1e6


def iso_time(t: Column) -> Column:
    """A time in the session's zone as ISO text of microseconds."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def stamp(t: Column) -> Column:
    """A time as a compact stamp for names, e.g. 20240102T030405000006Z."""
    return F.date_format(t, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def tool_calls(text: Column) -> Column:
    """Array of (name, arguments as JSON text) of the well-formed <tool_call> blocks; bad ones are skipped."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    read = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(read, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_tool_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


def strict_tool_calls(text: Column) -> Column:
    """The calls if every block is well formed; null (the text stands as it is) if any is not, or none is there."""
    n = F.regexp_count(text, F.lit(r"(?s)<tool_call>.*?</tool_call>"))
    calls = tool_calls(text)
    return F.when((n > 0) & (F.size(calls) == n), calls)


def default_tool_format(name: Column, arguments: Column) -> Column:
    return F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "), arguments)


def qwen_tool_format(name: Column, arguments: Column) -> Column:
    return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))


def fill_slots(template: str, **values: Column) -> Column:
    """A template with ``{{name}}`` slots; the first occurrence of each is filled."""
    parts: list[Column | str] = [template]
    for name, value in values.items():
        slot = "{{" + name + "}}"
        for i, p in enumerate(parts):
            if isinstance(p, str) and slot in p:
                a, b = p.split(slot, 1)
                parts[i : i + 1] = [a, value, b]
                break
        else:
            raise ValueError(f"no slot {slot}")
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def child_id(parent: Column, round_: Column, suffix: Column) -> Column:
    """Child ids ``parent__r003_suffix``; ids with a path separator are an error."""
    return F.when(F.concat(parent, suffix).rlike(r"[/\\]"), F.raise_error(F.lit("ids hold no path separators")).cast("string")).otherwise(F.format_string("%s__r%03d_%s", parent, round_, suffix))


def preview(text: Column, most: int = 500) -> Column:
    x = _strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def from_data_url(text: Column) -> Column:
    """Bytes of a base64 text with or without a data-URL prefix."""
    return F.unbase64(F.regexp_replace(text, r"^data:[^,]*,", ""))


def without_thoughts(text: Column) -> Column:
    return F.ltrim(F.regexp_replace(text, r"(?s)<think>(.*?)</think>", ""), F.lit("\n"))


def capitalized(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def hellaswag_clean(text: Column) -> Column:
    """Bracketed notes go, " [title]" becomes a full stop, double spaces become single."""
    x = F.regexp_replace(_strip(text), r" \[title\]", ". ")
    return F.regexp_replace(F.regexp_replace(x, r"\[.*?\]", ""), "  ", " ")


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message, empty if there is none."""
    return F.coalesce(_last(F.filter(messages, lambda m: m["role"] == "assistant"))["content"], F.lit(""))


def passages_text(passages: Column) -> Column:
    """Numbered passages: ``Doc 1(Title: ...) text`` with the title as the first line of the content."""
    n = F.transform(passages, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.split(p, "\n")[0], F.lit(") "), F.regexp_replace(p, r"^[^\n]*\n?", ""), F.lit("\n")))
    return F.array_join(n, "")


def flatten_struct(df, column: str, separator: str = "/"):
    """Leaf columns of a nested struct, named by their path."""
    from pyspark.sql.types import StructType

    def leaves(path, kind):
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from leaves([*path, f.name], f.dataType)
        else:
            yield F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path[1:]))

    return df.select(*(c for c in df.columns if c != column), *leaves([column], df.schema[column].dataType))
