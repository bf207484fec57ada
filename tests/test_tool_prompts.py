"""Tool prompts against json.dumps of the same schemas."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from tessera.operators import templates
from tessera.operators import tool_prompts as tp

CITY = {"name": "city", "type": "string", "description": 'a "place"\nor {tool_names}', "required": True, "enum": ["Zürich", "Ulm"], "items": None}
DAYS = {"name": "days", "type": "array", "description": None, "required": None, "enum": [], "items": "integer"}
ODD = {"name": "odd", "type": None, "description": None, "required": True, "enum": None, "items": None}
WEATHER = {"name": "weather", "description": "Weather \\ of {date}", "parameters": [CITY, DAYS, ODD]}
PING = {"name": "ping", "description": None, "parameters": None}
DAY = datetime.date(2024, 3, 9)


def schema(tool):
    """The tool as a JSON object."""
    props = {}
    for p in tool["parameters"] or []:
        q = {k: p[k] for k in ("type", "description") if p[k] is not None}
        if p["enum"]:
            q["enum"] = p["enum"]
        if p["items"]:
            q["items"] = {"type": p["items"]}
        props[p["name"]] = q
    out = {"name": tool["name"], **({"description": tool["description"]} if tool["description"] else {}), "parameters": {"type": "object", "properties": props}}
    if needed := [p["name"] for p in tool["parameters"] or [] if p["required"]]:
        out["parameters"]["required"] = needed
    return out


def dumped(x, **kw):
    return json.dumps(x, ensure_ascii=False, **kw)


def want(kind, tools):
    s = [schema(t) for t in tools]
    w = [{"type": "function", "function": x} for x in s]
    text = {
        "glm4": "".join(f"\n\n## {x['name']}\n\n{dumped(x, indent=4)}{tp.GLM4_NOTE}" for x in s),
        "llama3": "".join(dumped(x, indent=4) + "\n\n" for x in w),
        "mistral": dumped(w),
        "seed_oss": "\n" + dumped(s),
    }.get(kind, "".join("\n" + dumped(x) for x in w))
    head, _, tail = tp.PROMPTS[kind].partition("{tool_text}")
    return head.replace("{date}", "09 Mar 2024") + text + tail


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, [WEATHER, PING]), (2, [PING]), (3, []), (4, None)], f"k int, tools {tp.TOOLS}")


@pytest.mark.parametrize("kind", sorted(set(tp.PROMPTS) - {"default"}))
def test_json_formats(frame, kind):
    got = {r.k: r.p for r in frame.select("k", tp.tool_prompt(F.col("tools"), kind, date=F.lit(DAY)).alias("p")).collect()}
    assert got == {1: want(kind, [WEATHER, PING]), 2: want(kind, [PING]), 3: "", 4: ""}


def test_words(frame):
    got = frame.select(tp.tool_prompt(F.col("tools"), "default").alias("p")).first().p
    assert got.startswith('You have access to the following tools:\n> Tool Name: weather\nTool Description: Weather \\ of {date}\nTool Args:\n  - city (string, required): a "place"\nor {tool_names}, should be one of [Zürich, Ulm]\n  - days (array): , where each item should be integer\n  - odd (, required): \n\n> Tool Name: ping\nTool Description: \nTool Args:\n\nUse the following')
    assert "(one of [weather, ping])" in got and '```{"input": "hello world", "num_beams": 5}```' in got


def test_in_a_template(spark, frame):
    talk = F.expr("array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a'))")
    prompt = tp.tool_prompt(F.col("tools"), templates.chat_template("yi").tool_format)
    rows = frame.select("k", "tools", templates.one_turn(talk, "yi", system=F.lit("S."), tools=prompt).alias("x"), prompt.alias("p")).collect()
    for r in rows:
        assert r.x.prompt == f"<|im_start|>system\nS.{r.p}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    assert all(f.tool_format in tp.PROMPTS for f in templates.TEMPLATES.values())
    with pytest.raises(KeyError):
        tp.tool_prompt(F.col("tools"), "nope")
