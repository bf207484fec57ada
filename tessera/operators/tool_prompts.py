"""Tool prompts: the text by which a model family is told of its tools, as column expressions over tool schemas.

Tools are an array of structs ``name, description, parameters``; parameters are an array of structs
``name, type, description, required, enum, items`` (enum: array of texts, items: type of an array's elements). Where a
field is null, or an enum is empty, its key is left out; parameters that are null are none. JSON is written with the
separators ", " and ": ", keys in the order above, texts unescaped but for quotes, backslashes and control characters (``\\u`` escapes have upper-case digits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETER = "struct<name:string,type:string,description:string,required:boolean,enum:array<string>,items:string>"
TOOL = f"struct<name:string,description:string,parameters:array<{PARAMETER}>>"
TOOLS = f"array<{TOOL}>"

# Tool prompts of public model families.
PROMPTS = {
    "default": 'You have access to the following tools:\n{tool_text}Use the following format if using a tool:\n```\nAction: tool name (one of [{tool_names}])\nAction Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```)\n```\n',
    "glm4": "你是一个名为 ChatGLM 的人工智能助手。你是基于智谱 AI 公司训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n# 可用工具{tool_text}",
    "glm4_moe": "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tool_text}\n</tools>\n\nFor each function call, output the function name and arguments within the following XML format:\n<tool_call>{function-name}\n<arg_key>{arg-key-1}</arg_key>\n<arg_value>{arg-value-1}</arg_value>\n<arg_key>{arg-key-2}</arg_key>\n<arg_value>{arg-value-2}</arg_value>\n...\n</tool_call>\n",
    "llama3": 'Cutting Knowledge Date: December 2023\nToday Date: {date}\n\nYou have access to the following functions. To call a function, please respond with JSON for a function call. Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.\n\n{tool_text}',
    "mistral": "[AVAILABLE_TOOLS] {tool_text}[/AVAILABLE_TOOLS]",
    "qwen": '\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tool_text}\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
    "seed_oss": "system\nYou are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query.Tool List:\nYou are authorized to use the following tools (described in JSON Schema format). Before performing any task, you must decide how to call them based on the descriptions and parameters of these tools.{tool_text}\n工具调用请遵循如下格式:\n<seed:tool_call>\n<function=example_function_name>\n<parameter=example_parameter_1>value_1</parameter>\n<parameter=example_parameter_2>This is the value for the second parameter\nthat can span\nmultiple lines</parameter>\n</function>\n</seed:tool_call>\n",
    "ling": '# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>{tool_text}\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
}
GLM4_NOTE = "\n在调用上述函数时，请使用 Json 格式表示调用的参数。"


def quoted(c: Column) -> Column:
    """A text as a JSON string; null stays null."""
    inside = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


def _closed(opening: str, parts: Column, closing: str, indent: int | None, level: int) -> Column:
    """Parts that are not null between two brackets."""
    if indent is None:
        return F.concat(F.lit(opening), F.array_join(parts, ", "), F.lit(closing))
    line = lambda n: "\n" + " " * (indent * n)
    return F.concat(F.lit(opening + line(level + 1)), F.array_join(parts, "," + line(level + 1)), F.lit(line(level) + closing))


def _pair(key: str, value: Column) -> Column:
    """Null where the value is."""
    return F.concat(F.lit(f'"{key}": '), value)


def _schema(p: Column, indent: int | None, level: int) -> Column:
    """One parameter as '"name": {...}'."""
    enum = F.when(F.size(p["enum"]) > 0, _closed("[", F.transform(p["enum"], quoted), "]", indent, level + 1))
    items = _closed("{", F.array(_pair("type", quoted(p["items"]))), "}", indent, level + 1)
    fields = F.array(_pair("type", quoted(p["type"])), _pair("description", quoted(p["description"])), _pair("enum", enum), F.when(p["items"].isNotNull(), _pair("items", items)))
    bare = p["type"].isNull() & p["description"].isNull() & p["items"].isNull() & (F.coalesce(F.size(p["enum"]), F.lit(0)) <= 0)
    return F.concat(quoted(p["name"]), F.lit(": "), F.when(bare, F.lit("{}")).otherwise(_closed("{", fields, "}", indent, level)))


def _parameters(tool: Column) -> Column:
    return F.coalesce(tool["parameters"], F.array())


def tool_json(tool: Column, *, indent: int | None = None, level: int = 0) -> Column:
    """A tool's schema as JSON, on one line or indented."""
    given = _parameters(tool)
    needed = F.filter(given, lambda p: p["required"])
    properties = F.when(F.size(given) == 0, F.lit("{}")).otherwise(_closed("{", F.transform(given, lambda p: _schema(p, indent, level + 3)), "}", indent, level + 2))
    required = F.when(F.size(needed) > 0, _closed("[", F.transform(needed, lambda p: quoted(p["name"])), "]", indent, level + 2))
    parameters = _closed("{", F.array(F.lit('"type": "object"'), _pair("properties", properties), _pair("required", required)), "}", indent, level + 1)
    return _closed("{", F.array(_pair("name", quoted(tool["name"])), _pair("description", quoted(tool["description"])), _pair("parameters", parameters)), "}", indent, level)


def _wrapped(tool: Column, indent: int | None = None) -> Column:
    return _closed("{", F.array(F.lit('"type": "function"'), _pair("function", tool_json(tool, indent=indent, level=1))), "}", indent, 0)


def _described(tool: Column) -> Column:
    """A tool in words, one line a parameter."""

    def line(p: Column) -> Column:
        choices = F.when(F.size(p["enum"]) > 0, F.concat(F.lit(", should be one of ["), F.array_join(p["enum"], ", "), F.lit("]"))).otherwise(F.lit(""))
        each = F.when(p["items"].isNotNull(), F.concat(F.lit(", where each item should be "), p["items"])).otherwise(F.lit(""))
        text = lambda c: F.coalesce(c, F.lit(""))
        return F.concat(F.lit("  - "), p["name"], F.lit(" ("), text(p["type"]), F.when(p["required"], ", required").otherwise(""), F.lit("): "), text(p["description"]), choices, each, F.lit("\n"))

    return F.concat(F.lit("> Tool Name: "), tool["name"], F.lit("\nTool Description: "), F.coalesce(tool["description"], F.lit("")), F.lit("\nTool Args:\n"), F.array_join(F.transform(_parameters(tool), line), ""), F.lit("\n"))


def _filled(prompt: str, **slots: Column) -> Column:
    """The prompt with each slot's first occurrence filled; contents are not searched for slots."""
    for name, value in slots.items():
        head, found, tail = prompt.partition("{" + name + "}")
        if found:
            rest = {k: v for k, v in slots.items() if k != name}
            return F.concat(_filled(head, **rest), value, _filled(tail, **rest))
    return F.lit(prompt)


def tool_prompt(tools: Column, kind: str, *, date: Column | None = None) -> Column:
    """The prompt of a tool format (a template's ``tool_format``) for an array of tools, empty where there are none.

    ``date`` (a date; today if not given) is written as day, month and year where a format names it.
    """
    if kind not in PROMPTS:
        raise KeyError(f"unknown tool format {kind!r}; known: {sorted(PROMPTS)}")
    each = lambda f, between="": F.array_join(F.transform(tools, f), between)
    lined = lambda t: F.concat(F.lit("\n"), _wrapped(t))
    text = {
        "default": lambda: each(_described),
        "glm4": lambda: each(lambda t: F.concat(F.lit("\n\n## "), t["name"], F.lit("\n\n"), tool_json(t, indent=4), F.lit(GLM4_NOTE))),
        "llama3": lambda: each(lambda t: F.concat(_wrapped(t, 4), F.lit("\n\n"))),
        "mistral": lambda: F.concat(F.lit("["), each(lambda t: _wrapped(t), ", "), F.lit("]")),
        "seed_oss": lambda: F.concat(F.lit("\n["), each(lambda t: tool_json(t), ", "), F.lit("]")),
    }.get(kind, lambda: each(lined))()
    names = F.array_join(F.transform(tools, lambda t: t["name"]), ", ")
    day = F.date_format(F.current_date() if date is None else date, "dd MMM yyyy")
    return F.when(F.coalesce(F.size(tools), F.lit(0)) <= 0, F.lit("")).otherwise(_filled(PROMPTS[kind], tool_text=text, tool_names=names, date=day))
