"""Table functions: tool calls of conversations as typed rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)


#: Types of fields; a worker has no session that could read them as DDL.
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def argument_fields(text: str) -> list[T.StructField]:
    """Fields of a text such as 'city string, days int'."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        name, _, kind = part.rpartition(" ")
        if not name.strip() or kind.lower() not in _KINDS:
            raise ValueError(f"{part!r} is not a name and one of {', '.join(_KINDS)}")
        out.append(T.StructField(name.strip(), _KINDS[kind.lower()]))
    return out


class ToolCalls:
    """Calls of a table's rows in order: ``key, at, call_no, name`` and one column for each field of the arguments.

    The table's columns are the conversation's key, the row's place in it and its text, in this order; ``fields`` is a
    constant (:func:`argument_fields`), from which the result's columns follow. Called with ``PARTITION BY`` the key
    and ``ORDER BY`` the place, so that call_no runs over all turns of a conversation. Blocks that are no JSON object
    with a name and an object of arguments are skipped and not numbered. Arguments that lack a field, or whose value is
    not of its type, give null; objects and lists in a string field come as JSON.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) != 3:
            raise ValueError("a table of key, place and text is asked for")
        if not fields.isConstantExpression or not isinstance(fields.value, str):
            raise ValueError("fields must be a constant text")
        key, at, _ = table.dataType.fields
        own = argument_fields(fields.value)
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField(at.name, at.dataType), T.StructField("call_no", T.LongType()), T.StructField("name", T.StringType()), *own]))

    def __init__(self):
        self.number, self.fields = 0, []

    @staticmethod
    def _typed(value, kind: T.DataType):
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        if isinstance(kind, (T.IntegerType, T.LongType)):
            bound = 31 if isinstance(kind, T.IntegerType) else 63
            return value if isinstance(value, int) and -(2**bound) <= value < 2**bound else None
        return float(value)

    def eval(self, row, fields: str):
        key, at, text = row[0], row[1], row[2]
        self.fields = self.fields or argument_fields(fields)
        for block in _BLOCK.findall(text or ""):
            try:
                call = json.loads(block)
            except ValueError:
                continue
            if not isinstance(call, dict) or not isinstance(call.get("name"), str) or not isinstance(call.get("arguments"), dict):
                continue
            yield (key, at, self.number, call["name"], *(self._typed(call["arguments"].get(f.name), f.dataType) for f in self.fields))
            self.number += 1


def register(spark: SparkSession, name: str = "tool_calls") -> None:
    """Makes the function known to SQL: ``SELECT * FROM tool_calls(TABLE(t) PARTITION BY conv_id ORDER BY (turn), 'n int')``."""
    spark.udtf.register(name, F.udtf(ToolCalls))


def tool_call_table(rows: DataFrame, key: str, at: str, text: str, fields: str) -> DataFrame:
    """The calls of :class:`ToolCalls` for a DataFrame."""
    return F.udtf(ToolCalls)(rows.select(key, at, text).asTable().partitionBy(key).orderBy(at), F.lit(fields))
