"""Chat query: op9. The turns as calls of a tool: a user's turn asks, the turn behind it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.queries import query, table
from newsflow.llm.tool_calls import linked_calls

SCHEMAS = {
    "reply": {
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}},
    },
}


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each user turn as a call that needs the conversation's opening one, each assistant turn as the result of the turn before."""
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", "text")
    opening = asked.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    calls = asked.join(opening, "conv_id", "left").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when(F.col("turn") > F.col("opening"), F.array(name(F.col("opening")))).alias("needs"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("op9_tool_call_linking", oracle="""
with asked as (select conv_id, turn, text, conv_id || '-' || turn as call_id, min(turn) over (partition by conv_id) as opening from conversations where role = 'user'),
     answers as (select conv_id, turn, text, conv_id || '-' || (turn - 1) as call_id from conversations where role = 'assistant'),
     answer as (select call_id, arg_min(text, struct_pack(t := turn, x := text)) as content, min(struct_pack(t := turn, x := text, c := conv_id)) as a, count(*) as n from answers group by call_id),
     linked as (select coalesce(s.conv_id, a.a.c) as conv_id, coalesce(s.turn, a.a.t) as turn, coalesce(s.call_id, a.call_id) as call_id, s.call_id is not null as called,
                       s.text, s.opening, a.n, a.content from asked s full join answer a on s.call_id = a.call_id)
select conv_id, turn, call_id, case when called then 'reply' end as name,
       case when called then case when turn > opening then 1 else 0 end end as level, called and n is not null as linked, coalesce(n, 0) as n_results,
       called and length(text) >= 20 as valid,
       case when not called then 'result without a call' when length(text) < 20 then '$.text: too short' end as error,
       case when called then '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(call_id) || ',"name":"reply","result":' || coalesce(to_json(content), 'null') || '}'
            else '{"id":' || to_json(call_id) || ',"result":' || coalesce(to_json(content), 'null') || '}' end as json
from linked""")
def tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    return linked_calls(*calls_and_results(table(spark, folder, "conversations")), SCHEMAS)
