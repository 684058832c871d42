"""Answers of a language server as rows: places of definitions, implementations and callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>"
LOCATION = f"struct<uri:string,range:{RANGE}>"
ITEM = f"struct<name:string,uri:string,range:{RANGE}>"


def path_of(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(uri, "^file://", ""))


def locations(answers: DataFrame) -> DataFrame:
    """(id, path, line) of answers (value: JSON-RPC text) that are one place or a list of them; lines count from 1."""
    many = F.from_json("value", f"struct<id:long,result:array<{LOCATION}>>", {"mode": "PERMISSIVE"})
    one = F.from_json("value", f"struct<id:long,result:{LOCATION}>", {"mode": "PERMISSIVE"})
    is_list = F.get_json_object("value", "$.result[0].uri").isNotNull()
    places = F.when(is_list, many["result"]).when(F.get_json_object("value", "$.result.uri").isNotNull(), F.array(one["result"]))
    rows = answers.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.explode(places).alias("p"))
    return rows.select("id", path_of(F.col("p.uri")).alias("path"), (F.col("p.range.start.line") + 1).alias("line"))


def incoming_calls(answers: DataFrame) -> DataFrame:
    """(id, caller, path, line) of answers to a request for incoming calls, a row for each place of a call."""
    found = F.from_json("value", f"struct<id:long,result:array<struct<from:{ITEM},fromRanges:array<{RANGE}>>>>")
    rows = answers.select(found["id"].alias("id"), F.explode(found["result"]).alias("r"))
    return rows.select("id", F.col("r.from.name").alias("caller"), path_of(F.col("r.from.uri")).alias("path"), F.explode("r.fromRanges").alias("at")).select("id", "caller", "path", (F.col("at.start.line") + 1).alias("line"))
