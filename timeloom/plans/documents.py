"""Edit plans as JSON documents: read with every problem named, written without defaults."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructType

from ..functions.scalars import good_name

READABLE = (2, 3, 4)
FX = "kind string, frames long, strength double, zoom double, x double, y double, at double"
SLOT = f"start double, end double, shot long, why string, `in` double, out double, speed double, section string, episode string, sync string, accent double, fx array<struct<{FX}>>"
VOICE = "at double, line long, episode string, `in` double, out double, gain double, duck double, text string, sub boolean, force boolean, why string"
PLAN = f"schema long, name string, series string, character string, song string, fps string, slots array<struct<{SLOT}>>, voices array<struct<{VOICE}>>"



def shape() -> str:
    """The JSON Schema of plan documents, from the fields that read() takes."""
    names = {StringType: "string", LongType: "integer", DoubleType: "number"}

    def of(t: DataType) -> dict:
        if isinstance(t, ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}}
        return {"type": names.get(type(t), "boolean")}

    required = {"required": ["schema", "name", "song", "fps", "slots"]}
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", **of(StructType.fromDDL(PLAN)), **required})


def read(df: DataFrame, text: str = "value") -> DataFrame:
    """df with ``plan`` (a struct, null if the text is no JSON object) and ``problems`` (array of texts, empty if there are none).

    fps is a whole number or a fraction like 24000/1001. Only documents of the readable schema numbers count.
    """
    p = F.from_json(F.col(text), PLAN, {"mode": "PERMISSIVE"})
    x = df.withColumn("plan", F.when(F.get_json_object(text, "$").startswith("{"), p))
    at = lambda name: F.col(f"plan.{name}")
    said = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    each = lambda name, bad, what: F.transform(F.filter(F.transform(F.coalesce(at(name), F.array().cast(dict(df.sparkSession.createDataFrame([], PLAN).dtypes)[name])), lambda s, i: F.when(F.coalesce(bad(s), F.lit(True)), i)), lambda i: i.isNotNull()), lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"] {what}")))
    rules = F.concat(
        said(~at("schema").isin(*READABLE), "schema is not readable"), said(~good_name(at("name")), "name is not a plain name"), said(at("song").isNull(), "song is missing"),
        said(~at("fps").rlike(r"^[1-9]\d*(/[1-9]\d*)?$"), "fps is no rate"), said(at("slots").isNull(), "slots is missing"),
        each("slots", lambda s: s["start"].isNull() | s["end"].isNull(), "has no start or end"), each("slots", lambda s: s["in"].isNull() != s["out"].isNull(), "has in without out"),
        each("voices", lambda v: v["at"].isNull(), "has no at"), each("voices", lambda v: v["line"].isNull() & v["episode"].isNull(), "has neither line nor episode"),
    )
    return x.withColumn("problems", F.when(F.col("plan").isNull(), F.array(F.lit("no JSON object"))).otherwise(rules))


def rows_of(plans: DataFrame, key: str, what: str) -> DataFrame:
    """key, position and the fields of each slot or voice."""
    name = {"slots": "slot", "voices": "voice"}[what]
    return plans.select(key, F.posexplode(f"plan.{what}").alias(name, "_s")).select(key, name, "_s.*")


def written(df: DataFrame, plan: str = "plan") -> DataFrame:
    """value: the documents again, times with four decimals, speeds and gains with three, without empty fields."""
    short = lambda s, digits: [(F.bround(s[f], digits[f]) if f in digits else s[f]).alias(f) for f in digits["_"]]
    slot = {"_": ("start", "end", "shot", "why", "in", "out", "speed", "section", "episode", "sync", "accent", "fx"), "start": 4, "end": 4, "in": 4, "out": 4, "speed": 3, "accent": 4}
    voice = {"_": ("at", "line", "episode", "in", "out", "gain", "duck", "text", "sub", "force", "why"), "at": 4, "in": 4, "out": 4, "gain": 3, "duck": 3}
    p = F.col(plan)
    out = F.struct(*[p[c].alias(c) for c in ("schema", "name", "series", "character", "song", "fps")], F.transform(p["slots"], lambda s: F.struct(*short(s, slot))).alias("slots"), F.transform(p["voices"], lambda v: F.struct(*short(v, voice))).alias("voices"))
    return df.withColumn("value", F.to_json(out, {"ignoreNullFields": "true"}))
