"""Nested JSON values taken apart, rewritten, compared and put together inside the engine.

Values are parsed to VARIANT and taken apart one level at a time: each pass turns the members of
all objects and lists of a level into rows that know their path.  Such rows can be dropped,
rewritten or compared by column expressions, and are put together again from the deepest
level up, a group for each object or list.  Passes follow the depth of the values, rows their number.

A path is a JSON pointer: a step after each slash, with ~0 for ~ and ~1 for / in keys; the whole
value has the empty path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import redact
from siltstone.sources.shared import new_folder

# Keys that name credentials, by parts of their lower-case form.
SENSITIVE = (
    "password", "salt", "digest", "session", "csrf", "cookie", "authorization", "secret", "api_key", "apikey", "stackexchange_key", "stackexchangekey",
    "access_key", "accesskey", "private_key", "privatekey", "token",
)


def is_sensitive(key: Column) -> Column:
    low = F.lower(key)
    named = F.regexp_replace(low, "[^a-z0-9]", "") == "key"
    for part in SENSITIVE:
        named = named | F.contains(low, F.lit(part))
    return named


def quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


NODE = "id, parent, step, path, depth, kind, json"


def nodes(values: DataFrame, drop: Callable[[Column], Column] | None = None) -> DataFrame:
    """The nodes of values (id, json): id, parent, step, path, depth, kind (OBJECT, LIST, TEXT, LEAF) and, but for objects and lists, json.

    Members whose key ``drop`` names are left out with all below them.  A null, no JSON, or one that
    repeats a key within an object, has no nodes.  Each level is written to the shared folder once.
    """
    spark, root, depth = values.sparkSession, new_folder(values.sparkSession, "nodes"), 0
    text = F.coalesce(F.to_json("value"), F.lit("null"))
    first = F.substring(text, 1, 1)
    kind = F.when(first == "{", "OBJECT").when(first == "[", "LIST").when(first == '"', "TEXT").otherwise("LEAF")
    rows = values.select("id", F.lit(None).cast("string").alias("parent"), F.lit("").alias("step"), F.lit("").alias("path"), F.try_parse_json("json").alias("value")).where("value IS NOT NULL")
    while True:
        rows.select("*", kind.alias("kind"), F.when(~first.isin("{", "["), text).alias("json")).write.parquet(f"{root}/depth={depth}")
        inside = spark.read.parquet(f"{root}/depth={depth}").where("kind IN ('OBJECT', 'LIST')").select("id", F.col("path").alias("parent"), "value")
        if inside.isEmpty():
            return spark.read.option("basePath", root).parquet(f"{root}/depth=*").select(*NODE.split(", "))
        member = spark.tvf.variant_explode(F.col("value").outer()).select("pos", "key", F.col("value").alias("member"))
        rows = inside.lateralJoin(member)
        if drop is not None:
            rows = rows.where(~F.coalesce(drop(F.col("key")), F.lit(False)))
        key = F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        step = F.coalesce(key, F.col("pos").cast("string"))
        rows = rows.select("id", "parent", step.alias("step"), F.concat("parent", F.lit("/"), step).alias("path"), F.col("member").alias("value"))
        depth += 1


def assembled(rows: DataFrame) -> DataFrame:
    """id and json of the values that nodes() took apart; keys in the order of their code points, items by their places.

    What is below a node that is no object or list, or is not there, is left out.
    """
    spark, root = rows.sparkSession, new_folder(rows.sparkSession, "assembled")
    rows.write.parquet(f"{root}/nodes")
    rows = spark.read.parquet(f"{root}/nodes")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    told = None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        members, items = (F.col("members"), F.col("items")) if told is not None else (F.lit(""), F.lit(""))
        if told is not None:
            level = level.join(told, ["id", "path"], "left")
        objects = F.concat(F.lit("{"), F.coalesce(members, F.lit("")), F.lit("}"))
        lists = F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]"))
        level = level.select("id", "parent", "step", F.when(F.col("kind") == "OBJECT", objects).when(F.col("kind") == "LIST", lists).otherwise(F.col("json")).alias("json"))
        if depth:
            key = F.replace(F.replace("step", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
            member = F.struct(key.alias("key"), F.concat(quoted(key), F.lit(":"), "json").alias("json"))
            item = F.struct(F.expr("try_cast(step AS int)").alias("at"), F.col("json"))
            joined = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda m: m["json"]), ",")
            level.groupBy("id", F.col("parent").alias("path")).agg(joined(member).alias("members"), joined(item).alias("items")).write.parquet(f"{root}/below{depth}")
            told = spark.read.parquet(f"{root}/below{depth}")
    return level.select("id", "json")


def rewrite(df: DataFrame, column: str, drop: Callable[[Column], Column], text: Callable[[Column], Column], alias: str | None = None) -> DataFrame:
    """df with JSON texts of ``column`` without the members whose key ``drop`` names, at any depth, and with ``text`` applied to strings.

    Keys come out in the order of their code points, numbers as they are parsed.  Null stays null; a
    text that is no JSON, or repeats a key within one object, becomes null.  Rows may be equal; any
    other columns are carried through.
    """
    alias, path = alias or column, new_folder(df.sparkSession, "rows")
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    df.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    whole = df.sparkSession.read.parquet(path)
    rows = nodes(whole.select(F.col("__id").alias("id"), name(column).alias("json")), drop)
    string = F.get_json_object(F.concat(F.lit("["), F.col("json"), F.lit("]")), "$[0]")
    rows = rows.withColumn("json", F.when(F.col("kind") == "TEXT", quoted(text(string))).otherwise(F.col("json")))
    made = assembled(rows).select(F.col("id").alias("__id"), F.col("json").alias("__json"))
    return whole.join(made, "__id", "left").select(*(name(c) for c in df.columns if c != alias), F.col("__json").alias(alias))


def scrubbed(df: DataFrame, column: str, alias: str | None = None, limit: int = 2000) -> DataFrame:
    """JSON texts without credentials: sensitive keys go at any depth, strings are redacted and cut to the limit."""
    return rewrite(df, column, is_sensitive, lambda s: redact(s, limit), alias)


def canonical_json(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """JSON texts with sorted keys, without blanks, and with letters of any script as they are; see rewrite()."""
    return rewrite(df, column, lambda key: F.lit(False), lambda s: s, alias)


#: What stands for an object or a list in a difference; its members have rows of their own.
_SHOWN = {"OBJECT": "{}", "LIST": "[]"}


def _shown(kind: str, json: str) -> Column:
    return F.when(F.col(kind) == "OBJECT", _SHOWN["OBJECT"]).when(F.col(kind) == "LIST", _SHOWN["LIST"]).otherwise(F.col(json))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, path, old, new) of what changed between values (id, json) of the same id, down to single leaves.

    A side without the path is null; objects and lists that come or go show as {} or [] beside their
    members.  Values that are equal give no rows; one that is there on one side alone gives all of its nodes.
    Ids are distinct and not null.
    """
    a, b = (nodes(v).select("id", "path", _shown("kind", "json").alias(side)) for v, side in ((old, "old"), (new, "new")))
    return a.join(b, ["id", "path"], "full_outer").where("NOT (old <=> new)").select("id", "path", "old", "new")


def replayed(old: DataFrame, changes: DataFrame) -> DataFrame:
    """id and json of the new values, from the old ones (id, json) and their difference()."""
    before = nodes(old).select("id", "path", _shown("kind", "json").alias("was"))
    both = before.join(changes.select("id", "path", "new", F.lit(True).alias("changed")), ["id", "path"], "full_outer")
    now = both.withColumn("json", F.when(F.col("changed"), F.col("new")).otherwise(F.col("was"))).where("json IS NOT NULL")
    step = F.substring_index("path", "/", -1)
    return assembled(
        now.select(
            "id", F.when(F.col("path") != "", F.substr("path", F.lit(1), F.length("path") - F.length(step) - 1)).alias("parent"), step.alias("step"), "path",
            F.regexp_count("path", F.lit("/")).alias("depth"), F.when(F.col("json") == "{}", "OBJECT").when(F.col("json") == "[]", "LIST").otherwise("LEAF").alias("kind"), "json",
        )
    )


def audit(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, path, old, new) of an edit of whole rows: nested columns down to their leaves, rows that came and went too.

    ``key`` names each row on either side and is not null; null columns are values like others.
    """
    packed = lambda df: df.select(F.col(key).alias("id"), F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}).alias("json"))
    return difference(packed(old), packed(new)).withColumnRenamed("id", key)
