"""Knowledge entries: Markdown with a small front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAUSE = "struct<id:string,claim:string,metric:string,op:string,value:string,family:string,order:string>"


def list_item(item: Column) -> Column:
    """``a: x | b: y`` as a map (keys end at the first colon, empty values are dropped); null without a bar."""
    pairs = F.transform(F.split(item, r"\|"), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v"), p.contains(":").alias("ok")))
    kept = F.filter(pairs, lambda p: p["ok"] & (p["v"] != "") & (p["k"] != ""))
    return F.when(item.contains("|"), F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))))


def front_matter(docs: DataFrame) -> DataFrame:
    """(name, meta map<string,string>, lists map<string,array<string>>, body) of texts (name, text).

    Between two ``---`` lines, or from the first to the end: ``key: value``, and ``- item`` lines that belong to
    the last key if its own value is empty, and else are dropped. Without the first fence all is body.
    """
    text = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    part = lambda k: F.regexp_extract(text, r"(?s)\A[ \t]*---[ \t]*(?:\n(.*?))??(?:\n[ \t]*---[ \t]*(?:\n(.*))?\z|\z)", k)
    fenced = text.rlike(r"\A[ \t]*---[ \t]*(\n|\z)")
    bare = lambda t: F.regexp_replace(t, r"\A\s+|\s+\z", "")
    rows = docs.select("name", F.when(fenced, part(1)).otherwise("").alias("head"), F.when(fenced, bare(part(2))).otherwise(bare(text)).alias("body"))
    zero = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<k:string,v:string>>").alias("meta"), F.array().cast("array<struct<k:string,v:string>>").alias("items"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"\A\s+|\s+\z", "")
        item = bare.startswith("- ") & (F.size(acc["meta"]) > 0)
        key, value = F.trim(F.substring_index(bare, ":", 1)), F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
        entry = lambda k, v: F.array(F.struct(k.alias("k"), v.alias("v")))
        added = F.struct(acc["key"].alias("key"), acc["meta"].alias("meta"), F.concat(acc["items"], entry(acc["key"], F.trim(F.substring(bare, 3, F.char_length(bare))))).alias("items"))
        new = F.struct(F.when(value == "", key).otherwise("").alias("key"), F.concat(acc["meta"], entry(key, value)).alias("meta"), acc["items"].alias("items"))
        return F.when(item, F.when(acc["key"] != "", added).otherwise(acc)).when(bare.contains(":"), new).otherwise(acc)

    rows = rows.withColumn("p", F.aggregate(F.split("head", "\n"), zero, step))
    keys = F.array_distinct(F.transform("p.items", lambda i: i["k"]))
    lists = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter("p.items", lambda i: i["k"] == k), lambda i: i["v"]).alias("value"))))
    last = lambda k: F.element_at(F.filter("p.meta", lambda m: m["k"] == k), -1)["v"]
    meta = F.map_from_entries(F.transform(F.array_distinct(F.transform("p.meta", lambda m: m["k"])), lambda k: F.struct(k.alias("key"), last(k).alias("value"))))
    return rows.select("name", meta.alias("meta"), lists.alias("lists"), "body")


def entries(docs: DataFrame) -> DataFrame:
    """Entries of Markdown texts (name, text), those with a fault_type, numbered by name.

    Clauses need an id and a metric; quotes around an operator go; a family is in capitals. Sources that
    are plain text are names.
    """
    from pyspark.sql import Window

    rows = front_matter(docs)
    items = lambda k: F.coalesce(F.col("lists")[k], F.array().cast("array<string>"))
    clause = F.transform(items("criteria"), list_item)
    clauses = F.transform(F.filter(clause, lambda m: m.isNotNull() & m["id"].isNotNull() & m["metric"].isNotNull()), lambda m: F.struct(
        m["id"].alias("id"), F.coalesce(m["claim"], F.lit("")).alias("claim"), m["metric"].alias("metric"), F.regexp_replace(m["op"], "^[\"']|[\"']$", "").alias("op"), m["value"].alias("value"), F.upper(m["family"]).alias("family"), m["order"].alias("order"),
    ))
    source = lambda s: F.struct(F.coalesce(list_item(s)["name"], F.when(~s.contains("|"), s)).alias("name"), list_item(s)["url"].alias("url"), list_item(s)["locator"].alias("locator"))
    sources = F.transform(items("sources"), source)
    kept = rows.where(F.coalesce(F.col("meta")["fault_type"], F.lit("")) != "")
    number = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1).cast("long")  # a handful of entries
    m = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    return kept.select(
        number.alias("entry_index"), m("fault_type").alias("fault_type"), m("title").alias("title"), m("applicable").alias("applicable"), items("typical_features").alias("typical_features"), m("frequency_signature").alias("frequency_signature"),
        F.upper(F.nullif(m("frequency_family"), F.lit(""))).alias("frequency_family"), clauses.alias("criteria"), sources.alias("sources"), F.col("name").alias("document"), "body",
    )


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return entries(files.where(F.col("name").endswith(".md")))
