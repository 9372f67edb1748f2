"""Document scans of JSON Lines, JSON, CSV and text files, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import textudf

# fixed values: names of fields that hold a record's text and its id
TEXT_FIELDS = ["text", "body", "content", "message", "abstract", "article", "full_text", "plain_text", "document"]
ID_FIELDS = {"jsonl": ["id", "sample_id", "audit_id"], "csv": ["id", "Message-ID", "message_id"]}
MOST_FIELD_CHARS = 32 << 20


def main_text(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The first text field that isn't blank, else the longest string of over 40 characters."""
    strings = [n for n, kind in df.dtypes if kind == "string" and not n.startswith("_")]
    named = [F.when(F.trim(f"`{n}`") != "", F.col(f"`{n}`")) for n in (fields or TEXT_FIELDS) if n in strings]
    if not strings:
        return F.lit(None).cast("string")
    longest = F.array_max(F.array(*(F.struct(F.coalesce(F.length(f"`{n}`"), F.lit(0)).alias("n"), F.col(f"`{n}`").alias("v")) for n in strings)))
    return F.coalesce(*named, F.when(longest["n"] > 40, longest["v"]))


def record_id(df: DataFrame, kind: str, path: Column) -> Column:
    """A named id; else the file's stem and the place of the row in it."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    named = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in ID_FIELDS.get(kind, []) if n in df.columns]
    return F.coalesce(*named, F.concat(stem, F.lit("_"), F.substring(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_")))), 256), 1, 12)))


def _shape(df: DataFrame, kind: str, path: Column, fields: list[str] | None = None) -> DataFrame:
    others = [c for c in df.columns if not c.startswith("_")]
    return df.select(record_id(df, kind, path).alias("source_id"), path.alias("source_path"), main_text(df, fields).alias("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in others))).alias("metadata"), F.lit(None).cast("string").alias("read_error"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """Objects, a line each; blank lines are skipped. strict: a line that isn't an object fails the read, else it is kept in
    _corrupt_record."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON: a list, an object with a list under data, or one object; paragraphs[].context are rows of their own in
    place of the object around them."""
    df = spark.read.option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))
    if "data" in df.columns and dict(df.dtypes)["data"].startswith("array"):
        df = df.select("_path", F.explode("data").alias("_x")).select("_path", "_x.*")
    if "paragraphs" in df.columns:
        kept = [c for c in df.columns if c not in ("paragraphs", "_path")]
        df = df.select("_path", *kept, F.explode_outer("paragraphs").alias("_p")).select("_path", *kept, F.col("_p.context").alias("context"))
        return _shape(df, "jsonl", F.col("_path"), ["context", *TEXT_FIELDS])
    return _shape(df, "jsonl", F.col("_path"))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """columns: the header must be just these, in order."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=MOST_FIELD_CHARS, recursiveFileLookup=True)
    df = reader.csv(path)
    if columns and df.columns != columns:
        raise ValueError(f"header is {df.columns}, not {columns}")
    return df


def read_texts(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """A row a file; blank files are dropped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path, wholetext=True)
    return rows.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def variant_text(v: Column, fields: list[str] = TEXT_FIELDS) -> Column:
    """Of an object as a variant: the first named string that isn't blank, else its longest string of over 40 characters."""
    strings = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.schema_of_variant(x) == "STRING")
    plain = F.transform_values(strings, lambda _, x: x.cast("string"))
    named = [F.when(F.trim(F.try_element_at(plain, F.lit(n))) != "", F.try_element_at(plain, F.lit(n))) for n in fields]
    longest = F.array_max(F.transform(F.filter(F.map_values(plain), lambda x: F.length(F.trim(x)) > 40), lambda x: F.struct(F.length(x).alias("n"), x.alias("v"))))
    return F.coalesce(*named, longest["v"])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """source_id, source_path, text, metadata, read_error of all .jsonl, .json, .csv, .txt, .text and .md files below a folder.

    Lines and files that can't be parsed are rows with read_error. Of a .json file the items of a list, of the list under data, or
    the one object are rows; paragraphs of an item stand in its place. Ids are those of a record, else the stem and a digest."""
    parts = []
    for kind, pattern in (("jsonl", "*.jsonl"), ("json", "*.json"), ("csv", "*.csv"), ("text", "*.{txt,text,md}")):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        if kind == "text":
            df = reader.text(path, wholetext=True).where(F.trim("value") != "").withColumn("_path", F.col("_metadata.file_path"))
            parts.append(_shape(df.withColumnRenamed("value", "text"), kind, F.col("_path")))
        elif kind == "csv":
            if reader.format("binaryFile").load(path).select("path").isEmpty():
                continue  # without a file there is no header to read
            df = reader.format("csv").options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=MOST_FIELD_CHARS).load(path)
            if df.columns:
                parts.append(_shape(df.withColumn("_path", F.input_file_name()), kind, F.col("_path")))
        else:
            whole = reader.text(path, wholetext=kind == "json").where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_path"), F.try_parse_json("value").alias("v"), F.sha2("value", 256).alias("h"))
            as_list = lambda v, at: F.try_variant_get(v, at, "array<variant>")
            items = whole.select("_path", "h", F.explode(F.coalesce(as_list(F.col("v"), "$"), as_list(F.col("v"), "$.data"), F.array("v"))).alias("v")) if kind == "json" else whole
            if kind == "json":
                inner = as_list(F.col("v"), "$.paragraphs")
                items = items.select("_path", "h", F.explode(F.coalesce(inner, F.array("v"))).alias("v"), inner.isNotNull().alias("within"))
            else:
                items = items.withColumn("within", F.lit(False))
            is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
            named = [F.nullif(F.trim(F.try_variant_get("v", f"$.{n}", "string")), F.lit("")) for n in ID_FIELDS["jsonl"]]
            stem = F.regexp_replace(F.element_at(F.split("_path", "/"), -1), "\\.[^.]*$", "")
            metadata = F.when(is_object, F.to_json("v"))
            read = items.select(
                F.coalesce(*named, F.concat(stem, F.lit("_"), F.substring(F.sha2(F.coalesce(F.to_json("v"), "h"), 256), 1, 12))).alias("source_id"), F.col("_path").alias("source_path"),
                F.when(is_object, F.when(F.col("within"), variant_text(F.col("v"), ["context", *TEXT_FIELDS])).otherwise(variant_text(F.col("v")))).alias("text"),
                metadata.alias("metadata"), F.when(~is_object, F.lit("not a JSON object")).alias("read_error"), F.col("v").isNull().alias("bad"),
            )
            # items of a list that aren't objects are no records; a file or line that isn't JSON is an error
            parts.append((read.where(F.col("bad") | F.col("read_error").isNull()) if kind == "json" else read).drop("bad"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """source_id, source_path, text, read_error of journal articles as JATS XML in JSON lines: the XML is under data, as a string
    or the longest string of a list, or else the record's text. Records without a PMC id are rows with read_error."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("source_path"), F.try_parse_json("value").alias("v"))
    one = F.when(F.schema_of_variant(F.try_variant_get("v", "$.data", "variant")) == "STRING", F.try_variant_get("v", "$.data", "string"))
    several = F.filter(F.try_variant_get("v", "$.data", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    longest = F.array_max(F.transform(several, lambda x: F.struct(F.length(x.cast("string")).alias("n"), x.cast("string").alias("v"))))["v"]
    payload = F.coalesce(F.nullif(one, F.lit("")), F.nullif(longest, F.lit("")), variant_text(F.col("v")))
    parts = lines.select("source_path", textudf.article_parts(payload).alias("x"))
    pmcid, found = F.get("x", F.lit(0)), F.get("x", F.lit(0)) != ""
    return parts.select(F.when(found, pmcid).alias("source_id"), "source_path", F.when(found, F.get("x", F.lit(1))).alias("text"), F.when(~found, F.lit("no PMC id")).alias("read_error"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """_id, text of a retrieval corpus: title and text, an empty line between; ids must be unique."""
    df = spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(path)
    bad = df.groupBy("_id").count().where("`count` > 1 OR _id IS NULL").limit(1).count()
    if bad:
        raise ValueError("an _id is missing or occurs twice")
    return df.select("_id", F.concat_ws("\n\n", F.nullif("title", F.lit("")), "text").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Committed as a whole: readers see all files or none."""
    df.write.mode("append" if append else "overwrite").json(path)
