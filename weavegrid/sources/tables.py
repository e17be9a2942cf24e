"""Readers of the engine's inputs, as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weavegrid.functions.text import canonical_id, record_id_in

def position():
    """Where a row stands in the input: its file, the start of its split, and its place among the rows of that.

    Orders rows as their files do, by name of the file, however Spark splits
    and packs them; to be selected where the file is read. A place alone counts
    over all splits of a task and would follow their packing.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


_PAIR = "array<struct<Reference:string,Description:string>>"
#: Fields that may come as text, list or object are read as text and put in order afterwards.
ENTRY_SCHEMA = f"""
ID string, Name string, Abstraction string, Status string, Description string, ExtendedDescription string,
AlternateTerms array<struct<Term:string,Description:string>>, ObservedExamples array<struct<Reference:string,Description:string,Link:string>>,
Top25Examples array<struct<Reference:string,Description:string,Year:string>>,
RelatedWeaknesses array<struct<Nature:string,CweID:string,ViewID:string,Ordinal:string>>,
MappingNotes struct<Usage:string,Rationale:string,Comments:string,Reasons:string,Suggestions:string>,
Notes array<struct<Type:string,Note:string>>, PotentialMitigations array<struct<Phase:string,Effectiveness:string,Strategy:string,Description:string>>
"""
REQUIRED = ("ID", "Name", "Abstraction", "Status", "Description")


def text_list(raw):
    """A text that holds a JSON list, or one value, as an array; null becomes an empty one."""
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).when(F.ltrim(raw).startswith("[") & listed.isNotNull(), listed).otherwise(F.array(raw))


def read_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Knowledge-base entries of a JSON root {"Weaknesses": [...]}, and the rejected ones, which lack a required field."""
    root = spark.read.schema(f"Weaknesses array<struct<{_struct(ENTRY_SCHEMA)}>>").json(path, multiLine=True)
    rows = root.select(F.explode("Weaknesses").alias("e")).select("e.*")
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    good = rows.where(whole)
    note = F.col("MappingNotes")
    good = good.withColumn("entry_id", canonical_id(F.col("ID"))).withColumn(
        "MappingNotes",
        F.when(note.isNotNull(), F.struct(note["Usage"].alias("Usage"), note["Rationale"].alias("Rationale"), note["Comments"].alias("Comments"), text_list(note["Reasons"]).alias("Reasons"), suggestions(note["Suggestions"]).alias("Suggestions"))),
    )
    phase = lambda m: F.struct(text_list(m["Phase"]).alias("Phase"), m["Effectiveness"].alias("Effectiveness"), m["Strategy"].alias("Strategy"), m["Description"].alias("Description"))
    return good.withColumn("PotentialMitigations", F.transform("PotentialMitigations", phase)), rows.where(~whole)


def suggestions(raw):
    """Suggestions as structs of id and comment, whether they come as objects or as texts."""
    return F.transform(
        text_list(raw),
        lambda s: F.struct(
            F.coalesce(canonical_id(F.get_json_object(s, "$.CweID")), canonical_id(s)).alias("CweID"),
            F.coalesce(F.get_json_object(s, "$.Comment"), F.when(~F.ltrim(s).startswith("{"), s)).alias("Comment"),
        ),
    )


def _struct(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def entry_edges(entries: DataFrame) -> DataFrame:
    """src, dst, rel_type, view_id, ordinal of the entries' relations, to entries that exist."""
    rows = entries.select(F.col("entry_id").alias("src"), F.explode("RelatedWeaknesses").alias("r"))
    rows = rows.select("src", canonical_id(F.col("r.CweID")).alias("dst"), F.upper("r.Nature").alias("rel_type"), F.col("r.ViewID").alias("view_id"), F.col("r.Ordinal").alias("ordinal"))
    return rows.join(entries.select(F.col("entry_id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type", "view_id", "ordinal")


def entry_nodes(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("entry_id").alias("id"), F.col("Name").alias("name"), F.col("Abstraction").alias("type"), F.col("Description").alias("description"), F.col("ExtendedDescription").alias("extended_description"), F.transform("AlternateTerms", lambda t: t["Term"]).alias("alternate_terms"))


def read_records(spark: SparkSession, base: str) -> DataFrame:
    """record_id, description, phrases of every record file below ``base`` (year/Nxxx/id.json): one scan for all, joined by id later."""
    rows = spark.read.schema("description string, keyphrases map<string,string>").json(base, multiLine=True, recursiveFileLookup=True, pathGlobFilter="CVE-*.json")
    return rows.select(record_id_in(F.col("_metadata.file_path")).alias("record_id"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(F.transform_values("keyphrases", lambda _, v: text_list(v)), F.create_map().cast("map<string,array<string>>")).alias("phrases"))


def read_documents(spark: SparkSession, base: str, glob: str = "*.md") -> DataFrame:
    """record_id, file, text of Markdown files below ``base``."""
    rows = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.col("_metadata.file_path")
    return rows.select(record_id_in(path).alias("record_id"), F.regexp_extract(path, "[^/]+$", 0).alias("file"), F.col("value").alias("text"))


def record_context(records: DataFrame, references: DataFrame) -> DataFrame:
    """Records with their reference text, null where there is none."""
    return records.join(references.select("record_id", F.col("text").alias("reference")), "record_id", "left")


SIMILARITY_SCHEMA = "record_id string, similarity int, ids string, total int, frequency int, proportion double"


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """Votes of similar records from a headless CSV (gzip too); a list that can't be read is empty."""
    rows = spark.read.schema(SIMILARITY_SCHEMA).csv(path, mode="PERMISSIVE")
    rows = rows.select("*", position().alias("pos"))
    quoted = F.regexp_extract_all("ids", F.lit("""["']([^"']+)["']"""), F.lit(1))
    return rows.withColumn("ids", F.when(F.trim("ids").rlike(r"^\[.*\]$"), quoted).otherwise(F.array().cast("array<string>")))


def read_csv_with(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """The required columns of a CSV, whatever the case of their names; an error names those that are missing."""
    rows = spark.read.csv(path, header=True)
    by_name = {c.strip().lower(): c for c in rows.columns}
    missing = [c for c in required if c.lower() not in by_name]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}; it has {', '.join(rows.columns)}")
    return rows.select(*[F.col(f"`{by_name[c.lower()]}`").alias(c) for c in required])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """record_id and its set of true ids."""
    rows = read_csv_with(spark, path, ["CVE", "New CWE"]).where(F.col("New CWE").startswith("CWE-"))
    return rows.groupBy(F.col("CVE").alias("record_id")).agg(F.sort_array(F.collect_set("New CWE")).alias("ids"))


USAGE_SCHEMA = "cve_id string, stage string, timestamp string, input_length int, input_words int, output_length int, output_words int"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_SCHEMA).csv(path, header=True).select("*", position().alias("pos")).withColumnRenamed("cve_id", "record_id")


def read_results(spark: SparkSession, path: str, value: str) -> DataFrame:
    """record_id and value of a JSON object keyed by record; ``value`` is the DDL of what the keys hold."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("record_id", "value"))
