"""Reading documents, transcripts, evaluation sets and calibration corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamkit.functions.text import trimmed


def read_documents(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (documents, rejects): whole .md and .txt files as (path, extension, content), and the
    paths of other files."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    raw = raw.withColumn("extension", F.lower(F.regexp_extract("path", "\\.([^./]+)\\z", 1)))
    known = F.col("extension").isin("md", "txt")
    return raw.where(known), raw.where(~known).select("path", "extension", F.lit("only .md and .txt can be imported").alias("error"))


EVENT = "struct<type:string,message:struct<role:string,content:string>>"
BLOCKS = "array<struct<type:string,text:string>>"


def transcript_events(lines: DataFrame) -> DataFrame:
    """SRC-3: events (path, line, role, text) of JSONL lines (path, line, value).

    Blank lines, lines that are not JSON and events of other types than user and assistant are
    skipped. The text is a string content, whatever it begins with, or the text blocks of a list,
    joined by line ends."""
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    kept = lines.where(trimmed(F.col("value")) != "").withColumn("e", event).where(F.col("e.type").isin("user", "assistant"))
    content = F.col("e.message.content")
    blocks = F.from_json(content, BLOCKS)
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.message.content", "variant"))
    text = trimmed(F.when(kind.startswith("ARRAY"), listed).otherwise(content))
    return kept.select("path", "line", F.coalesce("e.message.role", "e.type").alias("role"), text.alias("text")).where("text <> ''")


def read_transcripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-3: the events of JSONL files, in file order by ``line``."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    return transcript_events(lines)


def flatten_transcript(events: DataFrame, key: str = "path", order: str = "line", max_chars: int = 24_000) -> DataFrame:
    """TR-1, TR-2: one text per session: ``ROLE: text`` by order, parted by empty lines, the last
    ``max_chars`` characters."""
    spoken = F.struct(F.col(order).alias("o"), F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(spoken)), lambda x: x["t"]), "\n\n")
    return events.where("text <> ''").groupBy(key).agg(joined.alias("whole")).select(key, F.expr(f"right(whole, {int(max_chars)})").alias("transcript"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: cases (project_id, query, expected_titles, valid): blank queries and cases without a
    non-blank expected title are not valid."""
    raw = spark.read.schema("project_id string, queries array<struct<query:string,expected_titles:array<string>>>").json(path, multiLine=True)
    cases = raw.select(trimmed(F.col("project_id")).alias("project_id"), F.posexplode("queries").alias("query_id", "q"))
    titles = F.filter(F.transform("q.expected_titles", trimmed), lambda t: t != "")
    out = cases.select("project_id", "query_id", trimmed(F.col("q.query")).alias("query"), titles.alias("expected_titles"))
    return out.withColumn("valid", F.coalesce((F.col("query") != "") & (F.size("expected_titles") > 0), F.lit(False)))


FIXTURE = (
    "struct<id:string,candidate:struct<title:string,content:string,category:string,source:string,tags:array<string>,"
    "entities:array<struct<name:string,type:string>>,relations:array<struct<subject:string,predicate:string,object:string>>>,"
    "expected:struct<vetoed:boolean,rules:array<string>,semantic_score:int,final_score:int,verdict:string,verdict_at:map<string,string>>,candidate_hash:string>"
)


def read_calibration_corpus(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC-5: fixtures, one per row; None, which no gate takes for a pass, if unreadable."""
    try:
        rows = spark.read.schema(f"fixtures array<{FIXTURE}>").json(path, multiLine=True).select(F.explode("fixtures").alias("f")).select("f.*")
        return rows if rows.where("candidate IS NOT NULL").limit(1).count() else None
    except Exception as error:  # a missing file shows as one of several classes
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            return None
        raise
