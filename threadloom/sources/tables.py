"""Readers, explicit schemas, and the conversation facts that the analyses work on."""

from __future__ import annotations

import base64
import html
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .shipping import ship

MESSAGES = "thread_id string, thread_title string, thread_create_time double, thread_update_time double, node_id string, parent_id string, role string, author_name string, message_create_time double, message_create_time_iso string, text string, text_len long"
THREADS = "thread_id string, thread_title string, thread_create_time double, thread_create_time_iso string, thread_update_time double, thread_update_time_iso string, num_nodes_in_tree long, num_nodes_in_main_path long, num_user_msgs_main_path long, num_assistant_msgs_main_path long, main_path_text_chars long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, quoted line breaks and doubled quotes, under an explicit schema; only ``columns`` are kept."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header, blanks and line breaks kept; a small result as one file, a large one as a file a partition."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quoteAll=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-scratch-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again, so that what uses them several times makes them once."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, for what is run within; afterwards with those it had."""
    had = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_messages(df: DataFrame, path: str) -> None:
    """Messages as Parquet, a folder a role; readers prune by it."""
    df.write.mode("overwrite").partitionBy("role").parquet(path)


def write_transcripts(transcripts: DataFrame, path: str, name: Column, text: str = "transcript") -> None:
    """One folder of text for each thread, called file=<name>, below a path; every executor writes its own threads."""
    transcripts.select(name.alias("file"), F.col(text).alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def report_html(title: str, sections: list[tuple[str, str, DataFrame | bytes | None]], rows: int = 200) -> str:
    """A self-contained HTML page: of each section its heading, its wording, and a small table (up to ``rows`` rows) or a PNG within the page."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for head, words, what in sections:
        out.append(f"<h2>{html.escape(head)}</h2><p>{html.escape(words)}</p>")
        if isinstance(what, bytes):
            out.append(f"<img alt='{html.escape(head)}' src='data:image/png;base64,{base64.b64encode(what).decode()}'>")
        elif what is not None:
            cells = lambda tag, x: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in x) + "</tr>"
            out.append("<table>" + cells("th", what.columns) + "".join(cells("td", r) for r in what.limit(rows).collect()) + "</table>")
    return "".join([*out, "</body></html>"])


def join_unique(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join with a map that must have each key once: a key that has several rows fails the query."""
    rest = [c for c in right.columns if c != on]
    once = right.groupBy(on).agg(F.any_value(F.struct(*rest)).alias("_m"), F.count("*").alias("_n"))
    checked = once.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"{on} isn't unique: "), F.col(on).cast("string"))).cast("boolean")))
    return left.join(checked.select(on, "_m.*"), on)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path), so that any store that Spark reads will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def find_path(spark: SparkSession, name: str, folders: list[str]) -> str | None:
    """The first folder's file of that name; None if no folder has it."""
    for path in (f"{d.rstrip('/')}/{name}" for d in folders):
        fs, at = _file_system(spark, path)
        if fs.exists(at):
            return path
    return None


def find_cluster_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files below a folder whose header has node_id and a cluster column; of each file the header alone is read."""
    fs, at = _file_system(spark, folder)
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.endswith(".csv"):
            head = spark.read.text(path).limit(1).collect()
            cols = {c.strip().strip('"') for c in head[0]["value"].split(",")} if head else set()
            if "node_id" in cols and cols & {"cluster", "fine_cluster", "topic", "macro_domain"}:
                found.append(path)
    return sorted(found)


def write_config(config: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; ValueError if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


EXPORT = "id string, title string, create_time double, update_time double, mapping string"


def _first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that isn't blank, read from its head by Hadoop's file system; "" if there is none."""
    fs, at = _file_system(spark, path)
    if fs.getFileStatus(at).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", ".")))
        return next((c for c in (_first_character(spark, f) for f in files) if c), "")
    with_stream = fs.open(at)
    try:
        while (c := with_stream.read()) >= 0:
            if not chr(c).isspace() and c not in (0xEF, 0xBB, 0xBF):
                return chr(c)
        return ""
    finally:
        with_stream.close()


def read_export(spark: SparkSession, path: str, lines: bool = False, keep_empty: bool = False) -> DataFrame:
    """One row a conversation of a chat export: id, title, create_time, update_time and its map of raw nodes.

    A file must hold a JSON list, which is parsed as a stream and once; with ``lines`` it has one conversation
    a line, and Spark splits it.  Nodes stay JSON text in a map, so that ids become no columns and odd
    shapes don't fail.  Conversations without a non-empty object as mapping are dropped, unless ``keep_empty``.
    """
    if not lines and _first_character(spark, path) not in ("[", ""):
        raise ValueError("an export must be a JSON list")
    rows = export_rows(spark.read.schema(EXPORT).json(path, multiLine=not lines))
    return rows if keep_empty else rows.where(F.size("mapping") > 0)


def export_rows(raw: DataFrame) -> DataFrame:
    """Conversations as read under EXPORT with their nodes as a map of JSON texts, null where there is no object."""
    # mapping is text first, as some have no object there.
    mapping = F.when(F.ltrim("mapping").startswith("{"), F.from_json("mapping", "map<string,string>"))
    return raw.select("id", F.coalesce("title", F.lit("Untitled")).alias("title"), "create_time", "update_time", mapping.alias("mapping"))


def export_counts(export: DataFrame) -> DataFrame:
    """(conversations, skipped, nodes) of an export read with ``keep_empty``: those without nodes count in the total."""
    n = F.greatest(F.coalesce(F.size("mapping"), F.lit(0)), F.lit(0))
    return export.agg(F.count("*").alias("conversations"), F.count_if(n == 0).alias("skipped"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("nodes"))


def content_text(content: Column) -> Column:
    """The text of a message's content (JSON text): parts joined by line breaks, else text, else value, else a bare string; trimmed.

    Of the parts, a string is itself whatever it begins with, an object its text or else its JSON, null is
    None and a number or truth value its wording.
    """
    v = F.try_parse_json(content)
    parts = F.try_variant_get(v, "$.parts", "array<variant>")

    def own(p: Column) -> Column:
        kind = F.schema_of_variant(p)
        text = F.when(kind.startswith("OBJECT"), F.when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")))
        plain = F.when(kind == "STRING", F.try_variant_get(p, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(p, "$", "string")))
        return F.when(p.isNull() | (kind == "VOID"), "None").otherwise(F.coalesce(text, plain, F.to_json(p)))

    joined = F.array_join(F.transform(parts, own), "\n")
    string = lambda at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    # What is no JSON is a bare string, too.
    bare = F.when(v.isNull(), content).otherwise(string("$"))
    found = F.coalesce(joined, string("$.text"), string("$.value"), bare, F.lit(""))
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


def export_nodes(export: DataFrame, *keep: str) -> DataFrame:
    """(thread_id, node_id, parent_id, ts, role, author, text) of every node of an export's conversations, and the columns in ``keep``."""
    e = export.select(F.col("id").alias("thread_id"), *keep, F.explode("mapping").alias("node_id", "node"))
    n = e.withColumn("m", F.get_json_object("node", "$.message"))
    return n.select(
        "thread_id", *keep, "node_id", F.get_json_object("node", "$.parent").alias("parent_id"), F.expr("try_cast(get_json_object(m, '$.create_time') as double)").alias("ts"),
        F.lower(F.get_json_object("m", "$.author.role")).alias("role"), F.get_json_object("m", "$.author.name").alias("author_name"), content_text(F.get_json_object("m", "$.content")).alias("text"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the table ``conversations`` with a derived time (one of eight months by conversation), month, domain and node ids."""
    ts = F.expr("cast(add_months(date'2025-05-01', int(conv_id % 8)) as timestamp_ntz) + make_dt_interval(int((conv_id div 8) % 28), 0, int(turn), 0)")
    domain = ((F.length("text") * 31 + F.col("turn")) % 8).cast("int")
    branch = (F.col("turn") >= 2) & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    parent = F.when(F.col("turn") == 0, None).when(branch, F.concat_ws("-", "conv_id", F.col("turn") - 2)).otherwise(F.concat_ws("-", "conv_id", F.col("turn") - 1))
    c = table(spark, sf_dir, "conversations").withColumn("ts", ts)
    return c.select("conv_id", "turn", "role", "text", "ts", F.date_format("ts", "yyyy-MM").alias("month"), domain.alias("domain"), F.concat_ws("-", "conv_id", "turn").alias("node_id"), parent.alias("parent_id"))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (event_id, thread, ts, day, role, domain)."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant")
    return e.select("event_id", F.col("user_id").alias("thread"), "ts", F.to_date("ts").alias("day"), role.alias("role"), F.col("event_type").alias("domain"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as (row_id, ts, week, role, domain)."""
    n = table(spark, sf_dir, "lineitem")
    role = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, "user").otherwise("assistant")
    return n.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.col("l_shipdate").alias("ts"), X.week_label(F.col("l_shipdate")).alias("week"), role.alias("role"), (F.col("l_partkey") % 5).cast("int").alias("domain"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as (o_orderkey, month, role, domain, value)."""
    o = table(spark, sf_dir, "orders")
    role = F.when(F.col("o_custkey") % 2 == 0, "user").otherwise("assistant")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), role.alias("role"), F.col("o_orderpriority").alias("domain"), F.col("o_totalprice").alias("value"))
