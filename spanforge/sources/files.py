"""Reading and writing records, artifacts, memories, logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.schemas import KINDS, SAMPLE

VIDEO_SUFFIXES = (".mp4", ".mkv", ".webm", ".mov", ".avi", ".m4v")
AUDIO_SUFFIXES = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "webm")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema, one JSON object per line; blank lines are no records, unreadable ones are
    kept as null rows with the line in _corrupt. The schema is given, so nothing is read twice."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def not_done(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of df whose key the output at path does not hold yet, so that a stopped run goes on."""
    spark = df.sparkSession
    if not exists(spark, path):
        return df
    done = spark.read.schema(f"{key} string").json(path).select(F.col(key).alias("_done")).distinct()
    return df.join(done, df[key].cast("string") == done["_done"], "left_anti")


#: Folders that a table is spread over by a hash of its id: their number does not grow with the data.
BUCKETS = 256


def bucket_of(column: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")


def bucketed(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """df with its bucket, all rows of a bucket in one task, so that each folder gets few files. A hot id is split over
    tasks by AQE when the shuffle is rebalanced."""
    return df.withColumn("bucket", bucket_of(column, buckets)).hint("rebalance", F.col("bucket"))


def save_artifacts(facts: dict[str, DataFrame], headers: DataFrame, folder: str) -> None:
    """The facts of each kind and a manifest with their counts, in BUCKETS folders by video."""
    manifest = headers.select("video_id", "duration_seconds", "metadata", F.lit(1).alias("schema_version"))
    for kind, df in facts.items():
        bucketed(df, "video_id").write.mode("overwrite").partitionBy("bucket").json(f"{folder}/{kind}")
        counts = df.groupBy("video_id").agg(F.count(F.lit(1)).alias(f"{kind}_count"))
        manifest = manifest.join(counts, "video_id", "left").withColumn(f"{kind}_count", F.coalesce(f"{kind}_count", F.lit(0)))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def load_artifacts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The manifest and the facts of each kind; a kind that is not there is an empty table."""
    counts = ", ".join(f"{k}_count bigint" for k in KINDS)
    out = {"manifest": spark.read.schema(f"video_id string, duration_seconds double, metadata map<string,string>, schema_version int, {counts}").json(f"{folder}/manifest")}
    for kind, ddl in KINDS.items():
        schema = f"video_id string, ord int, {ddl}"
        path = f"{folder}/{kind}"
        out[kind] = spark.read.schema(f"{schema}, bucket int").json(path).drop("bucket") if exists(spark, path) else spark.createDataFrame([], schema)
    return out


def save_memory(nodes: DataFrame, path: str) -> None:
    """Nodes as Parquet in BUCKETS folders by video: a reader of one video prunes the others."""
    bucketed(nodes, "video_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_memory(spark: SparkSession, path: str, video_id: str | None = None) -> DataFrame:
    """The nodes, or those of one video, of which one folder is read."""
    nodes = spark.read.parquet(path)
    if video_id is not None:
        one = spark.range(1).select(F.lit(video_id).alias("video_id")).select(bucket_of("video_id")).first()[0]
        nodes = nodes.filter((F.col("bucket") == one) & (F.col("video_id") == video_id))
    return nodes.drop("bucket")


def memory_document(spark: SparkSession, path: str, node_schema: str) -> DataFrame:
    """The nodes of memories stored as one JSON document each, with the nodes in a map by id."""
    doc = spark.read.schema(f"video_id string, root_id string, nodes map<string, struct<{node_schema}>>").option("multiLine", "true").json(path)
    return doc.select("video_id", "root_id", F.explode("nodes").alias("node_id", "node")).select("video_id", "root_id", "node_id", "node.*")


def load_samples(spark: SparkSession, path: str, limit: int | None = None, sample_ids=(), video_ids=(), tasks=()) -> DataFrame:
    """Samples under the given lists, an empty one being no filter, in order of video and sample."""
    df = spark.read.schema(SAMPLE).json(path)
    for column, wanted in (("sample_id", sample_ids), ("video_id", video_ids), ("task", tasks)):
        if wanted:
            df = df.filter(F.col(column).isin(*wanted))
    df = df.orderBy("video_id", "sample_id")
    return df if limit is None else df.limit(limit)


def read_log(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{'metadata', 'iterations'} of trajectory logs: JSON lines told apart by their type; lines that
    cannot be read are skipped. Values stay VARIANT, as their shapes vary."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    kind = F.try_variant_get("v", "$.type", "string")
    return {"metadata": rows.filter(kind == "metadata"), "iterations": rows.filter(kind == "iteration")}


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The step rows of session logs, as VARIANT; lines that cannot be read are skipped."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return rows.filter(F.try_variant_get("v", "$.type", "string") == "step")


def find_files(spark: SparkSession, folder: str, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """(stem, path): for every file name without suffix the preferred file under a folder: one right in
    the folder before one deeper down, then the smallest path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).withColumn("_suffix", F.lower(F.regexp_extract("_name", r"(\.[^.]+)$", 1)))
    files = files.filter(F.col("_suffix").isin(*suffixes)).withColumn("stem", F.regexp_replace("_name", r"\.[^.]+$", ""))
    depth = F.size(F.split("path", "/"))
    return files.groupBy("stem").agg(F.min(F.struct(depth.alias("d"), F.col("path").alias("p"))).alias("_f")).select("stem", F.col("_f.p").alias("path"))


def is_audio_path(path):
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*AUDIO_SUFFIXES)


def data_url(content, mime: str = "image/jpeg"):
    """Image bytes as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def training_examples(steps: DataFrame, path: str | None = None) -> DataFrame:
    """Trace steps as (video_id, state, gold_action, observation, next_state), written as JSON if a path is given."""
    out = steps.select("video_id", "state", F.col("action").alias("gold_action"), "observation", "next_state")
    if path:
        out.write.mode("overwrite").json(path)
    return out


def write_trace(steps: DataFrame, path: str) -> None:
    """Appends trace steps in BUCKETS folders by sample; sample and turn stay in the rows."""
    bucketed(steps, "sample_id").write.mode("append").partitionBy("bucket").json(path)


def append_steps(metadata: DataFrame | None, steps: DataFrame, path: str) -> None:
    """The log of a search session: its metadata rows and its step rows, told apart by type, as read_log reads them."""
    for kind, df in (("metadata", metadata), ("step", steps)):
        if df is not None:
            df.select(F.lit(kind).alias("type"), "*").write.mode("append").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)
