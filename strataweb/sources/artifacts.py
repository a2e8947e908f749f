"""Reading and writing captures: manifest, edges, blobs, images, documents of results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content
from ..functions.url import canon_key as url_key
from ..functions.url import url_ext
from ..rules import Rules

MANIFEST = """url string, canon_key string, final_url string, status int, content_type string, url_ext string, sniffed_type string, sha256 string, rendered_sha256 string,
  interacted_sha256 string, length bigint, headers map<string,string>, first_seen_depth int, retries int, idle_timeout boolean, blocked_notice boolean, clicks int, late_mutations int,
  late_mutations_post_click int, closed_shadow_roots int, shadow_roots int, unexplained_interactives int, expand_error string, error string, fetched_at string"""
EDGES = "src string, dst string, how string, hint string, depth int"


#: A row's place: its file, the block of the file it was read in, and its place in the block.
SEQ = "seq struct<file:string,block:bigint,at:bigint>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a seq that orders them as files and their lines are; a missing file is empty, blank lines are left out."""
    try:
        rows = spark.read.schema(schema).json(path)
        return rows.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {SEQ}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/manifest.jsonl", MANIFEST)


def read_edges(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/edges.jsonl", EDGES)


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, content), named by the files; content is read only where it is used."""
    return spark.read.format("binaryFile").load(f"{root}/blobs/*").select(F.element_at(F.split("path", "/"), -1).alias("sha256"), "content")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Spark's image struct by sha256; height is -1 where the body can't be decoded."""
    return spark.read.format("image").option("dropInvalid", False).load(f"{root}/blobs/*").select(F.element_at(F.split("image.origin", "/"), -1).alias("sha256"), "image")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fetched(manifest: DataFrame) -> DataFrame:
    return manifest.filter("sha256 is not null")


def first_rows(manifest: DataFrame) -> DataFrame:
    """Each body's first row decides its type and base URL; a body's rows are reduced before they are shuffled."""
    others = [x for x in manifest.columns if x != "sha256"]
    first = fetched(manifest).groupBy("sha256").agg(F.min_by(F.struct(*others), "seq").alias("_first"))
    return first.select(*(F.col("sha256") if x == "sha256" else F.col("_first")[x].alias(x) for x in manifest.columns))


def content_addressed(bodies: DataFrame) -> DataFrame:
    """(sha256, content) of distinct bodies."""
    return bodies.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])


def records(captures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Manifest rows of captures (url, final_url, status, headers, content, error, depth, retries), of MANIFEST's columns.

    Snapshots come as rendered and interacted (binary), and counters by their names, where captures have them. A capture that failed has
    its key, status and error, and no body. Header names are matched in any case.
    """
    has = lambda x, kind: F.col(x).cast(kind) if x in captures.columns else F.lit(None).cast(kind)
    ok = F.col("content").isNotNull()
    header = F.element_at(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "content-type")), 1)
    sha = lambda x: F.sha2(has(x, "binary"), 256)
    own = {
        "url": F.col("url"), "canon_key": url_key(F.col("url")), "final_url": F.when(ok, F.coalesce(has("final_url", "string"), F.col("url"))), "status": F.col("status"),
        "content_type": F.when(ok, content.header_type(header)), "url_ext": F.when(ok, url_ext(F.col("url"))), "sniffed_type": F.when(ok, content.sniff_type(F.col("content"))),
        "sha256": F.sha2("content", 256), "rendered_sha256": sha("rendered"), "interacted_sha256": sha("interacted"), "length": F.octet_length("content").cast("bigint"),
        "headers": F.when(ok, F.col("headers")), "first_seen_depth": F.col("depth"), "retries": F.col("retries"), "idle_timeout": F.when(ok, F.coalesce(has("idle_timeout", "boolean"), F.lit(False))),
        "blocked_notice": F.when(ok, content.blocked_notice(content.utf8(F.col("content")), rules)), "fetched_at": F.when(ok, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
    }
    fields = T.StructType.fromDDL(MANIFEST).fields
    return captures.select(*((own[f.name] if f.name in own else has(f.name, f.dataType.simpleString())).cast(f.dataType).alias(f.name) for f in fields))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
