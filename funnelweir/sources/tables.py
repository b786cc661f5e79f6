"""Table sources and sinks."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: encodings tried for delimited files, in order
ENCODINGS = ["utf-8", "utf-8-sig", "gb18030"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system; globs allowed."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def _twin(path: str) -> list[str]:
    for suffix, other in ((".parquet", ".csv"), (".csv", ".parquet")):
        if path.endswith(suffix):
            return [path, path[: -len(suffix)] + other]
    return [f"{path}.parquet", f"{path}.csv"]


def decoded_lines(lines: DataFrame, encoding: str) -> DataFrame:
    """Lines (value) whose bytes are in ``encoding``, as text; raises if a line is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a line feed is no part of a longer character, so a batch is decoded at once
            raw = b"\n".join(batch.column(0).to_pylist())
            texts = raw.decode(encoding).split("\n") if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "value string")


def read_delimited(spark: SparkSession, path: str, schema=None, sep: str = ",") -> DataFrame:
    """Delimited files in UTF-8, with or without a byte order mark, or GB18030; strings unless a schema is given.

    Files are split by byte ranges: both encodings keep the line feed to itself, so a line
    start is safe wherever a range begins. One count of the lines that are no valid UTF-8
    decides for the whole table. The first line names the columns; lines equal to it (one per
    file) and empty lines are passed over. No session setting is touched.
    """
    lines = spark.read.text(path)
    row = lines.agg(F.count("*").alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("bad")).first()
    if not row["n"]:
        if schema is None:
            raise ValueError(f"{path} has no header")
        return spark.createDataFrame([], schema)
    if row["bad"]:
        lines = decoded_lines(lines, ENCODINGS[-1])
    lines = lines.select(F.regexp_replace("value", "^\ufeff", "").alias("value")).filter(F.length("value") > 0)
    header = lines.first()["value"]
    names = next(csv.reader([header], delimiter=sep))
    given = (schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")) if schema is not None else ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    # as in Spark's own reader a line with too few fields ends in nulls
    parsed = F.from_csv("value", given, {"sep": sep, "mode": "PERMISSIVE"}).alias("r")
    return lines.filter(F.col("value") != header).select(parsed).select("r.*")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema=None) -> DataFrame:
    """Parquet, or its delimited twin when only that exists. ``columns`` prunes the scan."""
    for candidate in _twin(path):
        if not path_exists(spark, candidate):
            continue
        if candidate.endswith(".parquet"):
            df = spark.read.parquet(candidate)
        else:
            df = read_delimited(spark, candidate, schema)
        return df.select(*columns) if columns else df
    raise FileNotFoundError(f"no table at {path}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as a shuffle has, for small files that later steps blow up.

    A compact file is one or a few scan tasks, which would then hold all that is made from its rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet and a delimited twin; the twin is written from the Parquet, so ``df`` runs once."""
    parquet, csv = _twin(path if path.endswith((".parquet", ".csv")) else f"{path}.parquet")
    if not parquet.endswith(".parquet"):
        parquet, csv = csv, parquet
    df.write.mode("overwrite").parquet(parquet)
    df.sparkSession.read.parquet(parquet).write.mode("overwrite").option("header", "true").csv(csv)


def trimmed_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Header cleanup for workbook exports: trimmed names, then renames."""
    return df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(rename or {})


def union_shards(shards: Sequence[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """Union of shards by name, one row per key (the first shard wins, then ``order``)."""
    rank = lambda i: F.lit(i)
    merged = None
    for i, shard in enumerate(shards):
        tagged = shard.withColumn("_shard", rank(i))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    others = [c for c in merged.columns if c not in (key, "_shard")]
    sort_key = F.struct("_shard", *([order] if order else others))
    first = merged.groupBy(key).agg(F.min_by(F.struct(*others), sort_key).alias("_row"))
    return first.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free content digest: row count plus exact sum and xor of row hashes."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(row), F.lit(0)).cast("string").alias("hash_xor"),
    )


def write_manifest(df: DataFrame, path: str, extra: dict | None = None) -> dict:
    """Digest of ``df`` as a one-line JSON file next to the artefact."""
    digest = table_digest(df).first().asDict()
    manifest = {**(extra or {}), **digest, "columns": sorted(df.columns)}
    spark = df.sparkSession
    line = spark.range(1).select(F.lit(json.dumps(manifest, ensure_ascii=False)).alias("value"))
    line.coalesce(1).write.mode("overwrite").text(path)
    return manifest


def check_manifest(df: DataFrame, path: str) -> None:
    """Raise if the table no longer has the content its manifest was written for."""
    recorded = json.loads(df.sparkSession.read.text(path).first()[0])
    current = table_digest(df).first().asDict()
    changed = {k: (recorded.get(k), v) for k, v in current.items() if recorded.get(k) != v}
    if changed:
        raise ValueError(f"content differs from manifest {path}: {changed}")


def count_media(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """Number of media files; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path").agg(F.count("*").alias("images"))


def text_lines(df: DataFrame, key: Column, values: Column) -> DataFrame:
    return df.select(F.concat_ws(" ", key, values).alias("value"))
