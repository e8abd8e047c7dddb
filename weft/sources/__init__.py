"""Readers, writers and foreign servers: a foreign table is a file source that Spark scans itself, with its own pushdown."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "orc": "orc", "jdbc": "jdbc"}
#: Names of object-store options on a server and what Spark calls them.
S3 = {"s3_region": "endpoint.region", "s3_endpoint": "endpoint", "s3_access_key_id": "access.key", "s3_secret_access_key": "secret.key"}


def format_of(path: str) -> str:
    """By the file's ending; compressed endings and folders of partitions are looked through."""
    for part in reversed(path.rstrip("/*").split("/")):
        for end in reversed(part.removesuffix(".gz").removesuffix(".zst").split(".")[1:]):
            if end.lower() in FORMATS:
                return end.lower()
    return "parquet"


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A table of files: partition columns of a hive layout come from the paths, and filters on them prune folders."""
    kind = kind or format_of(path)
    reader = spark.read.format(FORMATS[kind])
    if kind in ("csv", "tsv"):
        reader = reader.option("header", options.pop("header", True)).option("inferSchema", schema is None)
    if kind == "tsv":
        reader = reader.option("sep", "\t")
    if kind == "json" and options.pop("multiline", False):
        reader = reader.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(FORMATS[kind]).mode(mode)
    if kind in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


@dataclass
class Server:
    """A named foreign server: a wrapper kind and options that its tables inherit."""

    wrapper: str
    options: dict[str, str] = field(default_factory=dict)

    def table(self, spark: SparkSession, schema: str | None, options: dict[str, str]) -> DataFrame:
        o = self.options | options
        if self.wrapper == "jdbc" or "url" in o:
            return spark.read.format("jdbc").options(**{k: v for k, v in o.items() if k not in ("source",)}).option("dbtable", o.get("dbtable", o.get("source", ""))).load()
        for k, v in o.items():
            if k in S3:
                spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.s3a.{S3[k]}", v)
        source = o["source"].replace("s3://", "s3a://")
        df = read(spark, source, o.get("format"))
        if schema:
            names = [c.split()[0] for c in schema.split(",")]
            df = df.select(*names)
        return df
