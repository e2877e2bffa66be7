"""Compile databases, cached graphs and path guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = "array<struct<directory:string,file:string,command:string,arguments:array<string>>>"


def _split(command: Column) -> Column:
    """A shell command's words; quotes hold spaces together and are taken off."""
    words = F.regexp_extract_all(command, F.lit(r"""(?:"(?:\\.|[^"\\])*"|'[^']*'|\\.|[^\s"'\\])+"""), F.lit(0))
    return F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"""^["'](.*)["']$""", "$1"), r"""\\(.)""", "$1"))


def compile_arguments(spark: SparkSession, path: str) -> DataFrame:
    """(file, arguments) of a compile_commands.json: what a parser needs, without compiler, outputs, dependency options and the source itself."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", COMMANDS)).alias("c")).select("c.directory", F.col("c.file").alias("source"), "c.command", "c.arguments")
    raw = F.coalesce("arguments", _split(F.col("command")))
    rest = F.slice(raw, 2, F.greatest(F.lit(0), F.size(raw) - 1))
    # the word after a lone -o, -MF, -MT or -MQ goes with it
    before = F.concat(F.array(F.lit("")), rest)
    pairs = F.zip_with(rest, F.slice(before, 1, F.size(rest)), lambda x, b: F.struct(x.alias("x"), b.alias("b")))
    kept = F.filter(pairs, lambda p: ~p["x"].rlike(r"^(-c|-S|-E|-o.*|-M.*)$") & ~p["b"].isin("-o", "-MF", "-MT", "-MQ") & (p["x"] != F.col("source")))
    absolute = F.when(F.col("source").startswith("/"), F.col("source")).otherwise(F.concat_ws("/", "directory", "source"))
    return rows.select(absolute.alias("file"), F.transform(kept, lambda p: p["x"]).alias("arguments"))


def inside(root: str, path: Column) -> Column:
    """The path, if it lies below root once . and .. are worked off; else an error."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(p))))
    full = F.concat(F.lit("/"), F.array_join(parts, "/"))
    base = root.rstrip("/")
    return F.when((full == base) | full.startswith(base + "/"), full).otherwise(F.raise_error(F.concat(F.lit("outside the project: "), path)))


def fingerprint(files: DataFrame, settings: str = "") -> str:
    """24 hex digits of the names, lengths and times of binaryFile rows, and of the settings: the key of what was made from them."""
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    # a sum of digests is free of order and combines in partitions
    total = files.agg(F.sum(F.conv(F.substring(one, 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string"), F.lit(settings)), 256), 1, 24)).first()[0]


def cached(spark: SparkSession, folder: str, key: str, name: str, make) -> DataFrame:
    """The table ``name`` under the key, read if an earlier run has written it whole, else made and written."""
    path = f"{folder}/{key}/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
