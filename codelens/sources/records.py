"""Record files: JSON lines with a cut-off end, manifests, build profiles; sinks with fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a broken line fails. Else a file's last line may be broken, and is left out; a broken one before it fails.

    Adds file and place, the line's position in its file.
    """
    text = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    parsed = text.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("broken", F.try_parse_json("value").isNull())
    if strict:
        return parsed.select("file", "place", F.when(F.col("broken"), F.raise_error(F.concat(F.lit("a broken line in "), "file"))).otherwise(F.col("r")).alias("r")).select("file", "place", "r.*")
    last = F.max(F.struct("block", "place")).over(Window.partitionBy("file"))
    marked = parsed.withColumn("last", last["place"] == F.col("place"))
    checked = F.when(F.col("broken") & ~F.col("last"), F.raise_error(F.concat(F.lit("a broken line in "), "file"))).otherwise(F.col("r"))
    return marked.where("NOT (broken AND last)").select("file", "place", checked.alias("r")).select("file", "place", "r.*")


def _found(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what a path or pattern finds in any store, sorted; nothing if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((str(x.getPath().toString()), x.isDirectory()) for x in listed or [])


def result_folders(spark: SparkSession, names: str, root: str = ".") -> list[str]:
    """Folders of a comma list of paths and patterns; those that aren't absolute lie below ``root``. A plain path counts even if it isn't there."""
    out: list[str] = []
    for name in filter(None, map(str.strip, names.split(","))):
        full = name if name.startswith("/") or "://" in name else f"{root.rstrip('/')}/{name}"
        out += [p for p, folder in _found(spark, full) if folder] if any(c in full for c in "*?[]") else [full]
    return out


def input_files(spark: SparkSession, names: list[str], default: str, root: str = ".") -> list[str]:
    """The files among ``names``, and for folders the file ``default`` in them; what isn't there is left out."""
    out: list[str] = []
    for name in names:
        full = name if name.startswith("/") or "://" in name else f"{root.rstrip('/')}/{name}"
        for path, folder in _found(spark, full):
            out += [p for p, _ in _found(spark, f"{path}/{default}")] if folder else [path]
    return out


def json_ready(rows: DataFrame) -> DataFrame:
    """(json) of each row: fields by name, null ones kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines, fields by name."""
    json_ready(rows).write.mode(mode).text(path)


def read_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document; an empty table of the schema where there is no file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0]).select(F.col("content").cast("string").alias("t"))
    return found.select(F.from_json("t", schema).alias("r")).select("r.*")


def write_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def write_table(rows: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a header and the columns in this order."""
    rows.select(*columns).write.mode(mode).option("header", True).csv(path)


def _cells(rows: DataFrame, columns: list[str]) -> list[list[str]]:
    return [["" if v is None else str(v) for v in r] for r in rows.select(*columns).toLocalIterator()]


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table."""
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *_cells(rows, columns)])


def latex(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a LaTeX tabular, special characters escaped."""
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", **{c: "\\" + c for c in "&%$#_{}"}}
    clean = lambda x: "".join(special.get(c, c) for c in x)
    body = [" & ".join(map(clean, r)) + r" \\" for r in [columns, *_cells(rows, columns)]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", *body, r"\end{tabular}"])
