"""Readers of assembly text and record files, and the record sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARCHITECTURES = ("x86_64", "arm64", "riscv")
LARGEST_FILE = 10 << 20


def files(spark: SparkSession, path: str, pattern: str = "*.s", largest: int = LARGEST_FILE) -> DataFrame:
    """(path, arch, compiler, opt_level, value): one row a file of at most ``largest`` bytes and a known architecture.

    Marks come from ``<arch>/<compiler>/<O?>/`` folders, else from ``.<arch>.`` and the like in the file's name.
    """
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select("value", "_metadata.file_path", "_metadata.file_size")
    mark = lambda names: F.nullif(F.regexp_extract("file_path", rf"[/._-]({'|'.join(names)})(?=[/._-])", 1), F.lit(""))
    out = found.where(F.col("file_size") <= largest).select(
        F.col("file_path").alias("path"), mark(ARCHITECTURES).alias("arch"), mark(("gcc", "clang")).alias("compiler"), mark(("O0", "O1", "O2", "O3", "Os", "Ofast")).alias("opt_level"), "value"
    )
    return out.where(F.col("arch").isNotNull())


def lines(sources: DataFrame) -> DataFrame:
    """(path, arch, line_num, raw): a row a line, numbered from 0; CRLF ends lines too."""
    return sources.select("path", "arch", F.posexplode(F.split("value", "\r?\n")).alias("line_num", "raw"))


def records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines under an explicit schema; blank lines are skipped, malformed ones too unless ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def tolerant_records(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """The readable rows of JSON lines, and (line) of those that are not, so that skips can be counted; blank lines are neither."""
    text = spark.read.text(path).select(F.col("value").alias("line")).where("trim(line) <> ''")
    shown = schema if isinstance(schema, str) else schema.simpleString()
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(shown)
    marked = StructType(list(fields.fields)).add("_bad", "string")
    parsed = text.withColumn("r", F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad IS NULL").select(*(F.col(f"r.{f.name}") for f in fields.fields)), parsed.where("r._bad IS NOT NULL").select("line")


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
