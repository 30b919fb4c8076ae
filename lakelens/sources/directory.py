"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.config import Settings
from lakelens.functions import text as T
from lakelens.sources.files import SharedFiles

# fixed values: folders never worth indexing
EXCLUDED = (
    ".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", "site-packages",
)


def wanted(files: DataFrame, settings: Settings) -> DataFrame:
    """Rows (path, length) that pass the folder, suffix and size filters. Paths are relative: only parts below the root count."""
    parts = F.split("path", "/")
    kept = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED)))).where(F.col("length") <= settings.max_file_bytes)
    return kept.where(T.suffix(F.col("path")).isin(*sorted(settings.suffixes))) if settings.suffixes else kept


def read_tree(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """(path, text): files below a folder; malformed UTF-8 is replaced, line ends are normalised.

    Folder, suffix and size filters apply before contents are decoded.
    """
    base = SharedFiles(spark, root).root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.expr(f"substring(path, {len(base.rstrip('/')) + 2})")
    slim = raw.select(relative.alias("path"), "length", "content")
    return wanted(slim, settings).select("path", T.normalise_newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sarif): report files, each whole."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sarif"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from a JSON list: query, expect, mode, relevant."""
    return spark.read.schema("query string, expect string, mode string, relevant map<string,double>").json(path, multiLine=True)
