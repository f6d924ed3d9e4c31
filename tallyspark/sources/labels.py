"""Label rows: seed file and feedback table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "description string, direction string, category string, source string"
SEED_SCHEMA = "Description string, Direction string, Category string, Source string"


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with Description, Direction and Category, and Source or else "seed"."""
    head = spark.read.option("header", True).csv(path).columns
    if missing := {"Description", "Direction", "Category"} - set(head):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    rows = spark.read.option("header", True).csv(path)
    source = F.coalesce("Source", F.lit("seed")) if "Source" in head else F.lit("seed")
    return rows.select(F.col("Description").alias("description"), F.col("Direction").alias("direction"), F.col("Category").alias("category"), source.alias("source"))


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, complete) of the versions of a table, oldest first."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return []
    jvm = spark.sparkContext._jvm
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    found = [(int(n[1:]), f"{path}/{n}") for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted((k, folder, fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))) for k, folder in found)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback table, its last complete version; empty if there is none yet."""
    complete = [folder for _, folder, done in _versions(spark, path) if done]
    if not complete:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("header", True).option("escape", '"').csv(complete[-1])


def replace_feedback(rows: DataFrame, path: str) -> None:
    """Writes the table's next version beside the others, as rows may be read from the last one.

    A version counts from when Spark marks it as written; a crash before that leaves the last one as it is. The version
    before stays, older ones go.
    """
    spark = rows.sparkSession
    before = _versions(spark, path)
    rows.write.option("header", True).option("escape", '"').csv(f"{path}/v{(before[-1][0] if before else 0) + 1}")
    complete = [k for k, _, done in before if done]
    for k, folder, _ in before:
        if not complete or k != complete[-1]:
            fs, place = _fs(spark, folder)
            fs.delete(place, True)
