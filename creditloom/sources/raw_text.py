"""Headerless, pipe-separated loan files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.functions.rules import quarter_columns

QUARTER_IN_NAME = r"_(\d{4}Q\d)\.[^.]+$"


def quarter_of_file(name: Column) -> Column:
    """Quarter at the end of a file name, such as 2018Q1; null if there is none."""
    return F.nullif(F.regexp_extract(name, QUARTER_IN_NAME, 1), F.lit(""))


def _read(
    spark: SparkSession,
    paths: str | list[str],
    fields: dict[str, str],
    missing_words: tuple[str, ...],
    with_quarter: bool,
) -> DataFrame:
    # FAILFAST with pruning off makes the one scan also check that every line has exactly the
    # expected number of fields, whichever columns the query goes on to use.
    raw = (
        spark.read.schema(S.text_schema(fields))
        .options(sep="|", mode="FAILFAST", columnPruning="false", header="false")
        .csv(paths)
    )

    def typed(name: str, kind: str) -> Column:
        text = F.col(name)
        if missing_words:
            text = F.when(~text.isin(*missing_words), text)
        # pandas-style text such as "35.0" in a whole-number field still is that whole number
        value = text if kind == "string" else text.try_cast("double") if kind == "double" else (
            F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
        )
        return value.alias(name)

    columns = [typed(n, k) for n, k in fields.items()]
    if not with_quarter:
        return raw.select(*columns)
    quarter = quarter_of_file(F.col("_metadata.file_name"))
    return quarter_columns(raw.select(*columns, quarter.alias("quarter")), F.col("quarter"))


def read_origination(
    spark: SparkSession,
    paths: str | list[str],
    missing_words: tuple[str, ...] = S.MISSING_WORDS,
    with_quarter: bool = False,
) -> DataFrame:
    """Origination records, one per loan; a line without exactly 32 fields fails the read."""
    return _read(spark, paths, S.ORIGINATION_FIELDS, missing_words, with_quarter)


def read_performance(
    spark: SparkSession,
    paths: str | list[str],
    missing_words: tuple[str, ...] = S.MISSING_WORDS,
    with_quarter: bool = False,
) -> DataFrame:
    """Monthly performance records; a line without exactly 32 fields fails the read."""
    return _read(spark, paths, S.PERFORMANCE_FIELDS, missing_words, with_quarter)


def write_raw(df: DataFrame, fields: dict[str, str], path: str) -> None:
    """Write a frame in the positional layout; columns it lacks are left blank."""
    have = set(df.columns)
    df.select(
        *[(F.col(n) if n in have else F.lit(None)).cast("string").alias(n) for n in fields]
    ).write.options(sep="|", header="false", emptyValue="").csv(path)


def require_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Return ``paths`` if all exist, otherwise fail naming every missing one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            missing.append(p)
    if missing:
        raise FileNotFoundError("Missing input(s): " + ", ".join(missing))
    return paths


def quarter_paths(spark: SparkSession, folder: str, quarters: list[str]) -> dict[str, list[str]]:
    """Origination and performance files of the given quarters, checked for existence."""
    folder = folder.rstrip("/")
    found = {
        "origination": [f"{folder}/historical_data_{q}.txt" for q in quarters],
        "performance": [f"{folder}/historical_data_time_{q}.txt" for q in quarters],
    }
    require_paths(spark, found["origination"] + found["performance"])
    return found
