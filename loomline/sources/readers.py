"""Readers and a writer of text formats, as DataFrame expressions over split records.

Records are split by the text source (``lineSep``), so files of any size are read in
parallel and nothing passes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[0-9.]+(?:[eE][-+]?\d+)?"
_PEAK = rf"(?m)^[ \t]*({_NUMBER})[ \t]+({_NUMBER})"


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(title, pepmass, charge, mz, intensity) for each ``BEGIN IONS`` block.

    A field that is absent is null; a charge of ``2-`` is -2; a block without peaks has
    empty arrays; text outside of blocks is ignored.
    """
    rows = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    block = F.substring_index("value", "BEGIN IONS", -1)
    rows = rows.select(F.regexp_replace(block, "\r", "").alias("b"))

    def header(name: str, value: str) -> Column:
        return F.nullif(F.regexp_extract("b", rf"(?m)^[ \t]*{name}=[ \t]*({value})", 1), F.lit(""))

    digits = header("CHARGE", r"\d+").cast("int")
    sign = F.when(F.col("b").rlike(r"(?m)^[ \t]*CHARGE=[ \t]*\d+-"), -1).otherwise(1)
    return rows.select(
        F.trim(header("TITLE", ".*")).alias("title"),
        header("PEPMASS", _NUMBER).cast("double").alias("pepmass"),
        (digits * sign).alias("charge"),
        F.regexp_extract_all("b", F.lit(_PEAK), F.lit(1)).cast("array<double>").alias("mz"),
        F.regexp_extract_all("b", F.lit(_PEAK), F.lit(2)).cast("array<double>").alias("intensity"),
    )


def write_mgf(spectra: DataFrame, path: str) -> None:
    """Spectra as ``read_mgf`` gives them, one block each; null fields are left out."""
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat_ws(" ", p["mz"], p["intensity"])), "\n")
    charge = F.concat(F.abs("charge"), F.when(F.col("charge") < 0, F.lit("-")).otherwise(F.lit("+")))
    lines = F.concat_ws(
        "\n",
        F.lit("BEGIN IONS"),
        F.concat(F.lit("TITLE="), "title"),
        F.concat(F.lit("PEPMASS="), F.col("pepmass").cast("string")),
        F.concat(F.lit("CHARGE="), charge),
        F.nullif(peaks, F.lit("")),
        F.lit("END IONS"),
    )
    spectra.select(lines.alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) for each record; sequence lines are joined without white space."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    record = F.regexp_replace("value", "^>|\r", "")
    return rows.select(
        F.trim(F.substring_index(record, "\n", 1)).alias("header"),
        F.regexp_replace(F.regexp_replace(record, r"\A[^\n]*", ""), r"\s+", "").alias("sequence"),
    )


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; the declared schema saves a pass over the data."""
    return spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def spectrum_title(title: Column, ident: Column, index: Column) -> Column:
    """The title, else the id, else ``spectrum_`` and the index."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(ident, F.lit("")), F.concat(F.lit("spectrum_"), index.cast("string")))
