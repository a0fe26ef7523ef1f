"""Reader of mzML spectra: structure by the XML source, binary arrays by a Pandas UDF."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .readers import read_mgf, spectrum_title

#: Terms of the controlled vocabulary of mass spectrometry.
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
FLOAT_64, ZLIB = "MS:1000523", "MS:1000574"
SELECTED_MZ, CHARGE, TITLE = "MS:1000744", "MS:1000041", "MS:1000796"

_TERMS = "cvParam array<struct<_accession: string, _value: string>>"
_SCHEMA = f"""_id string, _index long, {_TERMS},
precursorList struct<precursor: array<struct<selectedIonList: struct<selectedIon: array<struct<{_TERMS.replace(' ', ': ', 1)}>>>>>>,
binaryDataArrayList struct<binaryDataArray: array<struct<binary: string, {_TERMS.replace(' ', ': ', 1)}>>>"""


@F.pandas_udf(ArrayType(DoubleType()))
def _decode(text: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
    def one(t, w, p):
        if t is None:
            return None
        raw = base64.b64decode(t)
        return np.frombuffer(zlib.decompress(raw) if p else raw, "<f8" if w else "<f4").astype(float)

    return pd.Series([one(*row) for row in zip(text, wide, packed, strict=True)], dtype=object)


def _term(terms: Column, accession: str) -> Column:
    """The value of a term; null if it isn't there."""
    return F.get(F.filter(terms, lambda t: t["_accession"] == accession), F.lit(0))["_value"]


def _array(kind: str) -> Column:
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    has = lambda a, term: F.exists(a["cvParam"], lambda t: t["_accession"] == term)
    one = F.get(F.filter(arrays, lambda a: has(a, kind)), F.lit(0))
    return F.coalesce(_decode(F.regexp_replace(one["binary"], r"\s", ""), has(one, FLOAT_64), has(one, ZLIB)), F.array().cast("array<double>"))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_mgf`` for each ``spectrum`` element; precursor fields are null where there is none."""
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(_SCHEMA).load(path)
    ions = F.flatten(F.transform("precursorList.precursor", lambda p: p["selectedIonList"]["selectedIon"]))
    terms = F.get(ions, F.lit(0))["cvParam"]
    return rows.select(
        spectrum_title(_term(F.col("cvParam"), TITLE), F.col("_id"), F.col("_index")).alias("title"),
        _term(terms, SELECTED_MZ).cast("double").alias("pepmass"),
        _term(terms, CHARGE).cast("int").alias("charge"),
        _array(MZ_ARRAY).alias("mz"),
        _array(INTENSITY_ARRAY).alias("intensity"),
    )


def spectra_format(path: str) -> str:
    """``mgf`` or ``mzml``, by the suffix in any case; another one is an error."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in ("mgf", "mzml"):
        raise ValueError(f"{path} is neither MGF nor mzML")
    return suffix


def import_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of a file whose format its suffix must tell; for rules that take paths from users."""
    return (read_mzml if spectra_format(path) == "mzml" else read_mgf)(spark, path)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """mzML by its suffix, in any case; everything else is MGF."""
    return (read_mzml if path.lower().endswith(".mzml") else read_mgf)(spark, path)
