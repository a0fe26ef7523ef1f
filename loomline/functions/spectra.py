"""Recalibration of spectra: confident matches, the offset of their errors, and bounds around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that the driver takes for the last step of an exact median.
FEW = 10_000


def confident(rows: DataFrame, fdr: float, rank: str = "rank", q: str = "peptide_q") -> DataFrame:
    """Matches of the first rank with a q-value of at most ``fdr``."""
    return rows.where((F.col(rank) == 1) & (F.col(q) <= fdr))


def _at(rows: DataFrame, column: str, place: int, few: int) -> float:
    """The value at a place (from 0) in order, by narrowing brackets; no task sees more than a sketch or a count."""
    before = 0
    while True:
        values = rows.groupBy(column).agg(F.count("*").alias("n"))
        if values.count() <= few:
            for value, n in sorted(values.collect()):
                before += n
                if place < before:
                    return value
            raise IndexError(place)
        n = rows.count()
        share = (place - before) / n
        lo, hi = rows.agg(F.percentile_approx(column, [max(0.0, share - 0.02), min(1.0, share + 0.02)], 1000)).first()[0]
        below, inside = rows.agg(F.count_if(F.col(column) < lo), F.count_if(F.col(column).between(lo, hi))).first()
        if before + below <= place < before + below + inside:
            rows, before = rows.where(F.col(column).between(lo, hi)), before + below
        elif place < before + below:
            rows = rows.where(F.col(column) < lo)
        else:
            rows, before = rows.where(F.col(column) > hi), before + below + inside


def exact_median(rows: DataFrame, column: str, few: int = FEW) -> float:
    """The median of the values that aren't null (of two middle ones the mean); no rows are an error."""
    rows = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        raise ValueError(f"no values of {column}")
    return (_at(rows, "x", (n - 1) // 2, few) + _at(rows, "x", n // 2, few)) / 2


def fit_recalibration(matches: DataFrame, precursor: str = "precursor_ppm", fragment: str = "fragment_ppm") -> DataFrame:
    """(ppm_offset, precursor_lo, precursor_hi, fragment_lo, fragment_hi): the median precursor error, and the least and greatest of both errors from it.

    Without a match nothing can be fitted: that is an error.
    """
    offset = exact_median(matches, precursor)
    p, f = F.col(precursor).cast("double") - offset, F.col(fragment).cast("double") - offset
    return matches.agg(
        F.lit(offset).alias("ppm_offset"), F.min(p).alias("precursor_lo"), F.max(p).alias("precursor_hi"), F.min(f).alias("fragment_lo"), F.max(f).alias("fragment_hi")
    )


def above_share(intensities: Column, share: float = 0.01) -> Column:
    """The intensities of at least a share of the largest; those below 0 stand for none and are dropped."""
    given = F.filter(intensities, lambda x: x >= 0)
    return F.filter(given, lambda x: x >= share * F.array_max(given))


def search(observed: DataFrame, library: DataFrame, lo: float, hi: float) -> DataFrame:
    """(spectrum, peptide, rank, error_ppm): library masses whose error is within ``lo`` .. ``hi`` ppm, best first.

    ``observed(spectrum, mz)``, ``library(peptide, mass)``.  A range join by equal bins of
    the logarithm: a bin is as wide as the widest error, so that a match lies in the
    same or a neighbouring bin.
    """
    width = max(abs(lo), abs(hi), 1e-3) * 1.1e-6
    place = lambda c: F.floor(F.log(c) / width)
    known = library.select("peptide", "mass", F.explode(F.array(*(place(F.col("mass")) + k for k in (-1, 0, 1)))).alias("bin"))
    near = observed.select("spectrum", "mz", place(F.col("mz")).alias("bin")).join(known, "bin")
    error = (F.col("mz") - F.col("mass")) / F.col("mass") * 1e6
    found = near.withColumn("error_ppm", error).where(F.col("error_ppm").between(lo, hi))
    best = Window.partitionBy("spectrum").orderBy(F.abs(F.round("error_ppm", 6)), "peptide")
    return found.withColumn("rank", F.row_number().over(best)).select("spectrum", "peptide", "rank", "error_ppm")
