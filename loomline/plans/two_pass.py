"""Search twice: a wide search of the strongest spectra fits an offset and bounds, by which all spectra are corrected and searched again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectra as S
from ..operators import tables
from .rules import ArtifactType, Rules
from .workspace import Workspace

SPECTRA = ArtifactType("Spectra", columns=("spectrum", "mz", "intensities"))
LIBRARY = ArtifactType("Library", columns=("peptide", "mass"))
BOUNDS = ArtifactType("Bounds", columns=("lo", "hi"))
MATCHES = ArtifactType("Matches", columns=("spectrum", "peptide", "rank", "error_ppm"))
FIT = ArtifactType("Fit", columns=("ppm_offset", "precursor_lo", "precursor_hi"))

rules = Rules()


@rules.frame(version="1")
def measured(spark, folder: str) -> SPECTRA:
    """Spectra with masses that are off by about 25 ppm, more or less along the run."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    off = 25 + 3 * F.sin(F.col("vec_id") / 50.0)
    return vectors.select(F.col("vec_id").alias("spectrum"), ((500 + F.col("vec_id") % 997) * (1 + off * 1e-6)).alias("mz"), F.col("embedding").alias("intensities"))


@rules.frame(version="1")
def masses(spark, folder: str) -> LIBRARY:
    return spark.read.parquet(f"{folder}/embeddings.parquet").select((F.col("vec_id") % 997).alias("peptide")).distinct().withColumn("mass", 500.0 + F.col("peptide"))


@rules.frame(version="1")
def strongest(spark, spectra: SPECTRA, k: int) -> SPECTRA:
    return tables.top_by_sum(spectra, "intensities", k, "spectrum").select("spectrum", "mz", "intensities")


@rules.command("SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi")
def window(lo: float, hi: float) -> BOUNDS: ...


@rules.frame(version="1")
def search(spark, spectra: SPECTRA, library: LIBRARY, bounds: BOUNDS) -> MATCHES:
    """Used by both passes, with another lineage each."""
    lo, hi = bounds.first()
    return S.search(spectra, library, lo, hi)


@rules.frame(version="1")
def fit(spark, matches: MATCHES) -> FIT:
    best = S.confident(matches.withColumn("q", F.lit(0.0)), 0.01, "rank", "q")
    return S.fit_recalibration(best, "error_ppm", "error_ppm")


@rules.command("SELECT spectrum, mz / (1 + ppm_offset * 1e-6) AS mz, intensities FROM {spectra} CROSS JOIN (SELECT ppm_offset FROM {fitted})")
def corrected(spectra: SPECTRA, fitted: FIT) -> SPECTRA: ...


@rules.command("SELECT precursor_lo - CAST({margin} AS DOUBLE) AS lo, precursor_hi + CAST({margin} AS DOUBLE) AS hi FROM {fitted}")
def narrowed(fitted: FIT, margin: float) -> BOUNDS: ...


def two_pass(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """(pass, spectrum, peptide, error_ppm) of the best match of each spectrum in either pass."""
    if root is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{shared or tempfile.mkdtemp(prefix='loomline-')}/two_pass"
    work = Workspace(spark, root)
    every, library = rules["measured"](sf_dir), rules["masses"](sf_dir)
    first = rules["search"](rules["strongest"](every, 200), library, rules["window"](-50.0, 50.0))
    found = rules["fit"](first)
    second = rules["search"](rules["corrected"](every, found), library, rules["narrowed"](found, 1.0))
    work.execute([first, second])
    both = tables.concatenated([work.read(n).where("rank = 1").select("spectrum", "peptide", "error_ppm") for n in (first, second)], "pass")
    return both.select("pass", "spectrum", "peptide", F.round("error_ppm", 4).alias("error_ppm"))
