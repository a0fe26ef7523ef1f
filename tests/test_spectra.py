from __future__ import annotations

import base64
import struct
import zlib

from pyspark.sql import functions as F

from loomline.functions import peptides
from loomline.operators import graph
from loomline.sources.mzml import read_spectra


def _binary(values, form, packed, kind):
    raw = struct.pack(f"<{len(values)}{form}", *values)
    terms = [kind, "MS:1000523" if form == "d" else "MS:1000521", "MS:1000574" if packed else "MS:1000576"]
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return "<binaryDataArray>" + "".join(f'<cvParam accession="{t}" value=""/>' for t in terms) + f"<binary>{text}</binary></binaryDataArray>"


def test_mzml(spark, tmp_path):
    full = _binary([100.5, 200.25], "d", True, "MS:1000514") + _binary([1.0, 2.5], "f", False, "MS:1000515")
    ion = '<cvParam accession="MS:1000744" value="433.5"/><cvParam accession="MS:1000041" value="2"/>'
    (tmp_path / "a.mzML").write_text(
        f"""<mzML><run><spectrumList><spectrum id="s=1" index="0"><cvParam accession="MS:1000796" value="first"/><precursorList><precursor><selectedIonList>
<selectedIon>{ion}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList>{full}</binaryDataArrayList></spectrum>
<spectrum id="s=2" index="1"><cvParam accession="MS:1000579" value=""/></spectrum></spectrumList></run></mzML>"""
    )
    rows = [tuple(r) for r in read_spectra(spark, str(tmp_path / "a.mzML")).orderBy("title").collect()]
    assert rows == [("first", 433.5, 2, [100.5, 200.25], [1.0, 2.5]), ("s=2", None, None, [], [])]


def test_digest(spark):
    row = spark.createDataFrame([("AKRPKGGR",)], "s string").select(peptides.digest(F.col("s"), 1).alias("p"), peptides.mass(F.lit("GG")).alias("m"), peptides.mass(F.lit("X")).alias("x")).first()
    assert row.p == ["AK", "AKRPK", "GGR", "RPK", "RPKGGR"] and round(row.m, 3) == 132.053 and row.x is None


def test_later_parents_win(spark):
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "key long")
    edges = spark.createDataFrame([(3, 1, 0), (3, 2, 1), (4, 3, 0), (4, 1, 1)], "child long, parent long, position int")
    settings = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "c", 3)], "key long, name string, value int")
    found = {(r.key, r.name): r.value for r in graph.accumulate(settings, edges, nodes).collect()}
    assert found == {(1, "a"): 1, (1, "b"): 1, (2, "a"): 2, (3, "a"): 2, (3, "b"): 1, (3, "c"): 3, (4, "a"): 1, (4, "b"): 1, (4, "c"): 3}
    prints = graph.fingerprints(nodes.withColumn("recipe", F.lit("r")), edges, "recipe").collect()
    assert len({r.fingerprint for r in prints}) == 3 and len(prints) == 4


def test_formats_are_told_by_suffix(spark):
    import pytest

    from loomline.sources import mzml

    assert mzml.spectra_format("a/b.MGF") == "mgf" and mzml.spectra_format("x.mzML") == "mzml"
    with pytest.raises(ValueError, match="neither"):
        mzml.import_spectra(spark, "x.raw")
