from __future__ import annotations

from loomline.operators import states
from loomline.plans.rules import ArtifactType, Rule
from loomline.plans.scheduler import admit, components, small_components_first
from loomline.sources import readers

T = ArtifactType("T")
NODES = "key long, call string, state string"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_promotion(spark):
    nodes = spark.createDataFrame([(1, "a", "UP_TO_DATE"), (2, "b", "STALE"), (3, "c", "FAILED"), (4, "d", "MISSING"), (5, "e", "STALE"), (6, "f", "STALE")], NODES)
    edges = spark.createDataFrame([(2, 1), (4, 3), (4, 1), (5, 2), (6, 99)], "child long, parent long")
    assert _rows(states.promote(nodes, edges)) == [(1, "UP_TO_DATE"), (2, "READY"), (3, "FAILED"), (4, "FAILED"), (5, "STALE"), (6, "READY")]
    forced = states.force_stale(nodes, edges, nodes.where("key in (1, 3)").select("key"))
    assert [k for k, s in _rows(forced) if s == "STALE"] == [1, 2, 5, 6]


def test_cleanup(spark):
    nodes = spark.createDataFrame([(1, "a", "UP_TO_DATE"), (2, "a", "ORPHAN"), (3, "b", "ORPHAN"), (4, "c", "UP_TO_DATE"), (5, None, "ORPHAN")], NODES)
    assert _rows(states.orphan_actions(nodes)) == [(2, "remove_output"), (3, "remove_call"), (5, "remove_call")]
    edges = spark.createDataFrame([(4, 1), (4, 2)], "child long, parent long")
    assert _rows(states.removable(nodes, edges)) == [("a",)]


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(
        "# made here\nBEGIN IONS\nTITLE=one\nPEPMASS=500.25 10\nCHARGE=2+\n100.5 3\n200 4.5e1\nEND IONS\n\nBEGIN IONS\r\nPEPMASS=1\r\nCHARGE=3-\r\nEND IONS\r\n"
    )
    got = readers.read_mgf(spark, str(tmp_path / "a.mgf"))
    want = [("one", 500.25, 2, [100.5, 200.0], [3.0, 45.0]), (None, 1.0, -3, [], [])]
    assert [tuple(r) for r in got.collect()] == want
    readers.write_mgf(got.coalesce(1), str(tmp_path / "b"))
    assert sorted((tuple(r) for r in readers.read_mgf(spark, str(tmp_path / "b")).collect()), key=str) == sorted(want, key=str)


def test_fasta_and_tsv(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">p1 first\nMKV\nLLA\n>p2\r\nAA\r\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()] == [("p1 first", "MKVLLA"), ("p2", "AA")]
    (tmp_path / "a.tsv").write_text("rank\tq\n1\t0.5\n")
    assert _rows(readers.read_tsv(spark, str(tmp_path / "a.tsv"), "rank int, q double")) == [(1, 0.5)]


def test_schedule():
    a = Rule("a", {"n": int}, {"out": T}, sql="SELECT {n} AS x", resources={"threads": 4})
    b = Rule("b", {"t": T}, {"out": T}, sql="SELECT * FROM {t}")
    wanted = [b(a(1)), a(2)]
    sizes = components(wanted)
    first, second = a(1).call, a(2).call
    assert small_components_first([first, second], sizes) == [second, first]
    assert admit([first, second], {"threads": 8}, {}) == [first, second]
    assert admit([first, second], {"threads": 2}, {}) == [first]
    assert admit([first], {"threads": 4}, {"threads": 1}) == []


def test_lines_and_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomline.operators import tables

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)], "g long, k long, v string")
    assert sorted((r.g, r.k) for r in tables.adjacent_distinct(rows, "v", ["k"], ["g"]).collect()) == [(1, 1), (1, 3), (1, 5), (2, 1)]
    assert rows.withColumn("_first", F.lit(1)).transform(lambda d: tables.adjacent_distinct(d, "v", ["k"], ["g"])).columns[-1] == "_first"
    assert _rows(tables.repeated(rows.where("g = 2"), F.lit(0), "i")) == [] and tables.repeated(rows.where("g = 2"), F.lit(3), "i").count() == 3
    both = tables.pasted(spark.createDataFrame([(1, "x")], "n long, a string"), spark.createDataFrame([(1, "p"), (2, "q")], "n long, b string"), "n")
    assert _rows(both) == [(1, "x", "p"), (2, "", "q")]
    patched = tables.overlaid(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), spark.createDataFrame([("b", None), ("c", 3)], "k string, v long"), "k", "v")
    assert {r.k: r.v for r in patched.collect()} == {"a": 1, "b": None, "c": 3}
    paths = [f"{tmp_path}/{n}" for n in ("one", "two")]
    tables.tee(tables.head(rows, 2, ["g", "k"]), paths)
    assert [_rows(spark.read.parquet(p)) for p in paths] == [[(1, 1, "a"), (1, 2, "a")]] * 2


def test_median_is_exact(spark):
    import random
    import statistics

    import pytest

    from loomline.functions import spectra

    r = random.Random(3)
    for n in (1, 2, 501, 1000):
        values = [round(r.gauss(0, 9), 2) for _ in range(n)] + [1.5] * (n // 3)
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert spectra.exact_median(df, "x", few=20) == pytest.approx(statistics.median(values))
    with pytest.raises(ValueError, match="no values"):
        spectra.fit_recalibration(spark.createDataFrame([], "precursor_ppm double, fragment_ppm double"))
    kept = spark.range(1).select(spectra.above_share(F_array([-1.0, 0.005, 0.01, 1.0])).alias("k")).first().k
    assert kept == [0.01, 1.0]


def F_array(values):
    from pyspark.sql import functions as F

    return F.array(*map(F.lit, values))


def test_labels_sections_and_edges(spark):
    import pytest

    from loomline.operators import runs

    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "label string, key long")
    asked = spark.createDataFrame([("a",), ("a",)], "label string")
    assert sorted(r.key for r in runs.resolve(asked, nodes).collect()) == [1, 3]
    with pytest.raises(runs.UnknownLabels, match="x"):
        runs.resolve(asked.union(spark.createDataFrame([("x",)], "label string")), nodes)
    rows = spark.createDataFrame([("n", "s"), ("n", "s"), ("m", "s"), ("m", None), ("o", None)], "node string, section string")
    assert {r.node: r.section for r in runs.agreed_sections(rows).collect()} == {"n": "s", "m": None, "o": None}


def test_cycles_are_found(spark):
    import pytest

    from loomline.operators import graph

    nodes = spark.range(1, 6).withColumnRenamed("id", "key")
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, spark.createDataFrame([(2, 1), (3, 2), (2, 3)], "child long, parent long"))
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, spark.createDataFrame([(2, 2)], "child long, parent long"))
    levels = {r.key: r.level for r in graph.levels(nodes, spark.createDataFrame([(2, 1), (3, 2), (3, 1), (5, 99)], "child long, parent long")).collect()}
    assert levels == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
