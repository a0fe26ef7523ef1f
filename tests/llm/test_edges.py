"""One odd table through every operator and stage: nulls in any column, empty and very long texts, ties, repeated rows, nothing at all, clashing names; and both ways to join."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from loomline.llm import decontaminate, html_text, licenses, line_dedup, minhash_dedup, packing, quality_model, quality_rules, secrets, shards

#: Names that operators use inside, and more columns than they ask for.
CLASHES = "_id long, _drop string, _mark long, _gone long, _hit_id long, _hit_text long, _spans string, _kept boolean, _row string, _BAD_ID int, template long, h long, y int, part int, `order` int, word string, number long, copies int, position long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
N_CLASHES = CLASHES.count(",") + 1


def _rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "é", "A"]) for _ in range(r.randint(2, 4)))
    shared = " ".join(word() for _ in range(60)) + "."
    rows = [(None, None, None, None, None), (None, "without an id " * 9, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "one", None, "s", 3)]
    for k in range(10, 40):
        own = " ".join(word() for _ in range(r.randint(20, 60))) + "."
        rows.append((k, f"{own}\nPosted by {word()} in {word()}\nThanks.\n{shared if k % 3 == 0 else own[::-1]}", "en", "s", 9))
    rows += [rows[10], rows[10], (200, rows[10][1], "en", "s", 9), (201, "long words here " * 40_000, "en", "s", 9), (201, "the same id, another text of its own that stands here", "en", "s", 9)]
    return [x + (None,) * N_CLASHES for x in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    text = next(r[1] for r in _rows() if r[0] == 12)
    return spark.createDataFrame([(1, " ".join(text.split()[:20])), (None, " ".join(text.split()[2:20])), (2, None), (2, ""), (3, "one")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 2), 0) for k in range(10, 40)] + [(None, 1, 0), (11, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def _bag(df):
    return Counter(map(repr, df.collect()))


def _stages(odd, items, labels):
    return {
        "classifier": lambda d: quality_model.score(d, quality_model.train(d, labels)),
        "lines": line_dedup.drop_recurring,
        "near": minhash_dedup.keep_one,
        "clean": lambda d: decontaminate.without_contaminated(d, items),
        "spans": lambda d: decontaminate.without_spans(d, items),
        "rules": quality_rules.cleaned,
    }


@pytest.mark.parametrize("name", ["classifier", "lines", "near", "clean", "spans", "rules"])
def test_all_columns_stay(odd, items, labels, name):
    stage = _stages(odd, items, labels)[name]
    out = stage(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    whole = _bag(odd.select("doc_id", "lang", "source"))
    assert not _bag(out.select("doc_id", "lang", "source")) - whole
    assert stage(odd.limit(0)).count() == 0


def test_rows_of_each_operator(spark, odd, items, tmp_path):
    n = odd.count()
    assert licenses.scan(odd).count() == n and quality_rules.quality(odd).count() == n
    assert minhash_dedup.near_duplicates(odd).count() == n and decontaminate.contamination(odd, items).count() == n
    assert _bag(packing.pack(odd).where("start = 0").select("doc_id")) == _bag(odd.select("doc_id"))
    assert _bag(shards.write_shards(odd, str(tmp_path / "s")).where("start = 0").select("doc_id")) == _bag(odd.select("doc_id"))
    secrets.scan(odd).collect()
    for op in (licenses.scan, quality_rules.quality, minhash_dedup.near_duplicates, packing.pack, secrets.scan):
        assert op(odd.limit(0)).count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0


def test_pipeline_of_odd_rows(odd, items, labels, spark, tmp_path):
    for name, df in (("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.collect()


def test_both_joins_give_the_same_rows(spark, odd, items, tmp_path):
    for op in (minhash_dedup.near_duplicates, minhash_dedup.keep_one, line_dedup.drop_recurring, lambda d, limit: decontaminate.contamination(d, items, limit=limit), lambda d, limit: decontaminate.without_contaminated(d, items, limit=limit), lambda d, limit: decontaminate.without_spans(d, items, limit=limit)):
        small, large = (_bag(op(odd.select("doc_id", "text"), limit=limit)) for limit in (1 << 26, 0))
        assert small == large and sum(small.values())
    kept = ("doc_id", "start", "length", "ids_crc32")
    one, two = (_bag(shards.write_shards(odd, str(tmp_path / f"s{limit}"), limit=limit).select(*kept)) for limit in (1 << 26, 0))
    assert one == two
    pages = spark.createDataFrame([(k, f"https://h{k % 2}.example/", f"<body><nav>no</nav><div class=c{k % 2}><p>text {k} of it</p></div></body>") for k in range(9)], "page_id long, url string, html string")
    assert _bag(html_text.main_text(pages)) == _bag(html_text.main_text(pages, limit=0))


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Before, it stands: Red GREEN--blue one! After it."), (2, "nothing"), (3, None), (4, "red green blue one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue"), (2, "green blue one")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.without_spans(docs, items).collect()}
    assert got == {1: "Before, it stands! After it.", 2: "nothing", 3: None, 4: ""}


def test_a_text_of_a_repeated_id_is_judged_by_itself(spark):
    one = " ".join(f"alpha{k}" for k in range(30))
    rows = [(1, one), (2, one), (2, "another text that nothing is like " * 2), (None, one), (None, "and a last one without an id, of its own")]
    left = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 3 and sum(r.text == one for r in left) == 1


def test_a_window_of_many_items_is_one_row(spark):
    text = " ".join(f"w{k}" for k in range(13))
    items = spark.createDataFrame([(k, text) for k in range(500)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([text] * 50)), (2, "w1 w2")], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (rows[1].n_items, rows[1].n_hit, rows[2].n_items) == (500, 650, 0)


def test_copies_of_a_row_are_dealt_out(spark, tmp_path):
    docs = spark.createDataFrame([(1, "copied text of a row " * 20)] * 200 + [(2, "x")], "doc_id long, text string")
    rows = shards.write_shards(docs, str(tmp_path / "s"), length=16).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    starts = Counter((r.doc_id, r.start) for r in rows)
    assert {n for (i, _), n in starts.items() if i == 1} == {200}
    by_slot = {r.slot: r for r in rows}
    import zlib

    for k, ids in enumerate(shards.read_slots(str(tmp_path / "s"), 7, 100, length=16), 7):
        assert zlib.crc32(ids.astype("<u4").tobytes()) == by_slot[k].ids_crc32


def _text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(n)) + "."


@pytest.mark.parametrize(
    ("line", "docs"),
    [
        ("Of.", 30), ("And ornd.", 30), ("Posted by {} in {}", 30), ("Seven tokens stand here {} again today", 8), ("Only the last token of it is a {}", 8),
        (" ".join(f"tok{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abc'[k // 26]}" for k in range(22)) + " {} " + " ".join(f"end{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(22)), 8),
        (" ".join(f"long{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abc'[k // 26]}" for k in range(55)), 3),
        ("Call 0800-{} today or write to box 17", 8),
    ],
)
def test_recurring_lines_of_any_length(spark, line, docs):
    r = random.Random(5)
    names = ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(2 * docs)]
    own = [_text(r, 40) for _ in range(docs)]
    rows = [(k, f"{own[k]}\n{line.format(names[2 * k], names[2 * k + 1])}") for k in range(docs)]
    got = {x.doc_id: x.text for x in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[k] == own[k] for k in range(1, docs))


def test_lines_that_do_not_recur_stay(spark):
    r = random.Random(6)
    rows = [(k, f"{_text(r, 30)}\nIt was {_text(r, 12)}\nYes.") for k in range(15)]
    got = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in got} == dict(rows)


def test_lines_of_documents_without_an_id(spark):
    r = random.Random(7)
    line = "This line stands in all of these documents today"
    rows = [(None, f"{_text(r, 40)}\n{line}") for _ in range(9)] + [(2**62 + 1, f"{_text(r, 40)}\n{line}")]
    got = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [line in x.text for x in sorted(got, key=lambda x: x.doc_id or 0)] == [False] * 9 + [True]


def test_pages_of_forms_depth_and_hosts_that_differ(spark):
    article = "<h1>Title</h1><p>The first paragraph of the article, which is long enough.</p><p>The second one.</p>"
    want = "Title The first paragraph of the article, which is long enough. The second one."
    pages = [
        (1, "https://a.example/1", f"<body><form id=aspnetForm><div class=menu><a>x</a></div><div class=main>{article}</div><input name=q></form></body>"),
        (2, "https://b.example/1", f"<body><form><label>Name</label><input></form><article>{article}<form><p>Your mail</p></form></article></body>"),
        (3, "https://c.example/1", "<body>" + "<div>" * 300 + f"<div class=text>{article}</div><div class=sidebar>no</div>" + "</div>" * 300 + "</body>"),
        (4, "https://d.example/1", f"<body><div class=old>{article}</div></body>"),
        (5, "https://d.example/2", f"<body><section class=new>{article}</section></body>"),
        (6, "https://e.example/1", f"<body><article>{article * 3000}</article></body>"),
        (7, None, "<body><form><label>Name</label></form></body>"), (7, None, None), (None, "", ""),
    ]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, path int, host string")
    rows = html_text.main_text(df).collect()
    texts = {r.page_id: r.text for r in rows if r.page_id != 7}
    assert [texts[k] for k in (1, 2, 3, 4, 5)] == [want] * 5
    assert texts[6] == " ".join([want] * 3000) and len(rows) == len(pages) and html_text.main_text(df.limit(0)).count() == 0


def test_secrets_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    docs = spark.createDataFrame([(1, "token = 035d50b74778df8409167469942b6500c432a2c9 now")], "doc_id long, text string")
    assert [r.is_secret for r in secrets.scan(docs).collect()] == [True]
