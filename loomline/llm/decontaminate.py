"""Benchmark decontamination by a broadcast set of normalised test n-grams.

A window of ``WINDOW`` words contains a whole gram of ``GRAM`` words that starts at a
multiple of ``WINDOW - GRAM + 1``; so a document is probed at those positions only.
Probes go through a broadcast hash join with the grams of all windows; only around
the few hits are whole windows hashed, joined with the set of windows and compared
word by word.  Items of fewer words are windows of their own length, probed in the
same way.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, ascii_lower, broadcast_if, cut, free_name, let

WINDOW, GRAM = 13, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Estimated bytes of a window row, for the check before a broadcast.
_WINDOW_BYTES = 400


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def _gram(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *(w[at + k] for k in range(n)))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, size, item_ids) for each distinct window; item_ids: of the items that have it, without nulls."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    span = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    return span.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.slice("w", i + 1, F.col("size")))).alias("words")).groupBy("words", "size").agg(F.collect_set("item_id").alias("item_ids"))


def _probe_at(size: int) -> tuple[int, int]:
    gram = min(GRAM, size)
    return gram, size - gram + 1


def _probes(w: Column, size: int) -> Column:
    """Position, gram hash and surroundings of every probe for windows of ``size`` words."""
    gram, step = _probe_at(size)

    def probe(i: Column) -> Column:
        first = F.greatest(i - step + 1, F.lit(0))
        return F.struct(
            F.lit(size).alias("size"), i.alias("at"), _gram(w, i, gram).alias("gram"),
            F.slice(w, first + 1, i - first + F.lit(size)).alias("near"), first.alias("first"),
        )

    return F.transform(F.sequence(F.lit(0), F.size(w) - gram, F.lit(step)), probe)


def _grams(w: Column, size: int) -> Column:
    gram, step = _probe_at(size)
    return F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda i: _gram(w, i, gram))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, _text, n_words, spans, item_ids, copies) for each distinct (doc_id, text) of ``docs(doc_id, text)``.

    spans: the distinct (start, size) of windows that occur; item_ids: of the items that
    have these.  A window that many items share is one row here.  Tables of windows
    beyond ``limit`` bytes are joined by a shuffle instead of a broadcast.
    """
    table = cut(windows(items, window), few=True)
    counts = table.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.size("item_ids")).alias("ids")).collect()
    sizes = {r["size"]: r["n"] for r in counts}
    total, listed = sum(sizes.values()), max(1, sum(r["ids"] for r in counts))
    header = F.array(F.struct(F.lit(-1).alias("size"), F.lit(-1).alias("at"), F.lit(None).cast("long").alias("gram"), F.array().cast("array<string>").alias("near"), F.lit(0).alias("first")))

    def probes(w: Column) -> Column:
        """A header that stands for the document, and the probes of each window length that there is."""
        out = [header]
        for size in sorted(sizes):
            out.append(F.when(F.size(w) >= size, _probes(w, size)).otherwise(F.array_remove(header, header[0])))
        return F.concat(*out)

    w = words(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), let(w, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), probes(x).alias("p"))).alias("x"))
    rows = rows.select("doc_id", "_text", F.col("x.n_words").alias("n_words"), F.explode("x.p").alias("p")).select("doc_id", "_text", "n_words", "p.*")

    if sizes:
        grams = None
        for size in sorted(sizes):
            g = table.where(F.col("size") == size).select(F.lit(size).alias("g_size"), F.explode(_grams(F.col("words"), size)).alias("g"))
            grams = g if grams is None else grams.unionByName(g)
        grams = broadcast_if(grams.distinct(), total * max(map(_probe_step, sizes)), 48, limit)
        rows = rows.join(grams, (F.col("size") == F.col("g_size")) & (F.col("gram") == F.col("g")), "left").where("size = -1 or g is not null")
        starts = F.when(F.col("size") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("near") - F.col("size"), F.lit(0))))
        rows = rows.withColumn("k", F.explode(starts)).withColumn("near", F.slice("near", F.col("k") + 1, F.greatest("size", F.lit(0))))
        known = broadcast_if(table.select(F.col("size").alias("k_size"), F.col("words").alias("k_words"), F.xxhash64("words").alias("k_hash"), "item_ids"), listed, 8 + _WINDOW_BYTES * total // max(1, listed), limit)
        rows = rows.withColumn("hash", F.when(F.col("size") > 0, F.xxhash64("near")))
        # Equal hashes are verified on the words.
        rows = rows.join(known, (F.col("hash") == F.col("k_hash")) & (F.col("size") == F.col("k_size")) & (F.col("near") == F.col("k_words")), "left")
        span = F.when(F.col("k_hash").isNotNull(), F.struct((F.col("first") + F.col("k")).alias("start"), "size"))
        ids = F.array_distinct(F.flatten(F.collect_set("item_ids")))
    else:
        span, ids = F.lit(None).cast("struct<start:int,size:int>"), F.first(F.array().cast("array<bigint>"))
    # Equal lists of items count once; spans are as many as a text has places.
    return rows.groupBy("doc_id", "_text").agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), ids.alias("item_ids"), F.count_if(F.col("size") < 0).alias("copies"))


def _probe_step(size: int) -> int:
    return _probe_at(size)[1]


def hit_words(spans: Column) -> Column:
    """How many words lie in any of the (start, size) spans."""
    ends = F.transform(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("end"))))), lambda s: s)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        ends,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")
        ),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A document is contaminated if words are hit and they are a twentieth of its words
    or more.  Null and empty texts have no words and no hits; null or wordless items
    have no window; a null item_id still hits but isn't listed among the items;
    repeated items count once; long texts are probed whole; repeated rows each get
    their row; other columns are ignored; empty ``docs`` give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = hits(docs, items, window, limit)
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    out = found.select(
        "doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "_text", "copies",
    )
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies", "_text")


def _judged(docs: DataFrame, items: DataFrame, window: int, limit: int) -> tuple[DataFrame, str, str]:
    """(id, text hash, spans, n_words) of the texts of ``docs`` that are hit, kept; and the names of the first two, which ``docs`` hasn't."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, limit)
    ident, key = free_name(docs, "_hit_id"), free_name(docs, "_hit_text")
    return cut(found.where(F.size("spans") > 0).select(F.col("doc_id").alias(ident), F.col("_text").alias(key), "spans", "n_words"), few=True), ident, key


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark text.

    A row goes if its text has a whole window of ``window`` words in common with an
    item, or if it is contaminated (see ``contamination``).  Hits of items of fewer
    words, below a twentieth of the text, are left: a few words in a row occur by chance.
    A row is judged by its own text: rows sharing a doc_id don't affect each other.
    Null and empty texts stay; empty ``docs`` or ``items`` are no fault.
    """
    found, ident, key = _judged(docs, items, window, limit)
    n = hit_words(F.col("spans"))
    bad = found.where(F.exists("spans", lambda s: s["size"] >= window) | (20 * n >= F.col("n_words"))).select(ident, key)
    bad = broadcast_if(bad, bad.count(), 32, limit)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(key))
    return docs.join(bad, match, "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with all their columns, and ``text`` without the words that are hit, each with what parts it from the word before.

    Texts without hits, null and empty ones don't change; rows are judged as by
    ``without_contaminated``.
    """
    found, ident, key = _judged(docs, items, window, limit)
    spans = free_name(docs, "_spans")
    found = found.select(ident, key, F.col("spans").alias(spans))
    rows = docs.join(broadcast_if(found, found.count(), 256, limit), F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(key)), "left")

    def rest(hit: Column) -> Column:
        """What parts the words is one longer than the words."""
        own, between = F.regexp_extract_all("text", F.lit(ANY_CASE), F.lit(0)), F.split("text", ANY_CASE)
        # One mark for each word, in order of the places.
        gone = F.array_distinct(F.flatten(F.transform(hit, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
        kept = F.transform(own, lambda w, i: F.when(F.array_contains(gone, i), F.lit("")).otherwise(F.concat(F.get(between, i), w)))
        return F.concat(F.array_join(kept, ""), F.element_at(between, -1))

    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(rest(F.col(spans)))
    return rows.withColumn("text", text).select(*docs.columns)
