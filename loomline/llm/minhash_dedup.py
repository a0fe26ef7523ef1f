"""MinHash near-dedup with b-bit signatures.

1. One pass sketches each text: ``HASHES`` minima of its shingle set, their low
   ``BITS`` bits packed into longs, ``BANDS`` band keys of ``ROWS`` full minima.
2. Equal word sequences collapse to one class; only its smallest document goes on.
3. Documents sharing a band key are candidates.  A bucket is never expanded into
   all pairs: its members are compared with a hub, members that are linked so far get
   one label, and pairs under different labels are found exactly by a prefix join of
   the members' differences from the hub, rare ones first.
4. Candidates pass a bit-count estimate (corrected for chance agreement of low bits,
   with a margin of six standard deviations), then an exact check on full sets.

Bands are as many and as wide as a miss of a pair at the threshold allows: its
probability is below ``MISS``, and less above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, broadcast_if, cut, free_name, lean
from .components import connected_components

HASHES, BITS, MISS = 128, 2, 1e-6
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CACHE = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: _WordHashes, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter sequence is one shingle, no word gives none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    n = min(len(h), width)
    s = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        s = _mix((s + _GOLD) ^ h[i : len(h) - n + 1 + i])
    return np.unique(s)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    a = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    return a, _mix(a)


def minima(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` minima (32 bits each) of a non-empty set."""
    a, b = _seeds()
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[i : i + 512, None] * a + b).min(axis=0))
    return low >> np.uint64(32)


def pack(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of all minima, packed into longs."""
    per = 64 // BITS
    part = (low & np.uint64((1 << BITS) - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(part << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands miss a pair at the threshold with a probability below ``MISS``."""
    for rows in range(8, 0, -1):
        for bands in range(1, HASHES // rows + 1):
            if (1 - threshold**rows) ** bands < MISS:
                return bands, rows
    raise ValueError("the threshold is too low for the number of hashes")


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * _GOLD
    for i in range(rows):
        key = _mix((key + _GOLD) ^ low[i : bands * rows : rows])
    return key


_LONGS = pa.list_(pa.int64())
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("text_key", pa.string()), ("sig", _LONGS), ("bands", _LONGS)])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        yield i.as_py(), t.as_py()


def _sketcher(width: int, threshold: float):
    bands, per_band = banding(threshold)

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SKETCH, strict=True)], schema=_SKETCH)
            rows.clear()
            return batch

        for batch in batches:
            for i, t in _texts(batch):
                words = words_of(t)
                if words:
                    s = shingle_set(words, hashes, width)
                    low = minima(s)
                    rows.append((i, len(s), xxhash.xxh3_128_hexdigest(b" ".join(words)), pack(low).view(np.int64), band_keys(low, bands, per_band).view(np.int64)))
                else:
                    rows.append((i, 0, None, None, None))
                if len(rows) == 2000:
                    yield out()
        if rows:
            yield out()

    return sketch


def _setter(width: int):
    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for i, t in _texts(batch):
                s = shingle_set(words_of(t), hashes, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([s], _LONGS)], names=["doc", "shingles"])

    return sets


def matches(a: Column, b: Column) -> Column:
    """How many of the packed low-bit groups of two signatures are equal."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones -= (ones >> 63) << 64
    total = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        differs = x
        for i in range(1, BITS):
            differs = differs.bitwiseOR(F.shiftrightunsigned(x, i))
        total = total + F.lit(64 // BITS) - F.bit_count(differs.bitwiseAND(F.lit(ones)))
    return total


def least_similarity(threshold: float) -> float:
    """The least corrected estimate that a pair at the threshold shows, less six standard deviations.

    Unequal minima agree in their low bits with chance 2^-BITS, so the expected
    share of equal groups is C + (1 - C) * similarity.
    """
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def corrected_similarity(equal_groups: Column) -> Column:
    """Similarity estimate from the count of equal groups, corrected for chance agreement."""
    chance = 2.0**-BITS
    return (equal_groups / F.lit(float(HASHES)) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text, ...)``.

    Shingles are ``width`` words; two texts link at 100 * |A ∩ B| >= percent * |A ∪ B|.
    A null text, or one without words, has no shingles and links with nothing;
    repeated rows are exact copies; a doc_id with several texts belongs to the
    component of each; a null doc_id keeps its row, with no component, kept.  Of ties
    the smallest doc_id counts.  Texts are read whole, however long; other columns are
    ignored; an empty table gives no rows.  Ids beyond ``limit`` bytes are joined to the
    texts by a shuffle instead of a broadcast.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketch = cut(docs.mapInArrow(_sketcher(width, percent / 100), "doc_id long, n_shingles long, text_key string, sig array<long>, bands array<long>"))
    named = sketch.where("text_key is not null and doc_id is not null")
    classes = named.groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    reps = cut(
        named.join(classes, "text_key")
        .where("doc_id = rep")
        .select(F.col("doc_id").alias("doc"), "text_key", F.col("n_shingles").alias("n"), "sig", "bands")
        .dropDuplicates(["doc", "text_key"]),
        few=True,
    )
    return _label(sketch, classes, link(reps, docs, percent, width, limit))


def _label(sketch: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    label = classes.join(component, classes["rep"] == component["node"], "left").select("text_key", F.coalesce("component", "rep").alias("component_id"))
    with_text = sketch.where("text_key is not null and doc_id is not null").select("doc_id", "n_shingles", "text_key").join(label, "text_key", "left")
    rest = sketch.where("text_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        with_text.select("doc_id", "n_shingles", "component_id")
        .unionByName(rest)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but the smallest doc_id of each component.

    Texts without words all stay.  Where doc_ids are null or repeat, rows get numbers of
    their own first (kept with the rows), so that each is judged by its own text and
    one of each component stays, the one with the smallest number.
    """
    rows, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    ident = F.col("doc_id").cast("long")
    name = None
    if rows != ids or ids != distinct:
        name = free_name(docs, "_row")
        docs, ident = cut(docs.withColumn(name, F.monotonically_increasing_id())), F.col(name)
    result = near_duplicates(docs.select(ident.alias("doc_id"), "text"), percent, width, limit)
    gone = free_name(docs, "_gone")
    copies = cut(result.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), few=True)
    left = docs.join(broadcast_if(copies, copies.count(), 16, limit), ident == F.col(gone), "left_anti")
    return left.drop(name) if name else left


def link(reps: DataFrame, docs: DataFrame, percent: int, width: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Components of the distinct texts ``reps(doc, text_key, n, sig, bands)``.

    The hub of a bucket is the member that shares most with others over all bands: of
    a group of near copies, the one that is nearest to all.  Every member is compared
    with its hubs; the components of these links are labels, under which no pair need be
    compared.  ``remainder`` then finds the other pairs, and its links join components.
    """
    rows = reps.select("doc", F.explode("bands").alias("band"))
    counted = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(rows.join(counted, "band"), few=True)
    standing = shared.groupBy("doc").agg(F.sum("size").alias("pop"))
    shared = shared.join(standing, "doc").select("band", "doc", "pop")
    hubs = shared.groupBy("band").agg(F.max_by("doc", F.struct("pop", -F.col("doc"))).alias("hub"))
    members = cut(shared.join(hubs, "band").where("doc <> hub").select("doc", "hub").distinct(), few=True)
    side = reps.select("doc", "n", "sig")
    found = confirm(candidates(members.toDF("a", "b"), side, percent), docs, percent, width, limit)
    known = cut(connected_components(found), few=True)
    label = known.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    more = confirm(candidates(remainder(members, label, docs, percent, width, limit), side, percent), docs, percent, width, limit)
    return known if more.isEmpty() else connected_components(known.toDF("a", "b").unionByName(more))


def remainder(members: DataFrame, label: DataFrame, docs: DataFrame, percent: int, width: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Pairs (a, b) of members of a hub, under different labels, that may link; none that links is left out.

    A member x is described by D(x), its symmetric difference with the hub, in an order
    that is common to the hub's members.  As |x Δ y| = |D(x) Δ D(y)|, a link needs
    |D(x) Δ D(y)| <= T, with T = (100 - percent) / (100 + percent) of both sizes; hence
    an overlap of D(x) and D(y), hence a common element in prefixes of lengths that
    follow from T and the sizes.  (If the needed overlap is 0, both link with the hub.)
    First in the order are elements under one label only, which make no pair and are
    but counted; then the others, those of few members before those of many.  So
    the edits of one copy fill its prefix, and what a hub has of its own, or lacks,
    against the whole group comes last.
    """
    labelled = members.join(label, "doc", "left").select("doc", "hub", F.coalesce("label", "doc").alias("label"))
    mixed = labelled.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hub")
    left = cut(labelled.join(mixed, "hub"), few=True)
    sets = shingles(left.select(F.col("doc").alias("doc_id")).unionByName(left.select(F.col("hub").alias("doc_id"))), docs, width, limit)
    pair = left.join(sets.toDF("doc", "own"), "doc").join(sets.toDF("hub", "base"), "hub")
    differs = cut(
        pair.select("doc", "hub", "label", F.size("own").alias("n"), F.concat(F.array_except("own", "base"), F.array_except("base", "own")).alias("d")), few=True
    )
    rows = differs.select("doc", "hub", "label", "n", F.size("d").alias("k"), F.explode("d").alias("token"))
    counts = rows.groupBy("hub", "token").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    met = rows.join(counts.select("hub", "token", "held"), ["hub", "token"])
    ordered = met.groupBy("doc", "hub", "label", "n", "k").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("d"))
    # The longest prefix that any partner may need: partners are at most 100 / percent as long.
    most = F.floor((100 - percent) * F.col("n") / percent) + 2
    alone = F.col("k") - F.size("d")
    prefix = F.slice("d", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))
    tokens = ordered.select("doc", "hub", "label", "n", "k", alone.alias("alone"), F.posexplode(prefix).alias("pos", "at"))
    tokens = cut(tokens.select("doc", "hub", "label", "n", "k", (F.col("alone") + F.col("pos")).alias("pos"), "at.token"), few=True)
    x, y = tokens.toDF("a", "hub", "la", "na", "ka", "pa", "token"), tokens.toDF("b", "hub_", "lb", "nb", "kb", "pb", "token_")
    allowed = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    fits = (
        ((F.col("ka") > F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") > F.col("b"))))
        & (F.col("la") != F.col("lb"))
        & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (2 * F.col("pa") <= F.col("ka") - F.col("kb") + allowed)
        & (2 * F.col("pb") <= F.col("kb") - F.col("ka") + allowed)
    )
    return x.join(y, (F.col("hub") == F.col("hub_")) & (F.col("token") == F.col("token_")) & fits).select("a", "b").distinct()


def candidates(pairs: DataFrame, side: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose set sizes and signatures allow the similarity."""
    a, b = side.toDF("a", "na", "siga"), side.toDF("b", "nb", "sigb")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .where(corrected_similarity(matches(F.col("siga"), F.col("sigb"))) >= least_similarity(percent / 100) - 1e-9)
        .select("a", "b", "na", "nb")
    )


def shingles(ids: DataFrame, docs: DataFrame, width: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc, shingles) of the documents with ``ids(doc_id)``; sets are made anew from the texts, and kept once."""
    ids = ids.distinct()
    # Texts are shuffled only where the ids are too many to be sent to them.
    made = docs.join(broadcast_if(ids, ids.count(), 16, limit), "doc_id", "left_semi").mapInArrow(_setter(width), "doc long, shingles array<long>")
    return cut(made, few=True)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, width: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Those of ``pairs(a, b, na, nb)`` that link on their full shingle sets."""
    pairs = cut(pairs, few=True)
    sets = shingles(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), docs, width, limit)
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("common", common)
        .where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
        .select("a", "b"),
        few=True,
    )
