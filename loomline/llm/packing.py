"""Packing of token pieces by shortest-pack-first over the length histogram.

Documents are cut into full pieces of ``size`` tokens and one shorter rest.  The
histogram of piece lengths (at most ``size`` rows) goes to the driver, which plans
patterns: lengths are placed longest first, each into the pattern that is filled
least, in groups as large as pattern and length counts allow.  The plan (a bounded
table) is broadcast, and every piece finds its place by its rank among the pieces of
its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .ranks import with_rank
from .tokens import document_ids, encoder

SIZE = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: tuple | None = None) -> DataFrame:
    """A row for each piece of each row of ``docs(doc_id, text)``; see ``pack``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(tokenizer or ()))
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = document_ids(encode, t.as_py())
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((i.as_py(), at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if rows:
                names = [x.split()[0] for x in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(length, times), ...])`` that place ``histogram[length]`` pieces of each length.

    Shortest pack first: the next-longest length goes to the emptiest pattern; if it
    doesn't fit there, it fits nowhere and opens packs of its own.
    """
    heap: list[tuple[int, int, int, tuple]] = []  # filled, tie, count, contents
    made = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= size:
                filled, _, count, inside = heapq.heappop(heap)
                used = min(left, count)
                if used < count:
                    made += 1
                    heapq.heappush(heap, (filled, made, count - used, inside))
            else:
                filled, used, inside = 0, left, ()
            left -= used
            made += 1
            times = inside[0][1] + 1 if inside and inside[0][0] == length else 1
            inside = ((length, times), inside[1] if times > 1 else inside)
            heapq.heappush(heap, (filled + length, made, used, inside))
    out = []
    for _, _, count, inside in sorted(heap):
        contents = []
        while inside:
            contents.append(inside[0])
            inside = inside[1]
        out.append((count, contents[::-1]))
    return out


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, ...]]:
    """(length, first rank, last rank + 1, packs, first sequence, offset) for each place of the plan."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, contents in patterns:
        offset = 0
        for length, times in contents:
            first = ranks.get(length, 0)
            ranks[length] = first + count * times
            out.append((length, first, ranks[length], count, sequence, offset))
            offset += length * times
        sequence += count
    return out


def pack(docs: DataFrame, size: int = SIZE, tokenizer: tuple | None = None) -> DataFrame:
    """Where each piece of each document goes.

    Columns: doc_id, start (ids before the piece in its document), length, ids_crc32
    (of the ids as little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A null or empty text is the closing id alone; texts are cut whole, however long;
    repeated rows are packed each for itself (pieces equal in doc_id and start take the
    places of both in either order); null ids are kept; other columns are ignored; an
    empty table gives no rows.
    """
    cutted = cut(pieces(docs, size, tokenizer))
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(histogram, size))
    spark = docs.sparkSession
    table = spark.createDataFrame(places, "slot_length long, lo long, hi long, packs long, sequence long, slot_offset long")
    ranked = with_rank(cutted, "length", ["doc_id", "start"], sum(histogram.values()))
    step = F.col("rank") - F.col("lo")
    # At most a few rows for each length and pattern: the plan doesn't grow with the corpus.
    return ranked.join(
        F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + step % F.col("packs")).alias("sequence_id"),
        (F.col("slot_offset") + F.floor(step / F.col("packs")) * F.col("length")).alias("offset"),
    )
