"""Training-order materialisation into fixed-stride binary shards.

Documents are cut into sequences of at most ``length`` ids.  A document's sequences
get numbers from a dense range of as many as its bytes allow (a cheap bound, so that
texts are tokenised once only).  A keyed Feistel network with cycle-walking permutes
the numbers; range partitions of the permuted numbers, each sorted, write shards.  A
sequence's global slot is its place in that order: slots are dense from 0.  Record
``k`` of a shard is at byte ``k * stride``: a count (4 bytes), then ids padded with
zeros.  An index file has the first slot of each shard; a reader can thus start, or
resume, at any slot by reading the index and seeking.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, broadcast_if, cut, lean, work_folder
from .ranks import buckets, running_total
from .tokens import document_ids, encoder

#: Ids of a sequence; permuted numbers that a shard spans at least; rounds and key of the network.
LENGTH, SPAN, ROUNDS, KEY = 256, 65_536, 6, 20_240_501
#: Most shards (a larger corpus has larger ones, about 1 GB each at 100 TB), and copies of a row that one row of the plan writes.
MOST_SHARDS, COPIES = 65_536, 64
INDEX = "index.bin"


def _round_keys(key: int, rounds: int) -> np.ndarray:
    return _scramble(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of ``numbers`` under a keyed permutation of 0 .. n - 1.

    A balanced Feistel network permutes the next even power of two; a value outside
    the range walks on through the network until it is inside (under 4 steps each on
    average).
    """
    half = np.uint64(max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key, rounds)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_scramble(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def stride(length: int, width: int = 2) -> int:
    return 4 + length * width


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme; one without is on Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_shards(
    docs: DataFrame, folder: str | None = None, length: int = LENGTH, span: int = SPAN, key: int = KEY, tokenizer: tuple | None = None, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Write the shards and their manifest; a row for each sequence: doc_id, start, length, ids_crc32, slot, shard, byte_offset.

    The folder must be shared by all executors (default: a new one below the
    session's checkpoint folder) and may be on any file system pyarrow opens; without a
    scheme it is on Spark's default one.  A shard is written under another name and
    moved when complete, so that a repeated or lost task does no harm.  A null or empty
    text is the closing id alone; texts are cut whole, however long; repeated rows are
    written each for itself; null ids count as a document of their own; other columns
    are ignored; an empty table writes nothing.  Ids take two bytes: a larger one is an
    error.  Numbers of rows beyond ``limit`` bytes are joined to the texts by a shuffle
    instead of a broadcast.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, (folder or work_folder(spark, "shards")).rstrip("/"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    # A byte is one id at most, and one id closes the document.
    bound = F.ceil((F.octet_length(F.coalesce("text", F.lit(""))) + 1) / length).cast("long")
    # Equal rows are numbered together.
    rows = cut(docs.groupBy("doc_id", "_row").agg(F.sum(bound).alias("n"), F.count("*").alias("copies")))
    entries, most = rows.agg(F.count("*"), F.max("copies")).first()
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(buckets(entries))).cast("int"))
    firsts, total = [], 0
    for bucket, n in running_total(rows, F.col("n")):
        firsts.append((bucket, total))
        total += n
    if not total:
        return spark.createDataFrame([], _MANIFEST)
    within = Window.partitionBy("_bucket").orderBy("doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(spark.createDataFrame(firsts, "_bucket int, _first long"))
    numbered = (
        rows.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(first, "_bucket")
        .select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), (F.col("_first") + F.col("_before")).alias("number"), "copies")
    )
    # Numbers are sent to the texts while they are few; else texts are shuffled to them.
    numbered = broadcast_if(numbered, entries, 40, limit)
    joined = docs.join(numbered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key"))).select("doc_id", "_row", "text", "number", "copies")
    if most > 1:
        # Copies of a whole row have the same text: one of them stands for all, and is dealt out again in parts of a bounded size.
        one = joined.where("copies > 1").dropDuplicates(["doc_id", "_row"])
        parts = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES)))).repartition("doc_id", "_row", "_part")
        each = F.ceil((F.octet_length(F.coalesce("text", F.lit(""))) + 1) / length).cast("long")
        parts = parts.withColumn("number", F.col("number") + F.col("_part") * each).withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("_part")))
        joined = joined.where("copies = 1").unionByName(parts.drop("_part"))

    @lean
    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(tokenizer or ()))
        for b in batches:
            numbers: list[int] = []
            out: list[tuple] = []
            for i, t, number, copies in zip(*(b.column(c) for c in ("doc_id", "text", "number", "copies")), strict=True):
                wide, i = document_ids(encode, t.as_py()), i.as_py()
                if wide.max() > 0xFFFF:
                    raise ValueError(f"id {wide.max()} doesn't fit in two bytes")
                data = wide.astype("<u2").tobytes()
                parts = [(i, at // 2, data[at : at + 2 * length]) for at in range(0, len(data), 2 * length)] * copies.as_py()
                number = number.as_py()
                numbers += range(number, number + len(parts))
                out += parts
            if out:
                ids, starts, parts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(permute(np.array(numbers, np.int64), total, key)), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
                    names=["position", "doc_id", "start", "ids"],
                )

    size, span = stride(length), max(span, -(-total // MOST_SHARDS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        stream, shard, name, record = None, -1, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                system.move(name, f"{base}/{shard_name(shard)}")

        for b in batches:
            found: list[tuple] = []
            for position, i, start, ids in zip(*(b.column(c).to_pylist() for c in ("position", "doc_id", "start", "ids")), strict=True):
                if position // span != shard:
                    close()
                    shard, name, record = position // span, f"{base}/.{uuid.uuid4().hex}.part", 0
                    stream = system.open_output_stream(name)
                stream.write((len(ids) // 2).to_bytes(4, "little") + ids + bytes(size - 4 - len(ids)))
                found.append((i, start, len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), shard, record))
                record += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "shard", "record"])
        close()

    shards = -(-total // span)
    dealt = joined.mapInArrow(sequences, "position long, doc_id long, start long, ids binary").withColumn("_shard", F.floor(F.col("position") / span).cast("int"))
    sorted_ranges = dealt.repartitionById(shards, F.col("_shard")).sortWithinPartitions("position").drop("_shard")
    sorted_ranges.mapInArrow(write, "doc_id long, start long, length long, ids_crc32 long, shard long, record long").write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # At most MOST_SHARDS rows.
    offsets, at = [], 0
    for r in sorted(manifest.groupBy("shard").count().collect()):
        offsets.append((r["shard"], at))
        at += r["count"]
    system, base = _open(folder)
    with system.open_output_stream(f"{base}/{INDEX}") as out:
        out.write(np.array([*offsets, (shards, at)], "<i8").tobytes())
    place = broadcast_if(spark.createDataFrame(offsets, "shard long, first long"), len(offsets), 16)
    return manifest.join(place, "shard").select(
        "doc_id", "start", "length", "ids_crc32", (F.col("first") + F.col("record")).alias("slot"), "shard", (F.col("record") * size).alias("byte_offset")
    )


_MANIFEST = "doc_id long, start long, length long, ids_crc32 long, slot long, shard long, byte_offset long"


def read_slots(folder: str, first: int, count: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``first`` on, in order, with one seek for each shard."""
    system, base = _open(folder)
    size = stride(length)
    with system.open_input_file(f"{base}/{INDEX}") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
    starts = index[:, 1]
    last = min(first + count, int(starts[-1]))
    for k in range(int(np.searchsorted(starts, first, "right")) - 1, len(index) - 1):
        lo, hi = max(first, int(starts[k])), min(last, int(starts[k + 1]))
        if lo >= last:
            return
        with system.open_input_file(f"{base}/{shard_name(int(index[k, 0]))}") as f:
            f.seek((lo - int(starts[k])) * size)
            for _ in range(hi - lo):
                record = f.read(size)
                yield np.frombuffer(record, "<u2", int.from_bytes(record[:4], "little"), 4).astype(np.uint32)
