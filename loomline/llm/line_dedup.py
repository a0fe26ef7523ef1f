"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: token count, then its two leading tokens, with
tokens that hold digits generalised to ``<*>``.  At the leaf the other positions are
dealt into at most ``BLOCKS`` blocks, and lines merge that agree in all but two of them
(in all but one where there are fewer than three): positions in these are the
template's fields.  At least 60 per cent of the positions, the leading ones among them,
are thus constant, and lines of any length from three tokens on can have fields.
Shorter lines have themselves as template, and long ones besides.  Sentences of
at least ``LEAST_SENTENCE`` tokens are units too, as they stand, since repeated
passages often share a line with other text.

A template recurs if it stands in enough documents that differ, however many copies of
them there are: documents are told apart by a sketch of sixteen minima (of the hashes
of their longer words outside the line or sentence), of which copies and near copies
share half or more.  So copies of one document don't make its lines recurrent, and are
left to document dedup.  The first document with a recurring template keeps it;
elsewhere the line, or the sentence, is dropped.

Most leaves and sentences occur too rarely to matter.  A first pass counts them; those
that occur often enough, and not in copies of one text only, go to the executors as a
bit set of bounded size (a bit that is set by chance only costs time), and only their
units are looked at further.  Likewise only documents that lose something are parsed
once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, broadcast_if, cut, free_name, lean, small_enough

#: Tokens of a sentence to be a unit of its own, of a short line, and of a long unit.
LEAST_SENTENCE, SHORT, LONG = 8, 6, 50
#: Documents that must differ, by the low bits of a template: usual, short and long units.
DOCS, DOCS_SHORT, DOCS_LONG = 5, 20, 2
NEEDS = (DOCS, DOCS_SHORT, DOCS_LONG)
#: Minima of a sketch, of four bits each; documents that share ``SAME`` of them or more count as one.
MINIMA, SAME = 16, 8
LEADING, BLOCKS = 2, 5
#: Bits for each key of a bit set, and the most bits in all (64 MB), as a power of two.
BITS_A_KEY, MOST_BITS = 32, 29
#: Kinds of templates: whole lines, sentences, leaves, lines with blocks generalised.
LINE, SENTENCE, LEAF, FIELDS = 1, 2, 3, 4


def _need(n: int) -> int:
    return 1 if n < SHORT else 2 if n >= LONG else 0


def _sign(kind: int, need: int, text: str) -> int:
    """A 63-bit number; its low two bits tell how many documents it needs to recur."""
    return xxhash.xxh3_64_intdigest(text, kind) >> 3 << 2 | need


def _digits_in(text: str) -> bool:
    return any(map(text.__contains__, "0123456789"))


def _generalised(tokens: list[str]) -> list[str]:
    """Tokens that hold a digit become ``<*>``, with the marks that end them."""
    return [f"<*>{t[len(t.rstrip('.!?')) :]}" if _digits_in(t) else t for t in tokens]


def line_templates(tokens: list[str]) -> list[int]:
    """The templates of a line, given as its generalised tokens.

    Blocks are hashed once; a template is the hash of its leading tokens and of the
    blocks that it keeps.
    """
    n = len(tokens)
    need, rest = _need(n) & 1, n - LEADING
    if rest < 1:
        return [_sign(LINE, need, " ".join(tokens))]
    count = min(BLOCKS, rest)
    ends = [LEADING + rest * k // count for k in range(count + 1)]
    head = f"{n} {' '.join(tokens[:LEADING])}"
    blocks = [f" {k} {xxhash.xxh3_64_intdigest(' '.join(tokens[a:b]))}" for k, (a, b) in enumerate(pairwise(ends))]
    return [_sign(FIELDS, need, head + "".join(kept)) for kept in combinations(blocks, count - (2 if count > 2 else 1))]


#: White space that isn't one space between words; texts without it are split as they stand.
_UNEVEN = ("  ", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u2001", "\u2002", "\u2003", "\u2004", "\u2005", "\u2006", "\u2007", "\u2008", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")

#: How many of these are ASCII.
_ASCII = 9


class Line(NamedTuple):
    """A line, its generalised tokens joined by spaces, its leaf (None without tokens), its template as a whole (None unless long), its sentences, and the place and template of each that is long enough."""

    text: str
    low: str
    leaf: int | None
    whole: int | None
    sentences: list[str]
    signed: list[tuple[int, int]]


def parse(text: str) -> list[Line]:
    digest = xxhash.xxh3_64_intdigest
    digits, out = _digits_in(text), []
    even = not any(map(text.__contains__, _UNEVEN[:_ASCII] if text.isascii() else _UNEVEN))
    # Most texts have no other ends of sentences than points.
    ends = [(m, f"{m[0]}\0") for m in (". ", "! ", "? ") if m in text]

    def sign(s: str, some: bool) -> int | None:
        x = s.strip() if even else " ".join(s.split())
        n = x.count(" ") + 1
        if n < LEAST_SENTENCE:
            return None
        if some and _digits_in(x):
            x = " ".join(_generalised(x.split(" ")))
        return _sign(SENTENCE, _need(n), x)

    for line in text.split("\n"):
        low = line.strip() if even else " ".join(line.split())
        if some := digits and _digits_in(low):
            low = " ".join(_generalised(low.split(" ")))
        if not low:
            out.append(Line(line, low, None, None, [line], []))
            continue
        n = low.count(" ") + 1
        lead = low if n <= LEADING else " ".join(low.split(" ", LEADING)[:LEADING])
        leaf = digest(f"{n} {lead}", LEAF) >> 3 << 2 | (n < SHORT)
        marked = line
        for m, end in ends:
            marked = marked.replace(m, end)
        sentences = marked.split("\0")
        if even and not some and low == line:
            # As they stand: no call for each of them.
            signed = [(j, digest(s, SENTENCE) >> 3 << 2 | (c > LONG - 2) << 1) for j, s in enumerate(sentences) if len(s) > 14 and (c := s.count(" ")) > LEAST_SENTENCE - 2]
        else:
            signed = [(j, t) for j, s in enumerate(sentences) if s.count(" ") >= LEAST_SENTENCE - 1 and (t := sign(s, some)) is not None]
        out.append(Line(line, low, leaf, _sign(LINE, 2, low) if n >= LONG else None, sentences, signed))
    return out


def keys_of(parsed: list[Line]) -> list[int]:
    """Leaves, long lines and sentences, in order."""
    return [k for x in parsed for k in (x.leaf, x.whole, *(t for _, t in x.signed)) if k is not None]


class BitSet:
    """Which keys may be among those that were put in."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, len(words) * 64 - 1

    @classmethod
    def of(cls, keys: DataFrame, number: Column) -> BitSet:
        """Of the ``number`` of each row of ``keys``, folded on the executors: the driver gets at most 2^MOST_BITS bits."""
        bits = max(10, min(MOST_BITS, (BITS_A_KEY * keys.count()).bit_length()))
        words = np.zeros(1 << (bits - 6), np.int64)
        bit = number.bitwiseAND(F.lit((1 << bits) - 1))
        rows = keys.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        found = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        words[found["word"].to_numpy()] = found["bits"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers & self.mask
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def frequent(parsed: list[Line], known: BitSet) -> list[tuple[int, int | None, list[int]]]:
    """(line, sentence or None, templates) of the units that may recur."""
    places, keys = [], []
    for k, x in enumerate(parsed):
        if x.leaf is not None:
            places.append((k, None, False))
            keys.append(x.leaf)
        if x.whole is not None:
            places.append((k, None, True))
            keys.append(x.whole)
        for j, t in x.signed:
            places.append((k, j, True))
            keys.append(t)
    if not keys:
        return []
    found = np.flatnonzero(known.has(np.asarray(keys, np.int64) >> 2)).tolist()
    return [(k, j, [keys[i]] if own else line_templates(parsed[k].low.split(" "))) for i in found for k, j, own in (places[i],)]


def remaining(parsed: list[Line], units: list, gone: set[int]) -> tuple[str, int]:
    """The text without units of templates that are ``gone``, and how many lines lost something."""
    lines: set[int] = set()
    inside: dict[int, set[int]] = {}
    for k, j, templates in units:
        if not gone.isdisjoint(templates):
            if j is None:
                lines.add(k)
            else:
                inside.setdefault(k, set()).add(j)
    kept = []
    for k, x in enumerate(parsed):
        if k in lines:
            continue
        if k not in inside:
            kept.append(x.text)
            continue
        out, long = inside[k], {j for j, _ in x.signed}
        first, last = min(out), max(out)
        # Short sentences between two that are dropped belong to the same passage.
        if rest := [s for j, s in enumerate(x.sentences) if not (j in out or (j not in long and first < j < last))]:
            kept.append(" ".join(rest))
    return "\n".join(kept), len(lines | inside.keys())


#: Odd numbers by which the bytes of a word are weighed, by place.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(1024)], np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word (none has a space in it), all at once."""
    data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    x = np.add.reduceat((data.astype(np.uint64) + np.uint64(7)) * _PLACES[place & 1023], starts)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_hash(text: str) -> list[tuple[int, str]]:
    """The longer words of a text (all, if they are too few to fill the bins) by their hashes."""
    words = set(text.split())
    some = [w for w in words if len(w) >= 8]
    if len(some) < 4 * MINIMA:
        some = list(words)
    if not some:
        return []
    hashes = _word_hashes(some)
    order = np.argsort(hashes, kind="stable")
    return list(zip(hashes[order].tolist(), map(some.__getitem__, order.tolist()), strict=True))


def _sketch(by_hash: list[tuple[int, str]], own: set[str]) -> int:
    """Four bits of the smallest hash of each bin (by low bits), without the words of ``own``; an empty bin takes the next one's, and 0 stands for no word at all."""
    low: list[int | None] = [None] * MINIMA
    left = MINIMA
    for h, w in by_hash:
        if low[h & MINIMA - 1] is None and w not in own:
            low[h & MINIMA - 1] = h
            left -= 1
            if not left:
                break
    if left:
        filled = [k for k, h in enumerate(low) if h is not None]
        if not filled:
            return 0
        low = [low[min(filled, key=lambda j: (j - k) % MINIMA)] for k in range(MINIMA)]
    out = 0
    for h in low:
        out = out << 4 | h >> 4 & 15
    return out - (1 << 64) if out >> 63 else out


def _differ(a: int, b: int) -> bool:
    """Whether two sketches are of documents that differ."""
    x = (a ^ b) & ((1 << 64) - 1)
    x |= x >> 2
    return ((x | x >> 1) & 0x1111111111111111).bit_count() > MINIMA - SAME


def _unit_rows(text: str, known: BitSet) -> dict[int, int]:
    """Template -> sketch of the document without the line or sentence that the template is of."""
    parsed, out = parse(text), {}
    units = frequent(parsed, known)
    if not units:
        return out
    words = _by_hash(text)
    sketches: dict[tuple, int] = {}
    for k, j, templates in units:
        if (k, j) not in sketches:
            sketches[k, j] = _sketch(words, set((parsed[k].text if j is None else parsed[k].sentences[j]).split()))
        out.update(dict.fromkeys(templates, sketches[k, j]))
    return out


@lean
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: list[int] = []
        texts: list[int] = []
        for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True):
            if text:
                # A document counts a key once.
                own = set(keys_of(parse(text)))
                found += own
                texts += [h] * len(own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (found, texts)], names=["key", "h"])


def _units(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            templates: list[int] = []
            sketches: list[int] = []
            ids: list[int | None] = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text and (own := _unit_rows(text, known)):
                    templates += own
                    sketches += own.values()
                    ids += [i] * len(own)
            if templates:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (templates, sketches, ids)], names=["template", "sketch", "doc_id"])

    return lean(run)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each template, sketches of the partition that differ from each other; a single row, with ``enough``, once there are as many as it takes."""
    chosen: dict[int, list[int]] = {}
    firsts: dict[int, int | None] = {}
    for b in batches:
        for t, s, first in zip(*(b.column(c).to_pylist() for c in ("template", "sketch", "first_of_all")), strict=True):
            firsts[t] = first
            own = chosen.setdefault(t, [])
            if len(own) < NEEDS[t & 3] and all(_differ(s, x) for x in own):
                own.append(s)
    rows = [(t, firsts[t], s, enough) for t, own in chosen.items() for enough in (len(own) >= NEEDS[t & 3],) for s in (own[:1] if enough else own)]
    for at in range(0, len(rows), 65536):
        columns = zip(*rows[at : at + 65536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["template", "first_doc", "sketch", "enough"])


def _how_many_differ(sketches: Column) -> Column:
    """How many sketches are left if each that is like an earlier one goes."""

    def same(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))) <= MINIMA - SAME

    none = F.array().cast("array<bigint>")
    return F.size(F.aggregate(sketches, none, lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.array_append(acc, x))))


def _least(key: str) -> Column:
    """How many documents that differ a key or template needs."""
    return F.element_at(F.array(*map(F.lit, NEEDS)), F.col(key).bitwiseAND(F.lit(3)).cast("int") + 1)


def _known(docs: DataFrame):
    """The keys that stand in enough documents, not all of one text, as a broadcast bit set."""
    keys = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(_keys, "key long, h long").groupBy("key")
    often = keys.agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where((F.col("n") >= _least("key")) & (F.col("lo") < F.col("hi")))
    return docs.sparkSession.sparkContext.broadcast(BitSet.of(cut(often.select("key"), few=True), F.shiftright("key", 2)))


def _units_of(docs: DataFrame) -> tuple[DataFrame, object]:
    """(template, sketch, doc_id) of the units that may recur, kept; and the keys by which they were chosen."""
    known = _known(docs)
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_units(known), "template long, sketch long, doc_id long")), known


def recurring(units: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(template, first_doc) of each recurring template of ``units(template, sketch, doc_id)``.

    Only templates with enough rows, not all of one sketch, are looked at further.  The
    distinct rows of these, dealt by template and sketch, are first thinned where they
    lie, so that none gathers more than a few rows of each partition.
    """
    least = _least("template")
    counts = units.groupBy("template").agg(F.count("*").alias("rows"), F.min("sketch").alias("lo"), F.max("sketch").alias("hi"), F.min("doc_id").alias("first_of_all"))
    maybe = cut(counts.where((F.col("rows") >= least) & (F.col("lo") < F.col("hi"))).select("template", "first_of_all"), few=True)
    rows = units.join(broadcast_if(maybe, maybe.count(), 24, limit), "template").groupBy("template", "sketch").agg(F.min("first_of_all").alias("first_of_all"))
    apart = rows.mapInArrow(_apart, "template long, first_doc long, sketch long, enough boolean").groupBy("template")
    counted = apart.agg(F.min("first_doc").alias("first_doc"), F.bool_or("enough").alias("enough"), F.array_sort(F.collect_set("sketch")).alias("sketches"))
    return counted.where(F.col("enough") | (_how_many_differ(F.col("sketches")) >= least)).select("template", "first_doc")


def drop_recurring(docs: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with all its columns, ``text`` without recurring lines, and ``n_lines`` and ``n_dropped`` (lines that lost something).

    Null and empty texts stay as they are; a text without recurring lines is not
    changed, however long; a repeated row is a further copy; of equal lines the one in
    the smallest doc_id stays (in all rows of that doc_id); rows with a null doc_id
    never keep a recurring line; an empty table gives no rows.  Columns named n_lines
    or n_dropped are replaced.  Recurring templates go to the executors if they take
    ``limit`` bytes at most, else each document gets its own by joins: the rows are the
    same.
    """
    docs = docs.drop("n_lines", "n_dropped")
    units, known = _units_of(docs)
    found = cut(recurring(units, limit), few=True)
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_lines long", "n_dropped long"])
    n = found.count()
    losing = units.join(broadcast_if(found, n, 17, limit), "template").where("doc_id is null or first_doc is null or doc_id <> first_doc").select("doc_id", "template")
    ident, drop = free_name(docs, "_id"), free_name(docs, "_drop")
    if small_enough(n, 17, limit):
        table = found.toArrow()
        templates, firsts = table["template"].to_numpy(), pc.fill_null(table["first_doc"], 0).to_numpy()
        nobody = pc.is_null(table["first_doc"]).to_numpy()
        order = np.argsort(templates)
        sent = docs.sparkSession.sparkContext.broadcast((templates[order], firsts[order], nobody[order]))

        def given(batch: pa.RecordBatch, k: int, doc: int | None, own: list[int]) -> set[int]:
            templates, firsts, nobody = sent.value
            if not len(templates) or not own:
                return set()
            own = np.asarray(own, np.int64)
            at = np.minimum(np.searchsorted(templates, own), len(templates) - 1)
            hit = templates[at] == own
            if doc is not None:
                hit &= nobody[at] | (firsts[at] != doc)
            return set(own[hit].tolist())

        rows = docs
    else:
        # A document's list is as long as it has recurring templates.
        lists = losing.groupBy(F.col("doc_id").alias(ident)).agg(F.collect_set("template").alias(drop))
        rows = docs.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)), "left").drop(ident)

        def given(batch: pa.RecordBatch, k: int, doc: int | None, own: list[int]) -> set[int]:
            return set(batch.column(drop)[k].as_py() or ()) & set(own)

    # Other documents needn't be parsed again; a null id counts as 0.
    number = F.xxhash64(F.coalesce("doc_id", F.lit(0)))
    touched = docs.sparkSession.sparkContext.broadcast(BitSet.of(cut(losing.select("doc_id").distinct(), few=True), number))
    mark = free_name(docs, "_mark")
    rows = rows.withColumn(mark, F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))

    @lean
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.cast(b.column("doc_id"), pa.int64()).to_pylist()
            some = touched.value.has(b.column(mark).to_numpy())
            texts, lines, dropped = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                lost = 0
                lines.append(text.count("\n") + 1 if text else 0)
                if text and some[k]:
                    parsed = parse(text)
                    units = frequent(parsed, known.value)
                    if gone := given(b, k, ids[k], [t for _, _, own in units for t in own]):
                        text, lost = remaining(parsed, units, gone)
                texts.append(text)
                dropped.append(lost)
            columns = [pa.array(texts, b.schema.field(c).type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return rows.mapInArrow(clean, schema)
