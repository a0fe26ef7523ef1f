"""Line-first cleaning with document rules; built-in functions only.

Every line is judged by punctuation, navigation, symbol, capitals and boilerplate
rules.  Failing lines are removed, and a document that loses more than
``MOST_LOST`` per cent of the characters in its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MOST_LOST = 25
#: Phrases of page furniture, matched without case.
BOILERPLATE = (
    r"(?i)\b(cookie policy|cookie settings|accept (?:all )?cookies|we use cookies|privacy policy|terms of (?:use|service)|"
    r"all rights reserved|enable javascript|javascript is (?:disabled|required)|sign up for our newsletter|subscribe to our|"
    r"click here to|share (?:this )?on (?:facebook|twitter)|log ?in to comment|skip to (?:main )?content|back to top|lorem ipsum)\b"
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(w: Column, n: int) -> Column:
    """A hash of each window of ``n`` words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(w[i + k] for k in range(n))))


def _covered(h: Column, n: int) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``h``: hashes by position."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = let(
        pairs,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"]))),
                lambda x: x["i"],
            )
        ),
    )
    return let(
        again,
        lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.when(k == F.size(p) - 1, F.lit(n)).otherwise(F.least(F.lit(n), F.get(p, k + 1) - at))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words inside windows of ``n`` words that the text has twice or more.

    Most texts repeat no window; only others pay for the sort.
    """
    none = F.lit(0).cast("long")
    inside = let(_windows(w, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h, n)))
    return F.when(F.size(w) < n, none).otherwise(inside)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD)),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )


def line_fails(line: Column) -> Column:
    """Whether a line is not prose.

    * punctuation: five words or more and no mark of punctuation anywhere;
    * navigation: three bars, or more than one to five words;
    * symbols: more than one to five words;
    * capitals: most of twenty or more letters are capitals;
    * boilerplate: a phrase of page furniture.
    """
    n = F.regexp_count(line, F.lit(WORD))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    return (
        ((n >= 5) & ~line.rlike(r"[.!?…。！？:;,]"))
        | (F.regexp_count(line, F.lit(r"\|")) * 5 > F.greatest(n, F.lit(10)))
        | (F.regexp_count(line, F.lit(r"[#*$%&<>]")) * 5 > F.greatest(n, F.lit(5)))
        | ((capitals >= 20) & (2 * capitals > F.regexp_count(line, F.lit(r"\p{L}"))))
        | line.rlike(BOILERPLATE)
    )


def clean(text: Column) -> Column:
    """The text without the lines that fail; null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x)), "\n")


def cleaned(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality`` keeps, their ``text`` without the lines that fail."""
    ok = free_name(docs, "_kept")
    judged = docs.withColumn(ok, _verdict(most_lost))
    return judged.where(ok).withColumn("text", clean(F.col("text"))).select(*docs.columns)


def word_chars(w: Column) -> Column:
    return F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def base_fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def keeps(clean: Column, every: Column, most_lost: int) -> Column:
    return 100 * clean >= (100 - most_lost) * every


def clean_chars(text: Column) -> Column:
    """Characters in words of the lines that pass."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return F.aggregate(
        F.transform(lines, lambda x: F.when(line_fails(x), F.lit(0)).otherwise(F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")))),
        F.lit(0).cast("long"),
        lambda a, n: a + n,
    )


def _verdict(most_lost: int) -> Column:
    counts = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), word_chars(w).alias("c"), repeated_words(w).alias("r")))
    return let(counts, lambda x: ~base_fails(x["n"], x["r"]) & keeps(clean_chars(F.col("text")), x["c"], most_lost))


def quality(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """Counts and verdict for each row of ``docs(doc_id, text)``.

    base_failed: under ten words, or over a fifth of them in repeated 5-word windows.
    kept: the base holds and lines that pass have at least ``100 - most_lost`` per cent
    of the characters in words; ``clean_chars`` counts those.  Null and empty texts
    have no words and fail; texts are judged whole, however long; repeated rows are each
    judged; other columns are ignored; an empty table gives no rows.
    """
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(
            words(F.col("text")),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
        ).alias("x"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        clean_chars(F.col("text")).alias("clean_chars"),
    )
    out = counted.select("doc_id", "x.n_words", "x.word_chars", "n_symbols", "n_dup_lines", "x.n_repeat_words", "clean_chars")
    out = out.withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & keeps(F.col("clean_chars"), F.col("word_chars"), most_lost))
