"""Scalar library of the planner: names, labels, sizes, resources, text transforms.  Built-in expressions but for the two at the end."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans import config
from ..plans import labels as words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Powers of resource suffixes.
SUFFIXES = {s: 1000 ** (k + 1) for k, s in enumerate("KMGTP")} | {f"{s}i": 1024 ** (k + 1) for k, s in enumerate("KMGTP")}


def node_key(rule: Column, fingerprint: Column, filename: Column, output_name: Column) -> Column:
    """rule/fingerprint/filename; the file name falls back to the output's name, then to ``output``."""
    return F.concat_ws("/", rule, fingerprint, F.coalesce(filename, output_name, F.lit("output")))


def display_label(label: Column, output_name: Column, kind: Column) -> Column:
    """What a node is shown as: its label, its output's name, its type, or ``output``."""
    return F.coalesce(label, output_name, kind, F.lit("output"))


def path_fits(path: Column, name_max: int = 255, path_max: int = 4096) -> Column:
    """Whether a path and each of its parts are within byte limits."""
    return (F.octet_length(path) <= path_max) & ~F.exists(F.split(path, "/"), lambda p: F.octet_length(p) > name_max)


def parse_resource(text: Column) -> Column:
    """``12``, ``4K``, ``2Gi`` as a whole number; null if malformed."""
    number, suffix = F.regexp_extract(text, r"^(\d+)([KMGTP]i?)?$", 1), F.regexp_extract(text, r"^(\d+)([KMGTP]i?)?$", 2)
    factor = F.lit(1).cast("long")
    for name, value in SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(value)).otherwise(factor)
    return F.when(number != "", number.cast("long") * factor)


def human_size(size: Column) -> Column:
    """Bytes with a binary unit; one decimal, ties to even, from KiB on."""
    out = F.format_string("%d B", size.cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB")):
        out = F.when(size >= 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(size / float(1024 ** (k + 1)), 1))).otherwise(out)
    return out


def pascal_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def sanitize(text: Column) -> Column:
    """A text as part of a file name."""
    one = {c: x for c, x in words.IN_NAMES.items() if len(x) == 1}
    gone = "".join(c for c, x in words.IN_NAMES.items() if not x)
    out = F.translate(text, "".join(one) + gone, "".join(one.values()))
    for c, x in words.IN_NAMES.items():
        if len(x) > 1:
            out = F.replace(out, F.lit(c), F.lit(x))
    return out


def contract(*types: Column) -> Column:
    """The name of a union of types: its members, sorted."""
    return F.array_join(F.array_sort(F.array(*types)), "|")


def content_hash(content: Column) -> Column:
    """SHA-256 of a text or of bytes, in hexadecimal digits."""
    return F.sha2(content, 256)


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def line_count(text: Column) -> Column:
    """Line ends of a text."""
    return F.regexp_count(text, F.lit("\n")).cast("long")


def sorted_characters(text: Column) -> Column:
    """The characters of all lines, sorted by code point, as one text."""
    return F.array_join(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "\n")), "")


def json_get(text: Column, field: str) -> Column:
    """The value at a dotted field of a JSON object, as text; null if it isn't there."""
    return F.get_json_object(text, "$." + field)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, LOWER, UPPER)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rot13(text: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(text, UPPER + LOWER, turn(UPPER) + turn(LOWER))


def reverse_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), F.reverse), "\n")


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes."""
    short = F.substring(text, 1, most)
    state = F.aggregate(
        F.split(short, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda a, c: F.struct(
            (a["bytes"] + F.octet_length(c)).alias("bytes"), F.when(a["bytes"] + F.octet_length(c) <= most, a["chars"] + 1).otherwise(a["chars"]).alias("chars")
        ),
    )
    return F.substring(short, F.lit(1), state["chars"])


def recalibrate(values: Column, ppm: Column) -> Column:
    """Masses divided by 1 + ppm / 1e6."""
    return F.transform(values, lambda x: x / (1 + ppm * 1e-6))


def grid_token(value: Column) -> Column:
    """A text of a grid as part of a label."""
    return sanitize(value)


def number_token(value: Column) -> Column:
    """A floating-point number as part of a label."""
    return F.replace(F.replace(value.cast("string"), F.lit("."), F.lit("p")), F.lit("-"), F.lit("neg"))


def grid_label(stem: Column, parts: dict[str, Column], most: int = 250, cut: int = 241) -> Column:
    """``stem__name+token__...``; a label of over ``most`` bytes is cut at ``cut`` and ends in a digest."""
    tail = F.concat_ws("__", *(F.concat(F.lit(f"{name.replace('.', '_')}+"), token) for name, token in parts.items()))
    label = F.concat_ws("__", stem, tail)
    return F.when(F.octet_length(label) <= most, label).otherwise(F.concat(truncate_bytes(label, cut), F.lit("_"), F.substring(F.md5(tail), 1, 8)))


def cosort(first: Column, second: Column) -> Column:
    """Pairs of two parallel arrays in order of the first."""
    return F.array_sort(F.arrays_zip(first.alias("a"), second.alias("b")))


def sine_bias(position: Column, length: Column | int, amplitude: float) -> Column:
    """One period of a sine over ``length`` positions."""
    return F.lit(amplitude) * F.sin(2 * F.pi() * position / length)


@F.pandas_udf(StringType())
def token_diff(base: pd.Series, value: pd.Series) -> pd.Series:
    """The words of ``value`` that an alignment with ``base`` leaves over; no built-in aligns words."""
    return pd.Series([None if a is None or b is None else words.token_diff(a, b) for a, b in zip(base, value, strict=True)], dtype=object)


def json_set(text: Column, field: str, value: Column) -> Column:
    """A JSON object with one dotted field set; tables on the way are made."""

    @F.pandas_udf(StringType())
    def put(documents: pd.Series, values: pd.Series) -> pd.Series:
        made = (None if d is None else config.set_field(json.loads(d), field, None if v is None else json.loads(v)) for d, v in zip(documents, values, strict=True))
        return pd.Series([None if m is None else json.dumps(m, separators=(",", ":"), ensure_ascii=False) for m in made], dtype=object)

    return put(text, value)
