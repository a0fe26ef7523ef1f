"""Rules that bring data into a run: links, texts, frozen copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import change_token, literal, scan
from .rules import ArtifactType, Rule


def link(name: str, kind: ArtifactType, output: str = "table") -> Rule:
    """A table elsewhere, used in place: nothing is copied, and what is made from it is stale once its files have changed."""
    return Rule(name, {"path": str}, {output: kind}, link="path")


def text(name: str, kind: ArtifactType, output: str = "text") -> Rule:
    """A text, verbatim, as one row."""
    return Rule(name, {"text": str}, {output: kind}, function=_literal, version="1")


def copy(name: str, kind: ArtifactType, output: str = "table") -> Rule:
    """A snapshot of a table elsewhere: later changes there aren't seen."""
    return Rule(name, {"path": str}, {output: kind}, function=_copied, version="1")


def watched(kind: ArtifactType, spark: SparkSession, parameter: str = "path") -> ArtifactType:
    """``kind``, with the files at the path in a parameter of the call as what it hangs on."""
    return ArtifactType(kind.name, kind.parents, kind.columns, lambda node: change_token(spark, node.call.config[parameter]))


def _literal(spark: SparkSession, text: str) -> DataFrame:
    return literal(spark, text)


def _copied(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path)
