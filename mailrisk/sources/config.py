"""Scoring configuration as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from mailrisk import schemas


def _read_sections(path: str) -> dict[str, dict[str, float]]:
    """Two-level `section: / key: number` file, the only shape the weights file has."""
    sections: dict[str, dict[str, float]] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            text = line.split("#", 1)[0].rstrip()
            if not text:
                continue
            name, _, value = text.strip().partition(":")
            if text[0].isspace():
                sections[section][name.strip()] = float(value)
            else:
                section = name.strip()
                sections[section] = {}
    return sections


def _literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A literal table: part of the plan, so that no files or workers are needed to read it."""
    names = [column.split()[0] for column in columns.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    fields = columns.replace(" ", ":").replace(",:", ",")
    return spark.sql(
        "SELECT inline(from_json(:rows, :shape))", args={"rows": text, "shape": f"array<struct<{fields}>>"}
    )


def weights_table(
    spark: SparkSession, weights: dict[int, float] | None = None, profile: str = "default"
) -> DataFrame:
    rows = [(profile, k, float(v)) for k, v in (weights or schemas.DEFAULT_WEIGHTS).items()]
    return _literal(spark, schemas.WEIGHTS, rows)


def thresholds_table(
    spark: SparkSession, bounds: dict[str, float] | None = None, profile: str = "default"
) -> DataFrame:
    found = bounds or schemas.DEFAULT_THRESHOLDS
    bounds_row = (profile, float(found["deliver"]), float(found["block"]))
    return _literal(spark, schemas.THRESHOLDS, [bounds_row])


def policy_table(spark: SparkSession, policy: dict[str, str] | None = None) -> DataFrame:
    rows = list((policy or schemas.DEFAULT_POLICY).items())
    return _literal(spark, "level string, action string", rows)


def load_weights(
    spark: SparkSession, path: str, profile: str = "default"
) -> tuple[DataFrame, DataFrame]:
    """The weights file as (weights, thresholds)."""
    found = _read_sections(path)
    weights = {int(name.lstrip("lL")): value for name, value in found["layers"].items()}
    return (
        weights_table(spark, weights, profile),
        thresholds_table(spark, found["thresholds"], profile),
    )
