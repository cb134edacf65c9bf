"""The engine's queries with their oracle SQL, one per operator of the inventory."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES

for _family in ("paths", "motion", "cohort", "graphs", "voxels", "signals", "shapes", "scalars", "tables"):
    importlib.import_module(f"{__package__}.{_family}_queries")


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion amplitude of each ring, whole and per quadrant."""
    return QUERIES["a27_ring_rollup"](spark, sf_dir)
