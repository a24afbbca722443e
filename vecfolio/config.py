"""Settings from the environment, with named errors, and a health table."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .operators import density, embedding, sampling


@dataclass(frozen=True)
class Settings:
    embedder: str = "spectral"
    sample_interval_seconds: int = 25
    window_seconds: float = 10.0
    max_outlier_fraction: float = 0.0
    max_duration_seconds: float = 14_400.0
    max_upload_bytes: int = 1 << 30
    min_rms_dbfs: float = -48.0
    max_clipped_ratio: float = 0.02
    batch_size: int = 64
    initial_profiles: str = ""
    projection_path: str = ""
    telemetry_path: str = ""
    telemetry_enabled: bool = True
    model_revision: str = "spectral-1"

    def __post_init__(self):
        if self.sample_interval_seconds not in sampling.INTERVALS:
            raise ValueError(f"sample_interval_seconds must be one of {sampling.INTERVALS}")
        density.check_fraction(self.max_outlier_fraction)


def settings(environment: Mapping[str, str] = os.environ, prefix: str = "VECFOLIO_") -> Settings:
    """Settings from variables such as VECFOLIO_BATCH_SIZE; those that aren't set, or empty, keep their defaults."""
    given = {}
    for field in fields(Settings):
        text = environment.get(prefix + field.name.upper(), "").strip()
        if not text:
            continue
        try:
            given[field.name] = text.lower() not in ("0", "false", "no", "off") if field.type == "bool" else {"int": int, "float": float, "str": str}[field.type](text)
        except ValueError:
            raise ValueError(f"{prefix}{field.name.upper()} must be of type {field.type}") from None
    return Settings(**given)


def health(spark: SparkSession, chosen: Settings, projection: DataFrame | None = None) -> DataFrame:
    """One row: the embedder and whether it is there, and the projection's version and size if one is frozen."""
    row = projection.first() if projection is not None else None
    return spark.createDataFrame(
        [("ok", chosen.embedder, chosen.embedder in embedding.EMBEDDERS, row["version"] if row else None, row["reference_count"] if row else None)],
        "status string, embedder string, embedder_ready boolean, projection_version string, projection_profiles long",
    )
