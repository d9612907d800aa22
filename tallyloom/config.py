"""Typed settings; plan builders turn them into literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits of the receipt dataflow."""

    allowed_extensions: tuple[str, ...] = ("jpeg", "jpg", "png", "webp")
    allowed_mime_types: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp")
    max_file_size_mb: int = 10
    max_attempts: int = 3
    max_seconds: float = 300.0
    good_score: float = 13000.0
    least_sharpness: float = 15.0
    least_ocr_confidence: float = 40.0
    acceptable_confidence: float = 70.0
    imprecise_below: float = 50.0
    psm_order: tuple[int, ...] = (6, 4, 3, 11)
    language: str = "spa"
    engine_mode: int = 3

    def tesseract_options(self, psm: int) -> str:
        """Option string for a recognition engine."""
        return f"--oem {self.engine_mode} --psm {psm}"

    @classmethod
    def from_spark(cls, spark: SparkSession, prefix: str = "spark.tallyloom.") -> Settings:
        """Settings with numeric or text values overridden by ``prefix`` + name in the session."""
        changed = {}
        base = cls()
        for field in fields(cls):
            given = spark.conf.get(prefix + field.name, None)
            if given is None:
                continue
            kind = type(getattr(base, field.name))
            if kind is tuple:
                inner = type(getattr(base, field.name)[0])
                changed[field.name] = tuple(inner(x.strip()) for x in given.split(","))
            else:
                changed[field.name] = kind(given)
        return replace(base, **changed)
