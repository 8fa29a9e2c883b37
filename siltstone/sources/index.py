"""Versions of an index as parquet folders, published one after the other, and taken back if that fails."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import cosine
from siltstone.sources.files import get, names, put_new, remove

REQUIRED = {"point_id": "string", "document_id": "bigint", "embedding": "array<float>"}


#: The fields of a point's payload that searches filter or sort by, and their types.
PAYLOAD = {
    "chunk_id": "string", "document_id": "string", "source_id": "string", "tags": "array<string>", "published_at": "string", "question_score": "bigint", "accepted_answer": "boolean", "has_code": "boolean",
    "section_type": "string", "document_status": "string", "processing_status": "string", "deduplication_status": "string",
}


def schema_hash(settings: dict[str, object]) -> str:
    """A hash of an index's settings (models, sizes, versions) that does not hang on their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_schema(points: DataFrame, required: dict[str, str] = REQUIRED) -> None:
    """Raises an error that names every column that is missing or of another type."""
    found = dict(points.dtypes)
    wrong = {c: found.get(c) for c, kind in required.items() if found.get(c) != kind}
    if wrong:
        raise ValueError(f"points have wrong or missing columns: {wrong}")


def check_settings(stored: dict[str, object], wanted: dict[str, object]) -> None:
    """Raises an error that names every setting of a stored index that differs from what is wanted."""
    wrong = {k: (stored.get(k), wanted.get(k)) for k in stored.keys() | wanted.keys() if stored.get(k) != wanted.get(k)}
    if wrong:
        raise IndexFailure(f"INDEX_SCHEMA_MISMATCH: {dict(sorted(wrong.items()))}")


def write_version(points: DataFrame, root: str, version: int) -> DataFrame:
    """Writes a new version beside the old ones and returns it as written."""
    check_schema(points)
    path = f"{root}/version={version}"
    points.write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path)


class IndexFailure(RuntimeError):
    """A version that could not be published, by its code."""


class LostRace(IndexFailure):
    """Another writer has switched the pointer meanwhile."""


@dataclass
class IndexVersions:
    """Versions of an index in one folder, and a pointer that all sessions and clusters read.

    The pointer is a numbered history of small files; a switch writes the next number, which only one
    writer can.  A version's status is the last of its own history: BUILDING, READY, ACTIVE, RETIRED
    or FAILED with a code.
    """

    spark: SparkSession
    root: str
    dimensions: int | None = None

    def pointer(self) -> tuple[int, int | None]:
        """The pointer's number and the version it names; (0, None) before the first."""
        found = names(self.spark, f"{self.root}/pointer")
        if not found:
            return 0, None
        return int(found[-1][:-5]), json.loads(get(self.spark, f"{self.root}/pointer/{found[-1]}"))["version"]

    def _point(self, seen: int, version: int | None) -> bool:
        return put_new(self.spark, f"{self.root}/pointer/{seen + 1:012d}.json", json.dumps({"version": version}))

    def history(self, version: int) -> list[dict]:
        folder = f"{self.root}/status/{version}"
        return [json.loads(get(self.spark, f"{folder}/{n}")) for n in names(self.spark, folder)]

    def status(self, version: int) -> str | None:
        told = self.history(version)
        return told[-1]["status"] if told else None

    def _tell(self, version: int, status: str, **more) -> None:
        n = len(self.history(version))
        put_new(self.spark, f"{self.root}/status/{version}/{n:06d}.json", json.dumps({"status": status} | more))

    def versions(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.root}/status"))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={version}")

    def current(self) -> DataFrame:
        """The points of the active version."""
        _, version = self.pointer()
        if version is None:
            raise IndexFailure("NO_ACTIVE_VERSION")
        return self.read(version)

    def build(self, points: DataFrame, version: int, settings: dict[str, object] | None = None) -> int:
        """Writes a new version beside the others, checks it and makes it READY; returns its points' number.

        It must hold each point that it was given once, of the right size, and find one of them by its own vector.
        A version that fails a check is FAILED and no other is touched.
        """
        if self.status(version) not in (None, "FAILED"):
            raise IndexFailure("VERSION_EXISTS")
        self._tell(version, "BUILDING", schema_hash=schema_hash(settings or {}))
        try:
            expected = points.count()
            rows = write_version(points, self.root, version)
            self._check(rows, expected)
        except Exception as e:
            self._tell(version, "FAILED", code=str(e) if isinstance(e, IndexFailure) else type(e).__name__)
            raise
        self._tell(version, "READY", points=expected)
        return expected

    def _check(self, rows: DataFrame, expected: int) -> None:
        size = F.size("embedding")
        found = rows.agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.min(size).alias("least"), F.max(size).alias("most"), F.count("embedding").alias("vectors")).first()
        if found["n"] != expected or found["ids"] != expected:
            raise IndexFailure("INDEX_POINT_COUNT_MISMATCH")
        if found["vectors"] != expected:
            raise IndexFailure("EMBEDDING_MISSING")
        if expected and (found["least"] != found["most"] or found["least"] != (self.dimensions or found["least"]) or found["least"] < 1):
            raise IndexFailure("EMBEDDING_DIMENSION_MISMATCH")
        lengthy = F.exists("embedding", lambda x: x != 0)
        sample = rows.where(lengthy).orderBy("point_id").limit(1).select(F.lit(0).cast("bigint").alias("query"), F.col("embedding").alias("asked"), "document_id")
        if expected:
            near = cosine(rows.select("document_id", "embedding"), sample, "document_id", "query", 1).first()
            if near is None or not near["score"] > 0.999:
                raise IndexFailure("INDEX_SAMPLE_VALIDATION_FAILED")

    def activate(self, version: int, seen: int | None = None, after: Callable[[int | None], None] | None = None) -> None:
        """Points at a READY version and retires the one before.

        ``seen`` is the pointer's number that the caller decided by (default: now); if another writer was
        faster, nothing changes.  ``after`` is what has to follow a switch, such as marking documents as
        indexed; if that fails, the pointer goes back to the version before, unless another has moved it.
        """
        now, before = self.pointer()
        if self.status(version) not in ("READY", "RETIRED"):
            raise IndexFailure("VERSION_NOT_READY")
        if seen is not None and seen != now or not self._point(now, version):
            raise LostRace("POINTER_MOVED")
        try:
            if after is not None:
                after(before)
        except Exception:
            self._point(now + 1, before)
            self._tell(version, "FAILED", code="ACTIVATION_FAILED")
            raise
        if before is not None and before != version:
            self._tell(before, "RETIRED")
        self._tell(version, "ACTIVE")

    def sweep(self, keep: int) -> list[int]:
        """Removes the points of failed versions and of all but the newest ``keep`` retired ones; never those pointed at."""
        _, active = self.pointer()
        retired = [v for v in self.versions() if self.status(v) == "RETIRED"]
        gone = [v for v in self.versions() if v != active and (self.status(v) == "FAILED" or v in retired[: max(0, len(retired) - keep)])]
        return [v for v in gone if remove(self.spark, f"{self.root}/version={v}")]
