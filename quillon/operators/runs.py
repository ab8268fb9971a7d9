"""Reproducible runs: manifests and fingerprints, method registry, evidence checks, attempts and recovery of stale ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass
class Registry:
    """Methods by exact name and version: DataFrame to DataFrame."""

    methods: dict = field(default_factory=dict)

    def add(self, name: str, version: str, run: Callable[[DataFrame], DataFrame]) -> None:
        if (name, version) in self.methods:
            raise ValueError(f"{name} {version} is there already")
        self.methods[name, version] = run

    def require(self, name: str, version: str) -> Callable[[DataFrame], DataFrame]:
        if (name, version) not in self.methods:
            raise LookupError(f"no method {name} {version}; there are " + ", ".join(f"{n} {v}" for n, v in sorted(self.methods)))
        return self.methods[name, version]


def evidence_issues(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """result_id, evidence_index and the first issue of each piece of evidence that has one.

    evidence: result_id, evidence_index, artifact_id, start, end, excerpt, excerpt_sha256. texts: artifact_id, text.
    """
    w = Window.partitionBy("result_id").orderBy("evidence_index")
    rows = evidence.withColumn("_n", F.row_number().over(w) - 1).join(texts.select("artifact_id", "text"), "artifact_id", "left")
    span = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    issue = (
        F.when(F.col("text").isNull(), "unknown_artifact")
        .when(F.col("evidence_index") != F.col("_n"), "index_gap")
        .when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))), "bad_span")
        .when(span != F.col("excerpt"), "excerpt_differs")
        .when(F.sha2("excerpt", 256) != F.col("excerpt_sha256"), "hash_differs")
    )
    return rows.withColumn("issue", issue).where("issue is not null").select("result_id", "evidence_index", "issue")


def claims(events: DataFrame) -> DataFrame:
    """Runs folded from their event log (run_id, event_id, at, kind in prepared, claimed, succeeded, failed, recovered).

    A claim holds only on a prepared, failed or recovered run: of claims in a row the first wins.
    """
    w = Window.partitionBy("run_id").orderBy("at", "event_id")
    rows = events.withColumn("_before", F.lag("kind").over(w))
    valid = ~((F.col("kind") == "claimed") & F.col("_before").eqNullSafe(F.lit("claimed")))
    kept = rows.where(valid)
    by = kept.groupBy("run_id").agg(F.max_by("kind", F.struct("at", "event_id")).alias("last"), F.count_if(F.col("kind") == "claimed").alias("attempt_count"), F.max(F.when(F.col("kind") == "claimed", F.col("at"))).alias("claimed_at"))
    status = F.when(F.col("last") == "claimed", "running").when(F.col("last") == "recovered", "failed").otherwise(F.col("last"))
    return by.select("run_id", status.alias("status"), "attempt_count", "claimed_at")


def stale(runs: DataFrame, as_of, minutes: int) -> DataFrame:
    """Running runs claimed before as_of less minutes. The clock is a parameter."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return runs.where((F.col("status") == "running") & (F.col("claimed_at").cast("timestamp") < cutoff))
