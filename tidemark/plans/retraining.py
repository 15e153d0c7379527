"""Drift to retraining, and scan reports to alerts: the two standing jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift, reports
from tidemark.plans.training import Params, TrainingResult, train


def retrain_if_drifted(reference: DataFrame, current: DataFrame, source: DataFrame, params: Params | None = None,
                       threshold: float = 0.1) -> TrainingResult | None:
    """Drift report, decision, and a training run when the share is above the threshold."""
    verdict = drift.drift_report(reference, current, threshold=threshold).agg(F.max("dataset_drift").alias("drifted"))
    return train(source, params) if verdict.first()["drifted"] else None


def scan_panels(good_reports: DataFrame) -> dict[str, DataFrame]:
    """All report tables of one cycle, from one set of reports."""
    found = reports.findings(good_reports)
    counts = reports.vuln_counts(found)
    return {
        "counts": counts,
        "details": reports.vuln_details(found),
        "last_scan": reports.last_scan(good_reports),
        "images": reports.images_scanned(good_reports),
        "matrix": reports.to_matrix(counts, "image", "severity", "n", [*reports.SEVERITIES, "UNKNOWN"]),
    }
