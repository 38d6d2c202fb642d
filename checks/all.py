"""Imports every module of checks, which registers their queries."""

from blocklens.operators import triage
from checks import (  # noqa: F401
    detectors,
    evaluation,
    features_and_splits,
    fixtures,
    sources_and_lines,
    triage_queries,
)


def flagship(spark, sf_dir):
    return triage.analyst_view(triage.alert_queue(fixtures.log_alerts(spark, sf_dir)))
