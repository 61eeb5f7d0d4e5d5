"""A whole scan: files to findings, with built-in and registered detectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from lintlake.functions import catalog as K
from lintlake.operators import detect, flows
from lintlake.operators.findings import deduplicate
from lintlake.sources.files import config_kind, eligible_files, explode_lines, is_ignored

Detector = Callable[[DataFrame], DataFrame]
_registered: dict[str, Detector] = {}

ORDER = ["engine_rank", "file", "line", "rule_rank", "rule_id", "evidence"]


def register_detector(name: str, detector: Detector) -> None:
    """Add ``detector(files) -> findings``; its errors fail the scan that uses it."""
    _registered[name] = detector


def unregister_detector(name: str) -> None:
    """Take a registered detector out again; built-in ones stay."""
    _registered.pop(name, None)


def _heuristics(files: DataFrame) -> DataFrame:
    plain = [s for s in K.SCAN_SUFFIXES if s not in K.FLOW_SUFFIXES]
    return detect.scan_heuristics(explode_lines(eligible_files(files, plain)))


def _secrets(files: DataFrame) -> DataFrame:
    return detect.scan_secrets(explode_lines(eligible_files(files, K.SCAN_SUFFIXES)))


def _configuration(files: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return detect.scan_configuration(config_kind(files.where(~is_ignored(F.col("parts")))))


def detectors() -> dict[str, Detector]:
    return {
        "heuristics": _heuristics,
        "javascript": flows.scan_javascript,
        "secrets": _secrets,
        "configuration": _configuration,
        "python": flows.scan_python_flows,
        "java": flows.scan_java_flows,
        **_registered,
    }


def run_detectors(files: DataFrame, which: list[str] | None = None) -> DataFrame:
    """Union of the detectors' findings, in their common columns."""
    every = detectors()
    return reduce(DataFrame.unionByName, [every[name](files) for name in which or list(every)])


def scan(files: DataFrame, which: list[str] | None = None) -> DataFrame:
    """Findings of a scan, merged."""
    return deduplicate(run_detectors(files, which), ORDER)
