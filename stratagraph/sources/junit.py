"""JUnit XML results."""

from __future__ import annotations

import glob as globs
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import unmatched_cases

LIMIT = 10 * 1024 * 1024
COLUMNS = "suite string, name string, status string, duration_ms double, failure_message string"


def result_files(root: str, pattern: str) -> list[str]:
    """Files of a glob inside the project, sorted; an error if there is none or the pattern leads outside."""
    top = Path(root).resolve()
    found = sorted(p for p in globs.glob(os.path.join(root, pattern), recursive=True) if Path(p).resolve().is_relative_to(top) and os.path.isfile(p))
    if not found:
        raise FileNotFoundError(f"no result file fits {pattern}")
    return found


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The cases of result files."""
    return parse_results(spark.read.format("binaryFile").load(paths))


def parse_results(files: DataFrame) -> DataFrame:
    """suite, name, status, duration_ms, failure_message of all cases in files (path, length, content), nested suites included.

    Files over 10 MiB and such with DOCTYPE or ENTITY are refused."""

    def run(batches):
        from xml.etree import ElementTree

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, size, content in zip(pdf.path, pdf.length, pdf.content):
                if size > LIMIT:
                    raise ValueError(f"{path}: larger than {LIMIT} bytes")
                if b"<!DOCTYPE" in content.upper() or b"<!ENTITY" in content.upper():
                    raise ValueError(f"{path}: document types and entities are refused")
                stack = [(ElementTree.fromstring(content), "")]
                while stack:
                    element, suite = stack.pop()
                    if element.tag in ("testsuite", "testsuites"):
                        suite = element.get("name") or suite
                        stack += [(child, suite) for child in reversed(element)]
                    elif element.tag == "testcase":
                        bad = next((child for child in element if child.tag in ("failure", "error")), None)
                        status = "failed" if bad is not None else "skipped" if element.find("skipped") is not None else "passed"
                        try:
                            took = max(float(element.get("time") or 0), 0.0) * 1000
                        except ValueError:
                            took = 0.0
                        message = (bad.get("message") or (bad.text or "").strip()) if bad is not None else None
                        rows.append((suite, element.get("name") or "", status, 0.0 if took != took else took, message))
            yield pd.DataFrame(rows, columns=["suite", "name", "status", "duration_ms", "failure_message"])

    return files.mapInPandas(run, COLUMNS)


def unmatched(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results that fit no test case of the graph."""
    return unmatched_cases(results, nodes.where(F.col("type") == "test_case").select("name"))
