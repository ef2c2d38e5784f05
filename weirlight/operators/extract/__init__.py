"""Extractors by file type, run inside mapInPandas over the files of a repository.

An extractor takes (content, as_of) and returns facts as dictionaries; it reads no files. A file that it can't work
through gives one ERROR fact with the reason, so that a scan neither fails nor hides it. as_of is the day that date
expressions are worked out for; without it they stay open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlight.operators.extract import flows, jvm_code, python_code, shell_code, sql_code
from weirlight.schema import EXTRACTED, FIELDS, with_fact_id

Extractor = Callable[[str, str | None], list[dict[str, Any]]]
EXTRACTORS: dict[str, Extractor] = {
    "pyspark": python_code.extract, "hive": sql_code.extract, "shell": shell_code.extract, "scala": jvm_code.scala, "java": jvm_code.java, "nifi": flows.nifi,
    "json": flows.json_config, "yaml": flows.yaml_config, "properties": flows.properties, "xml": flows.xml, "conf": flows.conf,
}


def extract_text(content: str, file_type: str, as_of: str | None = None, extractors: dict[str, Extractor] | None = None) -> list[dict[str, Any]]:
    return (extractors or EXTRACTORS)[file_type](content, as_of)


def extract_facts(files: DataFrame, as_of: str | None = None, extractors: dict[str, Extractor] | None = None, partitions: int | None = None) -> DataFrame:
    """Facts of files (relative_path, file_type, content). Files are spread by a hash of their path, since a scan may hold all of them in few splits."""
    known = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, content in zip(b["relative_path"], b["file_type"], b["content"]):
                if kind not in known or content is None:
                    continue
                try:
                    got = known[kind](content, as_of)
                except Exception as e:  # noqa: BLE001 - one file must not end the scan; the fact says what happened
                    got = [{"fact_type": "ERROR", "line_number": 0, "confidence": 0.0, "extraction_method": "HEURISTIC", "evidence": f"{type(e).__name__}: {e}"[:200]}]
                rows += [{"source_file": path} | f for f in got]
            yield pd.DataFrame(rows, columns=FIELDS).astype({"line_number": "Int32", "has_placeholders": "boolean", "is_ambiguous": "boolean"}).astype(object).where(lambda x: x.notna(), None) if rows else pd.DataFrame({c: [] for c in FIELDS})

    spread = files.select("relative_path", "file_type", "content").repartition(*([partitions] if partitions else []), F.xxhash64("relative_path"))
    return with_fact_id(spread.mapInPandas(run, EXTRACTED))
