"""Where results go: Parquet, CSV, JSON, JDBC, one JSON document, an HTML page, a workbook, one CSV for each report sheet.

Nothing is overwritten unless asked for.
"""

from __future__ import annotations

import html
import json
import math
import re
import zipfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlight.operators.scoring import top

#: Rows that a report on one page, or one JSON document, may collect to the driver; larger results go to files instead.
PAGE_ROWS = 100_000


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_parquet(df: DataFrame, path: str, *partition_by: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).parquet(path, partitionBy=list(partition_by) or None)


def write_csv(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    for name, df in (("nodes", nodes), ("edges", edges.withColumn("evidence", F.substring("evidence", 1, 100))), ("metrics", metrics)):
        df.write.mode(_mode(overwrite)).csv(f"{path}/{name}", header=True, quoteAll=True, escape='"')


def write_json(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines of each relation; no driver is involved."""
    for name, df in (("nodes", nodes), ("edges", edges), ("metrics", metrics)):
        df.write.mode(_mode(overwrite)).json(f"{path}/{name}")


def write_json_document(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """One document with all three, for graphs of at most PAGE_ROWS rows each."""
    out: dict = {}
    for name, df in (("nodes", nodes), ("edges", edges), ("metrics", metrics)):
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(PAGE_ROWS + 1).collect()
        if len(rows) > PAGE_ROWS:
            raise ValueError(f"{name} has more than {PAGE_ROWS} rows; use write_json")
        out[name] = sorted((json.loads(r["j"]) for r in rows), key=lambda x: json.dumps(x, sort_keys=True))
    out["metadata"] = {k: len(v) for k, v in out.items()}
    with open(path, "w" if overwrite else "x") as f:
        json.dump(out, f, indent=1, sort_keys=True)


def write_database(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, url: str, prefix: str = "lineage_", properties: dict[str, str] | None = None) -> None:
    """Replaces the contents of three tables, so that a second run gives the same rows; tables are truncated, not dropped."""
    for name, df in (("nodes", nodes), ("edges", edges), ("metrics", metrics)):
        df.write.mode("overwrite").option("truncate", "true").jdbc(url, prefix + name, properties=properties or {})


def html_page(statistics: DataFrame, metrics: DataFrame, n: int = 10) -> str:
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    best = top(metrics, n).collect()
    counts = statistics.orderBy("kind", F.col("type").asc_nulls_first()).limit(100).collect()
    rows = lambda xs: "".join("<tr>" + "".join(map(cell, x)) + "</tr>" for x in xs)
    return (
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Lineage report</title><style>table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 8px}</style></head><body>"
        f"<h1>Lineage report</h1><h2>Graph</h2><table><tr><th>kind</th><th>type</th><th>number</th></tr>{rows((r['kind'], r['type'] or 'all', r['number']) for r in counts)}</table>"
        f"<h2>Datasets by priority</h2><table><tr><th>rank</th><th>dataset</th><th>score</th><th>reach</th><th>wave</th></tr>{rows((i, r['urn'], r['priority_score'], r['downstream_reach'], r['migration_wave']) for i, r in enumerate(best, 1))}</table></body></html>"
    )


def write_html(statistics: DataFrame, metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    with open(path, "w" if overwrite else "x") as f:
        f.write(html_page(statistics, metrics))


def write_sheets(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Each report relation as one CSV folder, in place of a workbook."""
    for name, df in sheets.items():
        df.write.mode(_mode(overwrite)).csv(f"{path}/{name}", header=True, quoteAll=True, escape='"')


def write_workbook(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """A workbook (Office Open XML) with a sheet for each report relation of at most PAGE_ROWS rows; the first row has the names. Larger relations go to write_sheets."""
    clean = lambda x: html.escape(re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", str(x)), quote=False)[:32_767]

    def cell(x: Any) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x):
            return f"<c><v>{x!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{clean(x)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, office, package = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006"))
    names = [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] for n in sheets]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"names of sheets are alike: {names}")
    with zipfile.ZipFile(path, "w" if overwrite else "x", zipfile.ZIP_DEFLATED) as out:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        out.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{html.escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, (name, df) in enumerate(sheets.items(), 1):
            rows = df.limit(PAGE_ROWS + 1).collect()
            if len(rows) > PAGE_ROWS:
                raise ValueError(f"{name} has more than {PAGE_ROWS} rows; use write_sheets")
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            out.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
