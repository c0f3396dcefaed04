"""The HTML report over small result tables."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from tidestat.operators.summary import mod_summary, sample_summary
from tidestat.registry import REGISTRY, stat_title

NOTE = "N50* is the next shorter read length than N50."


def html_table(df: DataFrame, most: int = 10_000) -> str:
    """An HTML table; doubles with two digits (half to even). What is beyond `most` rows is counted in a last line."""
    show = lambda v: f"{round(v, 2)}" if isinstance(v, float) else str(v)
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join(
        "<tr>" + "".join(f"<td>{escape(show(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect()
    )
    if (rows := df.count()) > most:
        body += f'<tr><td colspan="{len(df.columns)}">{rows - most} more rows are in the file</td></tr>'
    return f"<table><tr>{head}</tr>{body}</table>"


def sample_name(path: str) -> str:
    """The folder two levels above the statistics' files."""
    return PurePosixPath(path).parent.name or "sample"


def html_report(sample: str, data: Mapping[str, DataFrame]) -> str:
    """Contents, summary tables, and a drawing for each statistic, sorted by name."""
    names = sorted(data)
    toc = "".join(f'<li><a href="#{n}">{escape(stat_title(n))}</a></li>' for n in names)
    body = ""
    if "ChromStat" in data or "ReadLengthCounter" in data:
        body += html_table(sample_summary(data.get("ChromStat"), data.get("ReadLengthCounter"))) + f"<p>{NOTE}</p>"
    if "ModHist" in data:
        body += html_table(mod_summary(data["ModHist"]))
    for n in names:
        drawn = REGISTRY[n]().plot(data[n]) if n in REGISTRY else html_table(data[n])
        body += f'<h2 id="{n}">{escape(stat_title(n))}</h2>{drawn}'
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(sample)}</title><style>{style}</style></head><body><h1>{escape(sample)}</h1><ul>{toc}</ul>{body}</body></html>"
