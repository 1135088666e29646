"""Reading physical plans the way a Spark user does: through ``explain``.

Used by the tests to assert plan properties (no Cartesian product, no
Python evaluation, pruned scans) and by ``tools``-style inspection.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


_SCAN = re.compile(r"\(\d+\) Scan parquet.*?(?=\n\(\d+\) |\Z)", re.S)


def scan_summaries(df: DataFrame) -> list[dict[str, str]]:
    """Location, pushed filters and read schema of every Parquet scan."""
    out = []
    for block in _SCAN.findall(plan_text(df)):
        fields = dict(re.findall(r"^(Location|PushedFilters|ReadSchema): (.*)$", block, re.M))
        out.append({"location": fields.get("Location", ""), "pushed": fields.get("PushedFilters", ""),
                    "read_schema": fields.get("ReadSchema", "")})
    return out
