"""Reports of small frames: markdown, JSON, and an HTML map. Rows are collected, at most MOST_ROWS of them."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

#: A report is read by people; a larger frame is an error, not a cut.
MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has over {MOST_ROWS} rows")
    return rows


def markdown(df: DataFrame) -> str:
    lines = [" | ".join(df.columns), " | ".join("-" for _ in df.columns)]
    lines += [" | ".join("" if v is None else str(v).replace("|", "\\|") for v in r.values()) for r in _rows(df)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def bundle(df: DataFrame, prefix: str) -> dict[str, str]:
    """Writes markdown, JSON and HTML next to each other, and a manifest of them; returns their paths."""
    text, rows = markdown(df), _rows(df)
    parts = {"md": text, "json": json.dumps(rows, sort_keys=True, default=str), "html": f"<!doctype html><meta charset=utf-8><pre>{html.escape(text)}</pre>"}
    paths = {}
    for kind, content in parts.items():
        paths[kind] = f"{prefix}.{kind}"
        Path(paths[kind]).write_text(content, encoding="utf-8")
    paths["manifest"] = f"{prefix}.manifest.json"
    Path(paths["manifest"]).write_text(json.dumps({k: Path(v).name for k, v in paths.items()}, sort_keys=True), encoding="utf-8")
    return paths


def map_html(links: DataFrame, path: str, size: int = 800) -> None:
    """A standalone map of links (ax, ay, bx, by, queue): wider lines queue more."""
    rows = _rows(links.select("ax", "ay", "bx", "by", "queue"))
    xs = [r[k] for r in rows for k in ("ax", "bx")] or [0.0]
    ys = [r[k] for r in rows for k in ("ay", "by")] or [0.0]
    scale = size / max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    most = max((r["queue"] for r in rows), default=0) or 1
    at = lambda x, y: (round((x - min(xs)) * scale, 1), round((max(ys) - y) * scale, 1))
    lines = []
    for r in rows:
        (x1, y1), (x2, y2) = at(r["ax"], r["ay"]), at(r["bx"], r["by"])
        lines.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="#345" stroke-width="{1 + 5 * r["queue"] / most:.2f}"/>')
    Path(path).write_text(f'<!doctype html><meta charset=utf-8><svg viewBox="-10 -10 {size + 20} {size + 20}">{"".join(lines)}</svg>', encoding="utf-8")
