"""Reports: Spark makes the few rows of each section, this joins them to text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def sections(parts: dict[str, DataFrame], limit: int = 20) -> dict[str, list[dict]]:
    """The first ``limit`` rows of each part; the parts are rankings."""
    return {name: [r.asDict(recursive=True) for r in df.limit(limit).collect()] for name, df in parts.items()}


def as_markdown(title: str, found: dict[str, list[dict]]) -> str:
    lines = [f"# {title}"]
    for name, rows in found.items():
        lines += ["", f"## {name}", ""]
        if not rows:
            lines.append("Nothing found.")
            continue
        names = list(rows[0])
        lines += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        lines += ["| " + " | ".join(str(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def as_json(title: str, found: dict[str, list[dict]]) -> str:
    return json.dumps({"title": title, **found}, default=str, ensure_ascii=False)


def as_summary(title: str, found: dict[str, list[dict]]) -> str:
    return "\n".join([title, *(f"{name}: {len(rows)} rows" + (f", first {next(iter(rows[0].values()))}" if rows else "") for name, rows in found.items())])


def as_html(title: str, found: dict[str, list[dict]]) -> str:
    """A static page with one table for each section."""
    from html import escape

    body = []
    for name, rows in found.items():
        head = "".join(f"<th>{escape(n)}</th>" for n in (rows[0] if rows else ()))
        cells = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
        body.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{cells}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(body)}</body></html>"
