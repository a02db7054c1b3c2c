"""Sinks: JSON and CSV result files, tables, the Markdown report and line charts."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame


def write_json(path: str, payload: object) -> None:
    """A small result as JSON with sorted keys and an indent of two."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=True, default=str)


def write_csv(df: DataFrame, path: str) -> None:
    """A result as headed CSV, written by the executors; an empty one writes nothing."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("header", True).csv(path)


def report(title: str, rows: DataFrame) -> str:
    """A Markdown table of a small result."""
    names = rows.columns
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else "" if x is None else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.collect())]) + "\n"


def write_report(path: str, title: str, rows: DataFrame) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report(title, rows))


def plot(rows: DataFrame, x: str, *ys: str, width: int = 640, height: int = 400) -> str:
    """A small result as an SVG line chart of columns ``ys`` over ``x``; rows with nulls are left out."""
    points = sorted(tuple(float(v) for v in r) for r in rows.select(x, *ys).na.drop().collect())
    colours = ("#1b6ca8", "#c4571a", "#3d8b40", "#7d4a9e", "#8a7a1f")
    values = [v for p in points for v in p[1:]] or [0.0]
    low, high = min(values), max(values)
    left, right = (points[0][0], points[-1][0]) if points else (0.0, 1.0)
    px = lambda v: 60 + (width - 80) * (v - left) / ((right - left) or 1)
    py = lambda v: height - 40 - (height - 70) * (v - low) / ((high - low) or 1)
    text = lambda a, b, s, anchor="middle": f'<text x="{a:.1f}" y="{b:.1f}" font-size="12" text-anchor="{anchor}">{html.escape(s)}</text>'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="white"/>']
    out.append(f'<path d="M60 30V{height - 40}H{width - 20}" fill="none" stroke="black"/>')
    out += [text(px(p[0]), height - 22, f"{p[0]:g}") for p in points] + [text(width / 2, height - 6, x)]
    out += [text(54, py(v) + 4, f"{v:.4g}", "end") for v in sorted({low, high})]
    for i, name in enumerate(ys):
        colour = colours[i % len(colours)]
        line = " ".join(f"{px(p[0]):.1f},{py(p[i + 1]):.1f}" for p in points)
        out.append(f'<polyline points="{line}" fill="none" stroke="{colour}" stroke-width="2"/><g fill="{colour}">{text(70 + 110 * i, 20, name, "start")}</g>')
    return "\n".join([*out, "</svg>"]) + "\n"


def write_plot(path: str, rows: DataFrame, x: str, *ys: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(plot(rows, x, *ys))
