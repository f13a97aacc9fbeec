"""A report from the scores of variants: an HTML page with bars, and a text summary. Input is the small scores table."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import scoring


def table_html(frame: DataFrame, order: list[str]) -> str:
    rows = frame.orderBy(*order).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in frame.columns)
    body = "".join("<tr>" + "".join(f"<td>{x:.3f}</td>" if isinstance(x, float) else f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def bars_svg(frame: DataFrame, label: str, value: str) -> str:
    rows = frame.orderBy(F.desc(value), label).select(label, value).collect()
    bars = "".join(f'<text x="0" y="{20 * i + 14}">{escape(str(n))}</text><rect x="180" y="{20 * i + 3}" width="{300 * max(0.0, v or 0.0):.1f}" height="14"/><text x="490" y="{20 * i + 14}">{(v or 0.0):.1%}</text>' for i, (n, v) in enumerate(rows))
    return f'<svg width="560" height="{20 * len(rows) + 6}">{bars}</svg>'


def radar_svg(frame: DataFrame) -> str:
    """A polygon for each method, with an axis for each dimension."""
    points: dict[str, list[str]] = {}
    for r in frame.orderBy("method", "axis").collect():
        points.setdefault(r["method"], []).append(f"{120 + 100 * r['value'] * math.cos(r['angle']):.1f},{120 - 100 * r['value'] * math.sin(r['angle']):.1f}")
    shapes = "".join(f'<polygon points="{" ".join(corners)}" fill="none" stroke="black"><title>{escape(name)}</title></polygon>' for name, corners in points.items())
    return f'<svg width="240" height="240">{shapes}</svg>'


def shade(x: float) -> str:
    """Red at 0, yellow at 0.5, green at 1."""
    x = min(1.0, max(0.0, x))
    return f"rgb({int(255 * min(1.0, 2 - 2 * x))},{int(255 * min(1.0, 2 * x))},90)"


def heatmap_svg(frame: DataFrame) -> str:
    """A row of ``scoring.heatmap`` for each method, baselines first, and a shaded cell with its figure for each score."""
    names = [*scoring.DIMENSIONS, "overall_score"]
    rows = frame.orderBy("place", "method").collect()
    head = "".join(f'<text x="{205 + 90 * i}" y="14">{name.replace("_", " ")}</text>' for i, name in enumerate(names))
    drawn = []
    for j, r in enumerate(rows):
        drawn.append(f'<text x="0" y="{24 * j + 40}">{escape(r["method"])}</text>')
        for i, name in enumerate(names):
            x = r[name] or 0.0
            drawn.append(f'<rect x="{200 + 90 * i}" y="{24 * j + 24}" width="88" height="22" fill="{shade(x)}"/><text x="{225 + 90 * i}" y="{24 * j + 40}">{x:.3f}</text>')
    return f'<svg width="{200 + 90 * len(names)}" height="{24 * len(rows) + 30}">{head}{"".join(drawn)}</svg>'


def breakdown_svg(frame: DataFrame) -> str:
    """A panel of ``scoring.breakdown`` for each dimension, two by two: for each variant a bar of its conditional and one of its unconditional score, from 0 to 1."""
    panels: dict[str, list] = {d: [] for d in scoring.DIMENSIONS}
    for r in frame.orderBy("dimension", "variant").collect():
        panels[r["dimension"]].append(r)
    width = 60 + 70 * max((len(rows) for rows in panels.values()), default=0)
    drawn = []
    for k, (dimension, rows) in enumerate(panels.items()):
        left, base = width * (k % 2), 180 + 210 * (k // 2)
        drawn.append(f'<text x="{left + 10}" y="{base - 160}">{dimension}</text>' + "".join(f'<line x1="{left + 30}" x2="{left + width - 10}" y1="{base - 140 * y:.0f}" y2="{base - 140 * y:.0f}" stroke="#ccc"/>' for y in (0, 0.5, 1)))
        for i, r in enumerate(rows):
            x = left + 40 + 70 * i
            for at, kind, colour in ((0, "conditional", "steelblue"), (26, "unconditional", "indianred")):
                height = 140 * min(1.0, max(0.0, r[kind] or 0.0))
                drawn.append(f'<rect x="{x + at}" y="{base - height:.1f}" width="24" height="{height:.1f}" fill="{colour}"><title>{escape(r["variant"])} {kind}</title></rect>')
            drawn.append(f'<text x="{x}" y="{base + 16}">{escape(r["variant"])}</text>')
    return f'<svg width="{2 * width}" height="420">{"".join(drawn)}</svg>'


def overlay_svg(frame: DataFrame, column: str) -> str:
    """The series of ``shape.overlay`` in one column, a line for each variant, with the part that all of them reach marked."""
    rows = frame.where((F.col("column") == column) & F.col("value").isNotNull()).orderBy("variant", "t").collect()
    if not rows:
        return "<svg></svg>"
    low, high, last = min(r["value"] for r in rows), max(r["value"] for r in rows), max(r["t"] for r in rows) or 1
    lines: dict[str, list[str]] = {}
    for r in rows:
        lines.setdefault(r["variant"], []).append(f"{500 * r['t'] / last:.1f},{140 - 130 * (r['value'] - low) / ((high - low) or 1.0):.1f}")
    drawn = "".join(f'<polyline points="{" ".join(places)}" fill="none" stroke="{colour}"><title>{escape(name)}</title></polyline>' for (name, places), colour in zip(lines.items(), ("black", "red", "green", "blue") * len(lines)))
    return f'<svg width="500" height="150"><rect width="{500 * min(rows[0]["overlap_end"] / last, 1.0):.1f}" height="150" fill="#efe"/>{drawn}</svg>'


def html(scores: DataFrame, config: Config = DEFAULT, columns: DataFrame | None = None, overlay: DataFrame | None = None) -> str:
    """Overall bars, the heatmap and the breakdown as drawings and tables, radar, business figures and recommendations; with ``columns``, the scores by
    column and method as of ``evaluate.column_scores``; with ``overlay``, the lines of ``shape.overlay``."""
    heat = scoring.heatmap(scores, config)
    parts = [
        "<!doctype html><meta charset='utf-8'><title>Series evaluation</title>",
        "<h2>Overall</h2>", bars_svg(scoring.overall_bars(scores, config), "method", "overall_score"),
        "<h2>Scores</h2>", heatmap_svg(heat), table_html(heat, ["place", "method"]),
        "<h2>By dimension</h2>", breakdown_svg(scoring.breakdown(scores)), table_html(scoring.breakdown(scores), ["dimension", "variant"]), radar_svg(scoring.radar(scores)),
        "<h2>Best variant</h2>", table_html(scoring.business_figures(scores, config), ["gen_type"]),
        "<h2>Recommendations</h2>", table_html(scoring.recommendations(scores, config), ["gen_type", "recommendation"]),
    ]
    if columns is not None:
        parts += ["<h2>By column</h2>", table_html(scoring.column_table(columns), ["gen_type", "method", "place", "column"])]
    if overlay is not None:
        parts += [f"<h2>{escape(c)}</h2>" + overlay_svg(overlay, c) for (c,) in overlay.select("column").distinct().orderBy("column").collect()]
    return "\n".join(parts)


def rating(overall: float) -> str:
    return "Excellent" if overall > 0.7 else "Good" if overall > 0.5 else "Needs Improvement"


def summary(scores: DataFrame, config: Config = DEFAULT) -> str:
    """Overall performance and rating, best variants, baselines, averages of each generation type and recommendations, as text."""
    averages = scoring.metric_averages(scores, config).orderBy("gen_type").collect()
    positive = [r["overall_score"] for r in averages if r["overall_score"] > 0]
    overall = sum(positive) / len(positive) if positive else 0.0
    out = [f"overall {overall:.1%} ({rating(overall)})"]
    best = {r["gen_type"]: r for r in scoring.best_variants(scores, config).collect()}
    for r in scoring.overall_scores(scores, config).where("variant_type = 'baseline'").orderBy("variant").collect():
        out.append(f"baseline {r['variant']}: {r['overall_score']:.1%}")
    for r in averages:
        out.append(f"{r['gen_type']}: best {best[r['gen_type']]['best_variant']} ({best[r['gen_type']]['overall_score']:.1%}); means " + ", ".join(f"{d} {r[d]:.1%}" for d in scoring.DIMENSIONS))
    out += [f"{r['gen_type']}: {r['recommendation']}" for r in scoring.recommendations(scores, config).orderBy("gen_type", "recommendation").collect()]
    return "\n".join(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A summary or page as one text file in the folder ``path``."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
