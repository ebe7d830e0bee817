"""A self-contained HTML chart of step-function series, and the text of its numbers."""

from __future__ import annotations

import json
import tempfile
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series

#: Of series with more points the page draws, for each of so many equal spans of time, the first, least, greatest and last one.
MAX_POINTS, SPANS = 20_000, 4_000
TITLES = {
    (False, False): "number of packages depending directly",
    (False, True): "number of packages depending transitively",
    (True, False): "fraction of all packages depending directly",
    (True, True): "fraction of all packages depending transitively",
}


def truncated(value: float) -> str:
    """A fraction in single precision, four characters from its first nonzero digit on, without trailing zeros."""
    text = np.format_float_positional(np.float32(value), unique=True, trim="0")
    digits = [i for i, c in enumerate(text) if c in "123456789"]
    if not digits:
        return text.removesuffix(".0")
    text = text[: digits[0] + 4]
    return text[: max(i for i, c in enumerate(text) if c in "123456789") + 1]


def points(found: DataFrame, now: datetime, totals: DataFrame | None = None) -> dict[int, list[list[float]]]:
    """For each query its chart points (milliseconds, value or share) in order; long series are thinned before they come to the driver."""
    at = series.chart_points(found, F.lit(now.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
    if totals is None:
        rows = at.select("query_id", F.unix_millis("ts").alias("ms"), F.col("value").cast("double").alias("shown"))
    else:
        probes = at.select("ts").distinct().withColumn("_n", F.lit(0).cast("long"))
        steps = totals.unionByName(probes.withColumnRenamed("_n", "n")).withColumn("_all", F.lit(0))
        total = series.cumulative(steps, ["_all"], "ts", "n", "total")
        rows = at.join(total, "ts").select("query_id", F.unix_millis("ts").alias("ms"), series.chart_value(F.col("value"), F.col("total")).alias("shown"))
    out: dict[int, list[list[float]]] = {}
    for r in series.thinned(rows, MAX_POINTS, SPANS).orderBy("query_id", "ms").toLocalIterator():
        value = r["shown"] if totals is None else float(truncated(r["shown"]))
        out.setdefault(r["query_id"], []).append([r["ms"], int(value) if totals is None else value])
    return out


def first_releases(releases: DataFrame) -> DataFrame:
    """(ts, n): how many packages had their first release at each time."""
    return releases.groupBy("crate_id").agg(F.min("created_at").alias("ts")).groupBy("ts").agg(F.count("*").alias("n"))


def page(data: dict[int, list[list[float]]], labels: list[str], title: str, relative: bool) -> str:
    """The HTML, with everything it needs inside."""
    lines = [{"name": name, "values": data.get(i, [])} for i, name in enumerate(labels)]
    text = json.dumps({"title": title, "relative": relative, "lines": lines}).replace("</", "<\\/")
    return TEMPLATE.replace("/*DATA*/", text)


def write(found: DataFrame, labels: list[str], transitive: bool, title: str | None = None, releases: DataFrame | None = None, now: datetime | None = None) -> Path:
    """Write the chart to a new file named by the time; ``releases`` makes it relative."""
    now = now or datetime.now(UTC)
    relative = releases is not None
    data = points(found, now, first_releases(releases) if relative else None)
    folder = Path(tempfile.gettempdir()) / "epochgraph"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{int(now.timestamp() * 1000)}.html"
    path.write_text(page(data, labels, title or TITLES[relative, transitive], relative), encoding="utf-8")
    return path


TEMPLATE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>epochgraph</title>
<style>body{font:14px sans-serif;margin:24px}svg{width:100%;height:80vh}path{fill:none;stroke-width:1.5}.axis{stroke:#999}.tip{position:fixed;background:#fff;border:1px solid #999;padding:4px;pointer-events:none;display:none}</style>
</head><body><h2 id="title"></h2><svg id="chart" viewBox="0 0 1200 640"></svg><div id="legend"></div><div class="tip" id="tip"></div>
<script>
const chart = /*DATA*/;
document.getElementById('title').textContent = chart.title;
const all = chart.lines.flatMap(l => l.values), svg = document.getElementById('chart'), W = 1200, H = 640, L = 70, B = 40, T = 10, R = 20;
const x0 = Math.min(...all.map(p => p[0])), x1 = Math.max(...all.map(p => p[0])), top1 = Math.max(...all.map(p => p[1])) * 1.05 || 1;
const X = t => L + (t - x0) / (x1 - x0 || 1) * (W - L - R), Y = v => H - B - v / top1 * (H - B - T);
const shown = v => chart.relative ? (v * 100).toPrecision(3) + '%' : Math.round(v).toLocaleString();
const add = (name, attributes, text) => { const e = document.createElementNS('http://www.w3.org/2000/svg', name); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.appendChild(e); return e; };
const color = i => `hsl(${i * 137.5 % 360} 65% 45%)`;
for (let i = 0; i <= 5; i++) {
  const v = top1 * i / 5, t = x0 + (x1 - x0) * i / 5;
  add('line', {x1: L, x2: W - R, y1: Y(v), y2: Y(v), stroke: '#eee'});
  add('text', {x: L - 8, y: Y(v) + 4, 'text-anchor': 'end'}, shown(v));
  add('text', {x: X(t), y: H - B + 20, 'text-anchor': 'middle'}, new Date(t).toISOString().slice(0, 10));
}
add('line', {class: 'axis', x1: L, x2: L, y1: T, y2: H - B}); add('line', {class: 'axis', x1: L, x2: W - R, y1: H - B, y2: H - B});
chart.lines.forEach((line, i) => {
  add('path', {stroke: color(i), d: line.values.map((p, k) => (k ? `H${X(p[0])}V` : `M${X(p[0])},`) + Y(p[1])).join('')});
  const e = document.createElement('div'); e.style.color = color(i); e.textContent = line.name; document.getElementById('legend').appendChild(e);
});
svg.onmousemove = e => {
  const box = svg.createSVGPoint(); box.x = e.clientX; box.y = e.clientY;
  const t = x0 + (box.matrixTransform(svg.getScreenCTM().inverse()).x - L) / (W - L - R) * (x1 - x0), tip = document.getElementById('tip');
  const at = line => { let a = 0, b = line.values.length; while (a < b) { const m = (a + b) >> 1; if (line.values[m][0] <= t) a = m + 1; else b = m; } return a ? line.values[a - 1][1] : 0; };
  tip.style.display = 'block'; tip.style.left = e.clientX + 12 + 'px'; tip.style.top = e.clientY + 12 + 'px';
  tip.innerText = new Date(t).toISOString().slice(0, 10) + '\\n' + chart.lines.map(l => l.name + ': ' + shown(at(l))).join('\\n');
};
</script></body></html>
"""
