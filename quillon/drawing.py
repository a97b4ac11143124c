"""Small plots as SVG files from the bounded tables of ``operators.plots``.

A file's name holds a hash of what is drawn, so a plot that is there already is not drawn again.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
from pathlib import Path

WIDTH, HEIGHT, PAD = 640, 400, 46
COLOURS = ["#2f6f9f", "#c2622d", "#3f8f5a", "#8a5aa8", "#b23a48", "#7a7a2e", "#3a8f8f", "#6b6b6b"]

Points = list[tuple[float, float]]


def frame(body: str, title: str, low: tuple[float, float] | None = None, high: tuple[float, float] | None = None) -> str:
    """A titled drawing, with the ends of its axes written beside them."""
    ends = ""
    if low and high:
        place = [(PAD, HEIGHT - PAD + 16, low[0], "start"), (WIDTH - PAD, HEIGHT - PAD + 16, high[0], "end"), (PAD - 4, HEIGHT - PAD, low[1], "end"), (PAD - 4, PAD + 4, high[1], "end")]
        ends = "".join(f'<text x="{x}" y="{y}" text-anchor="{anchor}" font-size="11">{v:.4g}</text>' for x, y, v, anchor in place)
        ends += f'<path d="M{PAD} {PAD}V{HEIGHT - PAD}H{WIDTH - PAD}" fill="none" stroke="#888"/>'
    head = f'<title>{html.escape(title)}</title><text x="{WIDTH / 2}" y="20" text-anchor="middle" font-size="14">{html.escape(title)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif">{head}{ends}{body}</svg>'


def scaled(series: dict[str, Points]) -> tuple[dict[str, Points], tuple[float, float], tuple[float, float]]:
    """Finite points in pixels, and the ends of both axes."""
    fine = {k: [(float(x), float(y)) for x, y in v if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)] for k, v in series.items()}
    every = [p for v in fine.values() for p in v]
    if not every:
        return {k: [] for k in fine}, (0.0, 0.0), (1.0, 1.0)
    (x0, x1), (y0, y1) = ((min(c), max(c)) for c in zip(*every, strict=True))
    px = lambda x: PAD + (WIDTH - 2 * PAD) * ((x - x0) / (x1 - x0) if x1 > x0 else 0.5)
    py = lambda y: HEIGHT - PAD - (HEIGHT - 2 * PAD) * ((y - y0) / (y1 - y0) if y1 > y0 else 0.5)
    return {k: [(px(x), py(y)) for x, y in v] for k, v in fine.items()}, (x0, y0), (x1, y1)


def legend(names: list[str]) -> str:
    return "".join(f'<text x="{WIDTH - PAD}" y="{40 + 14 * i}" text-anchor="end" font-size="11" fill="{COLOURS[i % len(COLOURS)]}">{html.escape(n)}</text>' for i, n in enumerate(names)) if len(names) > 1 else ""


def scatter(series: dict[str, Points], title: str) -> str:
    at, low, high = scaled(series)
    body = "".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="2" fill="{COLOURS[i % len(COLOURS)]}" fill-opacity=".6"/>' for i, v in enumerate(at.values()) for x, y in v)
    return frame(body + legend(list(at)), title, low, high)


def lines(series: dict[str, Points], title: str) -> str:
    at, low, high = scaled({k: sorted(v) for k, v in series.items()})
    body = "".join(f'<polyline points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in v)}" fill="none" stroke="{COLOURS[i % len(COLOURS)]}" stroke-width="1.5"/>' for i, v in enumerate(at.values()) if v)
    return frame(body + legend(list(at)), title, low, high)


def bars(values: list[tuple[str, float]], title: str) -> str:
    top = max((v for _, v in values), default=0.0) or 1.0
    step = (WIDTH - 2 * PAD) / max(1, len(values))
    body = "".join(f'<rect x="{PAD + i * step:.1f}" y="{HEIGHT - PAD - (HEIGHT - 2 * PAD) * max(0.0, v) / top:.1f}" width="{max(1.0, step - 2):.1f}" height="{(HEIGHT - 2 * PAD) * max(0.0, v) / top:.1f}" fill="{COLOURS[0]}"><title>{html.escape(str(n))}: {v:g}</title></rect>' for i, (n, v) in enumerate(values))
    return frame(body, title, (0.0, 0.0), (float(len(values)), float(top)))


def boxes(rows: list[tuple[str, float, float, float, float, float]], title: str) -> str:
    """(level, low, q1, median, q3, high) a box."""
    low, high = min((r[1] for r in rows), default=0.0), max((r[5] for r in rows), default=1.0)
    py = lambda y: HEIGHT - PAD - (HEIGHT - 2 * PAD) * ((y - low) / (high - low) if high > low else 0.5)
    step = (WIDTH - 2 * PAD) / max(1, len(rows))
    body = ""
    for i, (level, a, q1, m, q3, b) in enumerate(rows):
        x, w = PAD + (i + 0.2) * step, 0.6 * step
        body += f'<g><title>{html.escape(str(level))}</title><path d="M{x + w / 2:.1f} {py(a):.1f}V{py(q1):.1f}M{x + w / 2:.1f} {py(q3):.1f}V{py(b):.1f}" stroke="#444"/><rect x="{x:.1f}" y="{py(q3):.1f}" width="{w:.1f}" height="{py(q1) - py(q3):.1f}" fill="{COLOURS[0]}" fill-opacity=".4" stroke="#444"/><path d="M{x:.1f} {py(m):.1f}H{x + w:.1f}" stroke="#444" stroke-width="2"/></g>'
    return frame(body, title, (0.0, low), (float(len(rows)), high))


def pie(values: list[tuple[str, float]], title: str) -> str:
    total, angle, body, r = sum(v for _, v in values) or 1.0, -math.pi / 2, "", 140
    for i, (name, v) in enumerate(values):
        share = v / total
        label = f"<title>{html.escape(str(name))}: {100 * share:.1f} %</title>"
        colour = COLOURS[i % len(COLOURS)]
        if share >= 1 - 1e-12:
            body += f'<circle cx="{WIDTH / 2}" cy="{HEIGHT / 2}" r="{r}" fill="{colour}">{label}</circle>'
            break
        after = angle + 2 * math.pi * share
        (x0, y0), (x1, y1) = ((WIDTH / 2 + r * math.cos(t), HEIGHT / 2 + r * math.sin(t)) for t in (angle, after))
        body += f'<path d="M{WIDTH / 2} {HEIGHT / 2}L{x0:.1f} {y0:.1f}A{r} {r} 0 {int(share > 0.5)} 1 {x1:.1f} {y1:.1f}Z" fill="{colour}">{label}</path>'
        angle = after
    return frame(body + legend([str(n) for n, _ in values]), title)


def heatmap(cells: list[tuple[int, int, str, str, float]], title: str) -> str:
    """(row, column, their names, correlation) a cell."""
    n = 1 + max((max(c[0], c[1]) for c in cells), default=0)
    s = (HEIGHT - PAD) / n
    shade = lambda v: f"rgb({int(255 - 190 * max(0.0, -v))},{int(255 - 190 * abs(v))},{int(255 - 190 * max(0.0, v))})"
    body = "".join(f'<rect x="{PAD + j * s:.1f}" y="{PAD - 10 + i * s:.1f}" width="{s:.1f}" height="{s:.1f}" fill="{shade(v)}"><title>{html.escape(a)}, {html.escape(b)}: {v:.3f}</title></rect>' for i, j, a, b, v in cells)
    return frame(body, title)


def schedule(tasks: list[tuple[str, float, float]], title: str) -> str:
    """(name, start, length) a task, in one unit."""
    low, high = min((t[1] for t in tasks), default=0.0), max((t[1] + t[2] for t in tasks), default=1.0)
    px = lambda x: PAD + (WIDTH - 2 * PAD) * ((x - low) / (high - low) if high > low else 0.0)
    step = (HEIGHT - 2 * PAD) / max(1, len(tasks))
    body = "".join(f'<rect x="{px(a):.1f}" y="{PAD + i * step:.1f}" width="{max(1.0, px(a + n) - px(a)):.1f}" height="{max(1.0, step - 2):.1f}" fill="{COLOURS[0]}"><title>{html.escape(str(name))}</title></rect>' for i, (name, a, n) in enumerate(tasks))
    return frame(body, title, (low, 0.0), (high, float(len(tasks))))


def solid(points: list[tuple[float, float, float]], title: str) -> str:
    """Points in three columns, seen from above at an angle; the third also shades."""
    if not points:
        return frame("", title)
    spans = [(min(c), max(c)) for c in zip(*points, strict=True)]
    unit = lambda v, k: (v - spans[k][0]) / (spans[k][1] - spans[k][0]) if spans[k][1] > spans[k][0] else 0.5
    turned = sorted(((unit(x, 0), unit(y, 1), unit(z, 2)) for x, y, z in points), key=lambda p: -p[1])
    at = [(PAD + (WIDTH - 2 * PAD) * (0.7 * x + 0.3 * y), HEIGHT - PAD - (HEIGHT - 2 * PAD) * (0.7 * z + 0.3 * y), z) for x, y, z in turned]
    return frame("".join(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="2" fill="rgb({int(60 + 150 * z)},90,{int(200 - 150 * z)})" fill-opacity=".6"/>' for x, y, z in at), title)


KINDS = {"scatter": scatter, "lines": lines, "bars": bars, "boxes": boxes, "pie": pie, "heatmap": heatmap, "schedule": schedule, "solid": solid}


def draw(kind: str, data, title: str, folder: str | Path) -> Path:
    """The file of a plot, drawn only if no file of the same content is there."""
    key = hashlib.sha256(json.dumps([kind, data, title], default=str, sort_keys=True).encode()).hexdigest()[:16]
    path = Path(folder) / f"{kind}-{key}.svg"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(KINDS[kind](data, title), encoding="utf-8")
    return path
