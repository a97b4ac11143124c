"""One HTML report from small result tables; everything that comes from data is escaped."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of a table that are printed; the tables themselves are written in full as Parquet.
SHOWN_ROWS = 200


class Report:
    """Append-only body of titles, paragraphs, tables and charts."""

    def __init__(self, title: str):
        self.title, self.parts = title, []

    def heading(self, text: str, level: int = 2) -> "Report":
        self.parts.append(f"<h{level}>{html.escape(text)}</h{level}>")
        return self

    def paragraph(self, text: str) -> "Report":
        self.parts.append(f"<p>{html.escape(text)}</p>")
        return self

    def table(self, df: DataFrame, rows: int = SHOWN_ROWS) -> "Report":
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        found = df.limit(rows + 1).collect()
        body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in found[:rows])
        more = f"<p>First {rows} rows.</p>" if len(found) > rows else ""
        self.parts.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>{more}")
        return self

    def bars(self, points: list[tuple[str, float]], caption: str = "") -> "Report":
        """A bar chart as inline SVG."""
        top = max((v for _, v in points), default=0.0) or 1.0
        w = 640 / max(1, len(points))
        bars = "".join(f'<rect x="{i * w:.1f}" y="{160 - 150 * v / top:.1f}" width="{max(1.0, w - 1):.1f}" height="{150 * v / top:.1f}"><title>{html.escape(n)}: {v:g}</title></rect>' for i, (n, v) in enumerate(points))
        self.parts.append(f'<figure><svg viewBox="0 0 640 160" role="img">{bars}</svg><figcaption>{html.escape(caption)}</figcaption></figure>')
        return self

    def heatmap(self, names: list[str], matrix: list[list[float]], caption: str = "") -> "Report":
        n = max(1, len(names))
        s = 480 / n
        cells = "".join(f'<rect x="{j * s:.1f}" y="{i * s:.1f}" width="{s:.1f}" height="{s:.1f}" fill="rgb({int(255 - 200 * max(0, -v))},{int(255 - 200 * abs(v))},{int(255 - 200 * max(0, v))})"><title>{html.escape(a)}, {html.escape(b)}: {v:.3f}</title></rect>' for i, (a, row) in enumerate(zip(names, matrix, strict=True)) for j, (b, v) in enumerate(zip(names, row, strict=True)))
        self.parts.append(f'<figure><svg viewBox="0 0 480 480" role="img">{cells}</svg><figcaption>{html.escape(caption)}</figcaption></figure>')
        return self

    def image(self, path: str | Path, caption: str = "") -> "Report":
        """A drawn file, inside the page."""
        self.parts.append(f"<figure>{Path(path).read_text(encoding='utf-8')}<figcaption>{html.escape(caption)}</figcaption></figure>")
        return self

    def html(self) -> str:
        style = "body{font:15px/1.5 system-ui;max-width:70rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.2rem .5rem;text-align:left}svg{max-width:40rem}rect{fill:#48a}"
        return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(self.title)}</title><style>{style}</style></head><body><h1>{html.escape(self.title)}</h1>{"".join(self.parts)}</body></html>'

    def save(self, path: str | Path) -> Path:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(self.html(), encoding="utf-8")
        return target


def cell(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, float):
        return "n/a" if v != v or v in (float("inf"), float("-inf")) else f"{v:.4g}"
    return str(v)


def graph_page(edges: list[tuple[str, str, float]], path: str | Path) -> Path:
    """A page that lists and edits a causal graph; data enter as escaped JSON."""
    data = json.dumps([{"from": a, "to": b, "confidence": c} for a, b, c in edges]).replace("<", "\\u003c")
    page = f"""<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Graph editor</title></head><body><h1>Graph editor</h1><ul id="edges"></ul>
<label>From <input id="a"></label> <label>To <input id="b"></label> <button id="add">Add</button><pre id="out"></pre><script>
const edges = {data}; const list = document.getElementById("edges");
function show() {{ list.replaceChildren(...edges.map((e, i) => {{ const li = document.createElement("li"); li.textContent = e.from + " \\u2192 " + e.to + " (" + e.confidence.toFixed(2) + ") ";
 const b = document.createElement("button"); b.textContent = "Remove"; b.onclick = () => {{ edges.splice(i, 1); show(); }}; li.append(b); return li; }})); document.getElementById("out").textContent = JSON.stringify(edges, null, 1); }}
document.getElementById("add").onclick = () => {{ edges.push({{from: document.getElementById("a").value, to: document.getElementById("b").value, confidence: 1}}); show(); }}; show();
</script></body></html>"""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(page, encoding="utf-8")
    return target
