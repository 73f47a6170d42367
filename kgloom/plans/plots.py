"""Plots of small tables as SVG: heatmaps of scores, and curves of distributions. They are made of counts of all rows, a few hundred at most."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

LIMIT = 10_000
COLOURS = ("#1b6ca8", "#c8553d", "#3a7d44", "#8e5ea2", "#b58900", "#444444")


def rows_of(df: DataFrame) -> list:
    rows = df.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows")
    return rows


def svg(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">' + "".join(parts) + "</svg>"


def text(x: float, y: float, what: str, anchor: str = "middle", colour: str = "#000") -> str:
    return f'<text x="{x:g}" y="{y:g}" text-anchor="{anchor}" fill="{colour}">{escape(what)}</text>'


def heatmap(df: DataFrame, row: str, title: str, low: float = 0.0, high: float = 1.0) -> str:
    """A matrix with two decimals in each cell; one column names the rows, the others are cells on a fixed scale."""
    columns, cells = [c for c in df.columns if c != row], sorted(rows_of(df), key=lambda r: str(r[row]))
    w, h, left, top = 64, 28, 180, 60
    parts = [text(left, 20, title, "start")] + [text(left + w * (k + 0.5), top - 8, c) for k, c in enumerate(columns)]
    for i, r in enumerate(cells):
        parts.append(text(left - 8, top + h * (i + 0.65), str(r[row]), "end"))
        for k, c in enumerate(columns):
            v = r[c]
            share = 0.0 if v is None else min(1.0, max(0.0, (v - low) / (high - low)))
            shade = "#eee" if v is None else f"rgb({round(247 - 220 * share)},{round(251 - 143 * share)},{round(255 - 87 * share)})"
            parts.append(f'<rect x="{left + w * k}" y="{top + h * i}" width="{w}" height="{h}" fill="{shade}"/>')
            if v is not None:
                parts.append(text(left + w * (k + 0.5), top + h * (i + 0.65), f"{v:.2f}", colour="#fff" if share > 0.6 else "#000"))
    return svg(left + w * len(columns) + 20, top + h * len(cells) + 20, parts)


def curves(df: DataFrame, group: str, x: str, y: str, title: str, steps: bool = False) -> str:
    """One line a group over common axes: a density (by the interval's lower edge) or, with ``steps``, an ECDF."""
    by: dict[str, list[tuple[float, float]]] = {}
    for r in rows_of(df.select(group, x, y)):
        by.setdefault(str(r[group]), []).append((float(r[x]), float(r[y])))
    every = [p for ps in by.values() for p in ps] or [(0.0, 0.0)]
    x0, x1, y1 = min(p[0] for p in every), max(p[0] for p in every), max(p[1] for p in every)
    w, h, left, top = 560, 300, 60, 40
    at = lambda px, py: (left + w * (px - x0) / ((x1 - x0) or 1), top + h * (1 - py / (y1 or 1)))
    parts = [text(left, 20, title, "start"), f'<path d="M{left} {top}V{top + h}H{left + w}" fill="none" stroke="#000"/>', text(left, top + h + 16, f"{x0:g}"), text(left + w, top + h + 16, f"{x1:g}"), text(left - 6, top + 4, f"{y1:.4g}", "end")]
    for k, (name, points) in enumerate(sorted(by.items())):
        path = "M"
        for i, p in enumerate(sorted(points)):
            px, py = at(*p)
            path += f"{px:.1f} {py:.1f}" if not i else f"H{px:.1f}V{py:.1f}" if steps else f"L{px:.1f} {py:.1f}"
        colour = COLOURS[k % len(COLOURS)]
        parts += [f'<path d="{path}" fill="none" stroke="{colour}"/>', text(left + w + 10, top + 16 * (k + 1), name, "start", colour)]
    return svg(left + w + 140, top + h + 40, parts)
