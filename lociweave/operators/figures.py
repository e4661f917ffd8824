"""Grouped bar charts with error bars, as SVG text."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd

#: One colour for each series, which repeat.
COLOURS = ("#4c6a92", "#c17c3a", "#5f8f5a", "#a65a6a", "#7d6ca8", "#6f6f6f")


def bar_chart(rows: pd.DataFrame, group: str, series: str, value: str, deviation: str | None, title: str, width: int = 860, height: int = 420) -> str:
    """A bar for each series in each group from zero, with a line of one deviation either way. Values that are missing have no bar."""
    groups, names = sorted(rows[group].unique()), sorted(rows[series].unique())
    left, right, top, bottom = 60, 150, 40, 70
    inner, tall = width - left - right, height - top - bottom
    spread = rows[deviation].fillna(0) if deviation else 0
    most = max(1e-9, float((rows[value].fillna(0) + spread).max()))
    most = 1.0 if 0.5 < most <= 1 else most * 1.05
    y = lambda v: top + tall * (1 - max(0.0, min(v, most)) / most)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="{left}" y="22" font-size="15">{escape(title)}</text>']
    for k in range(5):
        v = most * k / 4
        out.append(f'<line x1="{left}" x2="{left + inner}" y1="{y(v):.1f}" y2="{y(v):.1f}" stroke="#ddd"/><text x="{left - 8}" y="{y(v) + 4:.1f}" text-anchor="end">{v:.2f}</text>')
    step = inner / max(1, len(groups))
    bar = step * 0.8 / max(1, len(names))
    for i, g in enumerate(groups):
        out.append(f'<text x="{left + step * (i + 0.5):.1f}" y="{top + tall + 20}" text-anchor="middle">{escape(str(g))}</text>')
        for j, n in enumerate(names):
            own = rows[(rows[group] == g) & (rows[series] == n)]
            if own.empty or pd.isna(own[value].iloc[0]):
                continue
            v, x = float(own[value].iloc[0]), left + step * (i + 0.1) + bar * j
            out.append(f'<rect x="{x:.1f}" y="{y(v):.1f}" width="{bar * 0.92:.1f}" height="{top + tall - y(v):.1f}" fill="{COLOURS[j % len(COLOURS)]}"><title>{escape(f"{g} {n}: {v:.4f}")}</title></rect>')
            if deviation and not pd.isna(own[deviation].iloc[0]):
                s, m = float(own[deviation].iloc[0]), x + bar * 0.46
                out.append(f'<line x1="{m:.1f}" x2="{m:.1f}" y1="{y(v - s):.1f}" y2="{y(v + s):.1f}" stroke="#222"/>')
    for j, n in enumerate(names):
        out.append(f'<rect x="{left + inner + 14}" y="{top + 20 * j}" width="12" height="12" fill="{COLOURS[j % len(COLOURS)]}"/><text x="{left + inner + 32}" y="{top + 20 * j + 11}">{escape(str(n))}</text>')
    return "\n".join([*out, "</svg>", ""])
