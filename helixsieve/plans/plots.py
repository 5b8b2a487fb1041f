"""Plots of report rows as SVG text: good qualities, base composition, and boxes of qualities by position."""

from __future__ import annotations

from collections.abc import Sequence

WIDTH, HEIGHT, EDGE = 800, 240, 40
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#7f7f7f")


def _panels(rows: Sequence, draw) -> str:
    """One panel below another, for each stage and mate."""
    keys = sorted({(r["stage"], r["mate"]) for r in rows}, key=lambda k: (k[0] != "raw", k))
    parts = []
    for i, key in enumerate(keys):
        own = [r for r in rows if (r["stage"], r["mate"]) == key]
        most = max(r["pos"] for r in own)
        x = lambda pos, most=most: EDGE + (WIDTH - 2 * EDGE) * (pos - 0.5) / most
        parts.append(f'<g transform="translate(0,{i * HEIGHT})"><text x="{EDGE}" y="16" font-size="12">{key[0]}, mate {key[1]}</text><rect x="{EDGE}" y="20" width="{WIDTH - 2 * EDGE}" height="{HEIGHT - 60}" fill="none" stroke="#999"/>{draw(own, x)}<text x="{EDGE}" y="{HEIGHT - 24}" font-size="10">1</text><text x="{WIDTH - EDGE}" y="{HEIGHT - 24}" font-size="10" text-anchor="end">{most}</text></g>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT * max(1, len(keys))}">{"".join(parts)}</svg>'


def _y(value: float, top: float) -> float:
    return 20 + (HEIGHT - 60) * (1 - value / top)


def _lines(rows: Sequence, names: Sequence[str]) -> str:
    def draw(own, x) -> str:
        out = []
        for i, (name, colour) in enumerate(zip(names, COLOURS, strict=False)):
            points = " ".join(f"{x(r['pos']):.1f},{_y(r[name] or 0, 100):.1f}" for r in own)
            out.append(f'<polyline points="{points}" fill="none" stroke="{colour}"/><text x="{WIDTH - EDGE + 4}" y="{30 + 12 * i}" font-size="9" fill="{colour}">{name.removesuffix("_pct").upper()}</text>')
        return "".join(out)

    return _panels(rows, draw)


def good_qualities(rows: Sequence) -> str:
    return _lines(rows, ("q20_pct", "q30_pct"))


def base_composition(rows: Sequence) -> str:
    return _lines(rows, ("a_pct", "c_pct", "g_pct", "t_pct", "n_pct"))


def quality_boxes(rows: Sequence) -> str:
    top = max([1, *(r["p90"] for r in rows)])

    def draw(own, x) -> str:
        half = max(0.5, (WIDTH - 2 * EDGE) / max(r["pos"] for r in own) * 0.35)
        line = lambda a, b, c, d: f'<line x1="{a:.1f}" y1="{_y(b, top):.1f}" x2="{c:.1f}" y2="{_y(d, top):.1f}" stroke="#333"/>'
        return "".join(
            line(x(r["pos"]), r["p10"], x(r["pos"]), r["p90"])
            + f'<rect x="{x(r["pos"]) - half:.1f}" y="{_y(r["upper"], top):.1f}" width="{2 * half:.1f}" height="{max(0.5, _y(r["lower"], top) - _y(r["upper"], top)):.1f}" fill="#9ecae1"/>'
            + line(x(r["pos"]) - half, r["median"], x(r["pos"]) + half, r["median"])
            for r in own
        )

    return _panels(rows, draw)


DRAWN = {"good": good_qualities, "base": base_composition, "quality": quality_boxes}
