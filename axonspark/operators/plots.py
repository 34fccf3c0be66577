"""Drawing of plot data, where matplotlib is installed."""

from __future__ import annotations

import os
from collections import defaultdict

from pyspark.sql import DataFrame

from axonspark.operators import plotdata


def save(df: DataFrame, kind: str, output: str, formats: tuple[str, ...] = ("png",), title: str = "", log_x: bool = False, log_y: bool = False, width: float = 7.0, height: float = 5.0, dpi: int = 300, **columns: str) -> list[str]:
    """Draws ``df`` as one of ``plotdata.KINDS`` and writes one file per format; returns the paths.

    The rows that are drawn come from ``plotdata`` and are collected, since a
    figure holds them all.
    """
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise SystemExit("drawing needs matplotlib") from e
    fig, ax = plt.subplots(figsize=(width, height), dpi=dpi)
    rows = []
    if kind in ("scatter", "bubble", "line"):
        made = {"scatter": plotdata.points, "bubble": plotdata.bubbles, "line": plotdata.lines}[kind]
        groups = defaultdict(list)
        for r in made(df, **columns).collect():
            groups[r.color].append(r)
        for name, rows in sorted(groups.items()):
            rows = sorted(rows, key=lambda r: (r.x, r.y)) if kind == "line" else rows
            x, y = [r.x for r in rows], [r.y for r in rows]
            ax.plot(x, y, label=name) if kind == "line" else ax.scatter(x, y, s=[r.area for r in rows] if kind == "bubble" else None, label=name)
        if columns.get("color"):
            ax.legend()
    elif kind == "bar":
        rows = plotdata.bars(df, **columns).collect()
        ax.bar([r.label for r in rows], [r.height for r in rows])
    elif kind == "hist":
        rows = plotdata.histogram(df, **columns).collect()
        ax.bar([r.low for r in rows], [r["count"] for r in rows], width=[r.high - r.low for r in rows], align="edge")
    elif kind == "violin":
        groups = defaultdict(list)
        for r in plotdata.bars(df, **columns).collect():
            groups[r.label].append(r.height)
        ax.violinplot(list(groups.values()), showmedians=True)
        ax.set_xticks(range(1, len(groups) + 1), list(groups))
    elif kind == "heatmap":
        table = plotdata.heatmap_table(df, **columns)
        rows = table.collect()
        ax.imshow([[float("nan") if v is None else v for v in r[1:]] for r in rows], aspect="auto")
        ax.set_xticks(range(len(table.columns) - 1), table.columns[1:])
        ax.set_yticks(range(len(rows)), [r.y for r in rows])
    else:
        raise ValueError(f"no such plot: {kind}")
    ax.set(title=title, xlabel=columns.get("x", ""), ylabel=columns.get("y", ""))
    ax.set_xscale("log" if log_x else ax.get_xscale())
    ax.set_yscale("log" if log_y else ax.get_yscale())
    paths = [f"{os.path.splitext(output)[0]}.{f}" for f in formats]
    for p in paths:
        fig.savefig(p)
    plt.close(fig)
    return paths
