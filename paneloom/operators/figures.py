"""Figures of small, finished frames, where matplotlib is there; the frames themselves are what the queries return."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 5_000


def _axes(df: DataFrame):
    try:
        import matplotlib
    except ImportError as e:
        raise RuntimeError("figures need matplotlib") from e
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a figure shows at most {MOST_ROWS} rows; aggregate first")
    return plt, df.toPandas()


def _save(plt, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    plt.tight_layout()
    plt.savefig(path, dpi=300)
    plt.close()
    return path


def lines(df: DataFrame, x: str, ys: Sequence[str], path: str | Path) -> Path:
    plt, pdf = _axes(df)
    pdf.sort_values(x).plot(x=x, y=list(ys), marker="o")
    return _save(plt, path)


def bars(df: DataFrame, x: str, ys: Sequence[str], path: str | Path, stacked: bool = False, horizontal: bool = False) -> Path:
    plt, pdf = _axes(df)
    pdf.plot(x=x, y=list(ys), kind="barh" if horizontal else "bar", stacked=stacked)
    return _save(plt, path)


def heatmap(df: DataFrame, row: str, columns: Sequence[str], path: str | Path) -> Path:
    plt, pdf = _axes(df)
    values = pdf.set_index(row)[list(columns)]
    plt.imshow(values.to_numpy(dtype=float), aspect="auto")
    plt.xticks(range(len(columns)), list(columns), rotation=90)
    plt.yticks(range(len(values)), list(values.index))
    plt.colorbar()
    return _save(plt, path)


def scatter(df: DataFrame, x: str, y: str, path: str | Path) -> Path:
    plt, pdf = _axes(df)
    pdf.plot(x=x, y=y, kind="scatter")
    return _save(plt, path)
