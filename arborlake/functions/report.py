"""Small reports on the driver: sorted importances, a row's explanation, and tables with the best in bold."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top(importance: DataFrame, n: int | None = None) -> list[tuple[str, float]]:
    """Features by falling importance."""
    ordered = importance.orderBy(F.desc("importance"), "feature").select("feature", "importance")
    return [tuple(r) for r in (ordered.limit(n) if n else ordered).collect()]


def explained(contributions: DataFrame, key: str, value) -> list[tuple[str, float]]:
    """A row's contributions, the strongest first."""
    some = contributions.filter(F.col(key) == value).orderBy(F.desc(F.abs("contribution")), "feature")
    return [(r["feature"], r["contribution"]) for r in some.select("feature", "contribution").collect()]


def html_table(header: list[str], rows: list[list], best: dict[str, str], digits: int = 3) -> str:
    """An HTML table; best maps a column to "min" or "max", and what is best after rounding is bold."""
    lines = ["<table>", "<tr>" + "".join(f"<th>{escape(h)}</th>" for h in header) + "</tr>"]
    shown = [[f"{v:.{digits}g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    wins = {}
    for name, way in best.items():
        i = header.index(name)
        known = [float(r[i]) for r in shown if r[i]]
        wins[i] = (min if way == "min" else max)(known) if known else None
    for r in shown:
        lines.append("<tr>" + "".join(f"<td><b>{escape(v)}</b></td>" if i in wins and v and float(v) == wins[i] else f"<td>{escape(v)}</td>" for i, v in enumerate(r)) + "</tr>")
    return "\n".join([*lines, "</table>"])
