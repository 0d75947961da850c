"""Report sinks: JSON, aligned text and Markdown of at most a stated number of rows, in a stated order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame

#: Rows that a rendered report shows unless it is told otherwise; whole results go to files by to_json_files.
ROWS = 40


def _shown(df: DataFrame, order: list[Column | str], rows: int) -> tuple[list[str], list[list], bool]:
    got = df.orderBy(*order).limit(rows + 1).collect()
    return df.columns, [list(r) for r in got[:rows]], len(got) > rows


def _cell(x) -> str:
    return "" if x is None else ", ".join(map(_cell, x)) if isinstance(x, list) else str(x)


def to_json(df: DataFrame, order: list[Column | str], rows: int = ROWS) -> str:
    got = df.orderBy(*order).limit(rows).toJSON().collect()
    return json.dumps([json.loads(r) for r in got], indent=2, ensure_ascii=False)


def to_json_files(df: DataFrame, path: str) -> None:
    """All rows, written by the tasks that hold them."""
    df.write.mode("overwrite").json(path)


def to_text(df: DataFrame, order: list[Column | str], rows: int = ROWS) -> str:
    names, got, more = _shown(df, order, rows)
    lines = [[n.upper() for n in names], *([_cell(x) for x in r] for r in got)]
    width = [max(len(r[i]) for r in lines) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in lines) + ("\n..." if more else "")


def to_markdown(df: DataFrame, order: list[Column | str], rows: int = ROWS) -> str:
    names, got, more = _shown(df, order, rows)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    out = [line(names), "|" + "-|" * len(names), *(line([_cell(x) for x in r]) for r in got)]
    return "\n".join(out) + ("\n\nMore rows are not shown." if more else "")
