"""K7-K9: small results as text, Markdown and HTML. Rendering is the driver's; what is rendered is an aggregate's rows."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows a report may have; larger results are exported, not rendered.
MOST = 10_000


def _rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"over {MOST} rows: export this result instead")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return df.columns, [[show(v) for v in r] for r in got]


def text_table(df: DataFrame, title: str = "") -> str:
    head, rows = _rows(df)
    width = [max(map(len, c)) for c in zip(head, *rows, strict=True)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([*([title, "=" * len(title)] if title else []), line(head), "  ".join("-" * w for w in width), *map(line, rows)]) + "\n"


def markdown_table(df: DataFrame) -> str:
    head, rows = _rows(df)
    line = lambda r: "| " + " | ".join(v.replace("|", "\\|").replace("\n", " ") for v in r) + " |"
    return "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)]) + "\n"


def html_table(df: DataFrame, title: str = "") -> str:
    head, rows = _rows(df)
    cell = lambda kind, r: "<tr>" + "".join(f"<{kind}>{html.escape(v)}</{kind}>" for v in r) + "</tr>"
    return f"<h1>{html.escape(title)}</h1>\n<table>\n" + "\n".join([cell("th", head), *(cell("td", r) for r in rows)]) + "\n</table>\n"
