"""How results are shown: sizes, money, links, tables."""

from __future__ import annotations

import html
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size(n: Column) -> Column:
    """Bytes in the largest decimal unit of one or more."""
    out = F.concat(F.format_number(n, 0), F.lit(" B"))
    for unit, x in (("kB", 1e3), ("MB", 1e6), ("GB", 1e9), ("TB", 1e12)):
        out = F.when(n >= x, F.concat(F.format_number(n / x, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def money(v: Column) -> Column:
    """Dollars in the largest scale of one or more."""
    a = F.abs(v)
    out = F.format_number(a, 2)
    for unit, x in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        out = F.when(a >= x, F.concat(F.format_number(a / x, 1), F.lit(unit))).otherwise(out)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), out)


def escape(text: str) -> str:
    return html.escape(text, quote=True)


def fragment_link(url: str, passage: str, words: int = 6) -> str:
    """A link that opens a page at a passage: its first words, and its last where it is longer."""
    w = passage.split()
    first, last = " ".join(w[:words]), " ".join(w[-words:])
    return f"{url}#:~:text={quote(first, safe='')}" + (f",{quote(last, safe='')}" if len(w) > 2 * words else "")


def report(title: str, parts: dict[str, DataFrame], notes: tuple[str, ...] = (), limit: int = 200) -> str:
    """A page of tables under headings (a corpus, a scorecard, a ladder or a gate), notes last; empty tables say so."""
    lines = [f"# {title}", ""]
    for name, df in parts.items():
        lines += [f"## {name}", "", markdown(df, limit) if not df.isEmpty() else "Nothing to show.\n"]
    return "\n".join(lines + [f"- {n}" for n in notes]).rstrip("\n") + "\n"


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small table as Markdown, in its order."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"
