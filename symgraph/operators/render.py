"""Answers as JSON and as Markdown, cut to a budget of items. Only what is shown comes to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Items that an answer of each profile may have.
BUDGETS = {"minimal": 10, "standard": 50, "full": 500}
MOST_CHARACTERS = 90_000


def shown(rows: DataFrame, profile: str = "standard") -> tuple[list[dict], bool]:
    """The first rows that the profile allows, and whether there are more."""
    n = BUDGETS[profile]
    first = rows.limit(n + 1).collect()  # the budget and one more
    return [r.asDict(recursive=True) for r in first[:n]], len(first) > n


def as_json(title: str, rows: DataFrame, profile: str = "standard") -> str:
    items, more = shown(rows, profile)
    return json.dumps({"title": title, "items": items, "truncated": more}, default=str, ensure_ascii=False)


def as_markdown(title: str, rows: DataFrame, profile: str = "standard") -> str:
    """A heading and a table; cells lose line ends and bars."""
    items, more = shown(rows, profile)
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(item[c]) for c in rows.columns) + " |" for item in items]
    return capped("\n".join([*lines, *(["", "More were found than are shown."] if more else [])]))


def sections_markdown(title: str, sections: DataFrame, section: str = "section", value: str = "value", profile: str = "standard") -> str:
    """One list for each section of rows (section, value), in order; the budget is shared by all."""
    items, more = shown(sections.orderBy(section, value), profile)
    lines, last = [f"# {title}"], None
    for item in items:
        if item[section] != last:
            lines += ["", f"## {item[section]}", ""]
            last = item[section]
        lines.append(f"- {item[value]}")
    return capped("\n".join([*lines, *(["", "More were found than are shown."] if more else [])]))


def capped(text: str, most: int = MOST_CHARACTERS) -> str:
    return text if len(text) <= most else text[:most] + "\n... (cut)"
