"""Reports: sorted ASCII JSON, or tables of text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any


def as_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True, default=str)


def _cell(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.4f}"
    text = "-" if value is None else str(value)
    return " ".join("".join(c if c.isprintable() else " " for c in text).split())


def table(rows: Iterable[Mapping[str, Any]], width: int = 60) -> str:
    """One line a row under its column names; long cells end in an ellipsis."""
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *([_cell(r.get(n)) for n in names] for r in rows)]
    cells = [[c if len(c) <= width else c[: width - 1] + "…" for c in row] for row in cells]
    widths = [max(len(row[k]) for row in cells) for k in range(len(names))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]]) if names else "(nothing)"


def render(value: object) -> str:
    """A value of the command as text: mappings as pairs, those inside them as sections, lists of mappings as tables."""
    if isinstance(value, list):
        return table(value)
    if not isinstance(value, Mapping):
        return _cell(value)
    flat = {k: v for k, v in value.items() if not isinstance(v, (Mapping, list))}
    parts = [table({"field": k, "value": v} for k, v in flat.items())] if flat else []
    for k, v in value.items():
        if isinstance(v, Mapping):
            parts.append(f"{k}\n{render(v)}")
        elif isinstance(v, list):
            parts.append(f"{k}\n{table(v) if v and isinstance(v[0], Mapping) else ', '.join(map(_cell, v)) or '(none)'}")
    return "\n\n".join(parts)
