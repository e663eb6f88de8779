"""Decision records of a project and text forms of results."""

from __future__ import annotations

import json
import re

#: The sections of a record, in order.
SECTIONS = ["PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY"]
MAX_CHARS = 8000


def parse_record(text: str) -> dict[str, str]:
    """Sections by their headings (## NAME), in order; other headings belong to the section they stand in."""
    out, name = {}, None
    for line in text.splitlines():
        m = re.match(r"^##\s+([A-Z]+)\s*$", line)
        if m and m[1] in SECTIONS:
            name = m[1]
            out[name] = ""
        elif name:
            out[name] += line + "\n"
    return {k: v.strip() for k, v in out.items()}


def render_record(sections: dict[str, str]) -> str:
    """The canonical text; raises if it would be too long or a section is unknown."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    text = "\n\n".join(f"## {k}\n{sections[k].strip()}" for k in SECTIONS if k in sections)
    if len(text) > MAX_CHARS:
        raise ValueError(f"{len(text)} characters; {MAX_CHARS} are allowed")
    return text


def to_json(columns: list[str], rows: list) -> str:
    return json.dumps([dict(zip(columns, r)) for r in rows], default=str)


def to_table_text(name: str, columns: list[str], rows: list) -> str:
    """A compact form: a head with the count and columns, then a line for each row."""
    cell = lambda v: "" if v is None else json.dumps(v) if isinstance(v, str) and re.search(r'[,"\n]', v) else str(v)
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(map(cell, r)) for r in rows)])
