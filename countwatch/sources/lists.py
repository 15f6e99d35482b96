"""Small hand-written inputs parsed on the driver: token sections and revision lists (A10)."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from countwatch.functions.text import TokenLists


def token_sections(body: str) -> dict[str, list[str]]:
    """``[section]`` headers followed by one token a line; blank lines and # comments are skipped."""
    sections: dict[str, list[str]] = {}
    current: list[str] | None = None
    for raw in body.splitlines():
        line = raw.strip()
        header = re.fullmatch(r"\[(\w+)\]", line)
        if header:
            current = sections.setdefault(header.group(1), [])
        elif line and not line.startswith("#") and current is not None:
            current.append(line)
    return sections


def read_tokens(path: str) -> TokenLists:
    """Fails when the list is absent: without it nothing may be counted."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"the exclusion list {path} is absent")
    return TokenLists.from_sections(token_sections(file.read_text(encoding="utf-8")))


def read_revisions(path: str) -> list[dict]:
    """Entries of a TOML revision list; a missing file is an error, an empty one is valid."""
    with open(path, "rb") as handle:
        return list(tomllib.load(handle).get("revision") or [])
