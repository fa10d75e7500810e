"""Settings from the environment and a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from pathlib import Path


def settings(path: str | None = None, environ: dict[str, str] | None = None) -> dict[str, str]:
    """The environment, with names from the file added where it lacks them.

    Blank lines, lines that begin with ``#`` and lines without ``=`` are
    skipped; quotes around a value go; a file that isn't there adds nothing.
    """
    found = dict(os.environ if environ is None else environ)
    file = Path(path) if path else None
    for line in file.read_text(encoding="utf-8").splitlines() if file and file.is_file() else ():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        name, value = (x.strip() for x in line.split("=", 1))
        found.setdefault(name, value.strip("\"'"))
    return found
