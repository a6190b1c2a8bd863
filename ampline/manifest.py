"""Digests of files and folders, to tell whether inputs and results are the ones recorded."""

from __future__ import annotations

import hashlib
from pathlib import Path


def digest(path: str | Path) -> str:
    """SHA-256 of a file's bytes; of a folder, of its files' relative paths and digests in order of path."""
    path = Path(path)
    if path.is_file():
        with path.open("rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    total = hashlib.sha256()
    for name, file in sorted((p.relative_to(path).as_posix(), p) for p in path.rglob("*") if p.is_file()):
        total.update(f"{digest(file)}  {name}\n".encode())
    return total.hexdigest()


def compute(paths: list[str]) -> dict[str, str]:
    return {p: digest(p) for p in sorted(paths)}


def differences(recorded: dict[str, str]) -> list[str]:
    """One line for each recorded path that is gone or has another digest."""
    out = []
    for path, want in sorted(recorded.items()):
        if not Path(path).exists():
            out.append(f"{path}: missing")
        elif digest(path) != want:
            out.append(f"{path}: changed")
    return out
