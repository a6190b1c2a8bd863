"""Scratch folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

_own: dict[str, str] = {}


def scratch(spark) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ampline-stream-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]
