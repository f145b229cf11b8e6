"""Logging to the standard error stream and, on request, to a file."""

from __future__ import annotations

import logging
import sys

NAME = "quillgraph"


def configure(level: str = "INFO", file: str | None = None) -> None:
    """Sets level and destinations anew; the file is appended to."""
    close()
    root = logging.getLogger(NAME)
    root.setLevel(level.upper())
    root.propagate = False
    for handler in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)


def logger(part: str) -> logging.Logger:
    return logging.getLogger(f"{NAME}.{part}")


def close() -> None:
    root = logging.getLogger(NAME)
    for handler in list(root.handlers):
        root.removeHandler(handler)
        handler.close()
