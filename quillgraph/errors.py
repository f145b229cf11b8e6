"""Error classes of the facade, each with the code that interfaces report."""

from __future__ import annotations


class QuillgraphError(Exception):
    """Base class; ``code`` is the interface's error number."""

    code = -32603


class DocumentNotFoundError(QuillgraphError):
    code = -32001

    def __init__(self, name: str):
        super().__init__(f"no document has the path or id {name!r}")


class InvalidInputError(QuillgraphError):
    code = -32602


class IndexNotReadyError(QuillgraphError):
    code = -32002


class DimensionMismatchError(QuillgraphError):
    code = -32003

    def __init__(self, expected: int, got: int):
        super().__init__(f"vectors have {expected} dimensions, this one has {got}")


class ConcurrentWriteError(QuillgraphError):
    """Another writer changed the tables meanwhile; nothing was written over."""


class PathTraversalError(InvalidInputError):
    def __init__(self, path: str):
        super().__init__(f"path leaves its base: {path!r}")


class ConfigNotFoundError(QuillgraphError):
    pass
