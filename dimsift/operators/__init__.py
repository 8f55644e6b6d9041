from . import encode, evaluate, importance, numbering, report, search, select, tune, vectors

__all__ = [
    "encode", "evaluate", "importance", "numbering", "report", "search", "select", "tune", "vectors",
]
