from . import collections, feedback, results, runs, vectors

__all__ = ["collections", "feedback", "results", "runs", "vectors"]
