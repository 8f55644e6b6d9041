from . import build, retrieve

__all__ = ["build", "retrieve"]
