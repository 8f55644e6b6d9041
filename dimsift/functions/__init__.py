from . import arrays, text

__all__ = ["arrays", "text"]
