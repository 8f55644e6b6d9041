"""Text normalisation as one native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which characters are unified, and into what.
DELETED = (
    "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f"
    "\u0011\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
    "­"
)
TO_SPACE = "\u000b\u000c\u0085"
TO_HYPHEN = "‐‑‒–—―⁃⁻−－"
TO_DOUBLE_QUOTE = "“”„‟"
TO_SINGLE_QUOTE = "`´՚‘’‚‛′‵Ꞌꞌ＇"
TO_SLASH = "⁄∕"
TO_SEVERAL = {
    "″": "''",
    "‶": "''",
    "‴": "'''",
    "‷": "'''",
    "⁗": "''''",
    "…": "...",
}
SPACED_DOTS = (" . . . ", " ... ")


def translate_pairs() -> tuple[str, str]:
    """Source and target strings for ``translate``; sources without a target are deleted."""
    groups = [
        (TO_SPACE, " "),
        (TO_HYPHEN, "-"),
        (TO_DOUBLE_QUOTE, '"'),
        (TO_SINGLE_QUOTE, "'"),
        (TO_SLASH, "/"),
    ]
    sources = "".join(chars for chars, _ in groups)
    targets = "".join(target * len(chars) for chars, target in groups)
    return sources + DELETED, targets


def normalize(column: Column | str) -> Column:
    """Unify dashes, quotes, primes, slashes and ellipses to ASCII and drop control characters."""
    sources, targets = translate_pairs()
    out = F.translate(column, sources, targets)
    for char, replacement in TO_SEVERAL.items():
        out = F.replace(out, F.lit(char), F.lit(replacement))
    return F.replace(out, F.lit(SPACED_DOTS[0]), F.lit(SPACED_DOTS[1]))
