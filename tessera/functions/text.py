"""Text column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import GPT2_PATTERN


def pretokenize(text: Column | str, pattern: str = GPT2_PATTERN) -> Column:
    """Split text into pre-tokens with the GPT-2 pattern (all matches, in order)."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
