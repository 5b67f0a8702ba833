"""BM25 as expressions and as plain functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    """``k1`` below 0 counts as 0, ``b`` is held between 0 and 1; neither may be infinite or NaN."""

    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if not (math.isfinite(self.k1) and math.isfinite(self.b)):
            raise ValueError("k1 and b must be finite")
        object.__setattr__(self, "k1", max(0.0, self.k1))
        object.__setattr__(self, "b", min(1.0, max(0.0, self.b)))

    @staticmethod
    def idf(df: float, n: float) -> float:
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(self, tf: float, length: float, average: float, idf: float) -> float:
        if tf == 0 or average <= 0:
            return 0.0
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / average))

    @staticmethod
    def idf_expr(df: Column, n: Column) -> Column:
        return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))

    def score_expr(self, tf: Column, length: Column, average: Column, idf: Column) -> Column:
        norm = F.lit(1 - self.b) + F.lit(self.b) * length / average
        value = idf * tf * F.lit(self.k1 + 1) / (tf + F.lit(self.k1) * norm)
        return F.when((tf == 0) | (average <= 0), F.lit(0.0)).otherwise(value)
