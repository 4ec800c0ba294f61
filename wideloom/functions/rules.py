"""Rule rows: named conditions over a one-row metrics frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    code: str
    fires: Column
    value: Column


def fired(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(kind, code, value)`` for every rule whose condition holds, in rule order."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(r.kind).alias("kind"), F.lit(r.code).alias("code"),
            r.value.cast("double").alias("value"), F.coalesce(r.fires, F.lit(False)).alias("fires"),
        )
        for i, r in enumerate(rules)
    ]
    return (
        metrics.select(F.inline(F.array(*rows)))
        .where("fires")
        .select("ordinal", "kind", "code", "value")
    )
