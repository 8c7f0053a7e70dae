"""Scorers registered by name and dealt by a table of configurations.

A strategy turns columns into a score; registering it makes it known to `run`, which applies every configured one to every
row in a single pass. A configuration is a row (strategy, threshold, margin, inverted): the same strategy may be configured
often, and what is configured can be changed without code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import decide


@dataclass(frozen=True)
class Strategy:
    name: str
    needs: tuple[str, ...]  # columns that it reads
    score: Callable[..., Column]
    cost: float = 0.0  # of a decision


class Strategies:
    """Strategies by name."""

    def __init__(self) -> None:
        self.known: dict[str, Strategy] = {}

    def register(self, name: str, *needs: str, cost: float = 0.0):
        """Decorates a function from the columns `needs` to a score. A name is given once."""

        def add(f: Callable[..., Column]) -> Callable[..., Column]:
            if name in self.known:
                raise ValueError(f"strategy {name} is registered already")
            self.known[name] = Strategy(name, needs, f, cost)
            return f

        return add

    def run(self, rows: DataFrame, configurations: DataFrame, most: int = 1000) -> DataFrame:
        """rows' columns with config, strategy, score, decision and cost, a row for each configuration.

        configurations: (config, strategy, threshold, margin, inverted). They are parameters, so they are read at once; more
        than `most`, an unknown strategy or a missing column is refused.
        """
        given = configurations.select("config", "strategy", "threshold", "margin", "inverted").limit(most + 1).collect()
        if len(given) > most:
            raise ValueError(f"more than {most} configurations")
        if unknown := sorted({c.strategy for c in given} - self.known.keys()):
            raise ValueError(f"unknown strategies: {unknown}")
        used = [self.known[n] for n in sorted({c.strategy for c in given})]
        if missing := sorted({c for s in used for c in s.needs} - set(rows.columns)):
            raise ValueError(f"missing columns: {missing}")
        scored = rows.select("*", *(s.score(*(F.col(c) for c in s.needs)).cast("double").alias(f"__{s.name}") for s in used))

        def dealt(c) -> Column:
            own, threshold = F.col(f"__{c.strategy}"), F.lit(c.threshold)
            return F.struct(
                F.lit(c.config).alias("config"), F.lit(c.strategy).alias("strategy"), own.alias("score"),
                decide(own, threshold, c.margin, bool(c.inverted)).alias("decision"), F.lit(self.known[c.strategy].cost).alias("cost"),
            )

        if not given:
            kind = "struct<config:string,strategy:string,score:double,decision:string,cost:double>"
            return rows.withColumn("__x", F.lit(None).cast(kind)).filter("false").select(*rows.columns, "__x.*")
        return scored.withColumn("__x", F.explode(F.array(*map(dealt, given)))).select(*rows.columns, "__x.*")
