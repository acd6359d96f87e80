"""A varied choice of records for each owner: greedy by score, under caps.

Scores of different metrics are put on one scale (the share of the owner's best of the
metric).  First the best candidate of each narrative is taken, then all candidates by score;
one is passed over if its category or its entity has its cap of records, or its metric has
one.  If fewer than ``least`` are chosen, a second pass allows more of a category.

What a pass takes depends on what was taken before, so an owner's candidates are visited in
order, one owner after another in a task.  Candidates are dealt by owner once.  They are cut down first, without a change of the result: of
one category, metric and entity only the best can be taken; of one category and metric
at most as many are passed over for their entity as entities can be full.  So a task holds a
bounded number of rows of an owner for each metric, however many candidates there are.

Candidates without an owner, a metric or a score take no part; a null entity has no cap.
Ties go by category, metric and candidate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Caps:
    most: int = 8
    least: int = 4
    category: int = 2
    relaxed: int = 3
    entity: int = 1


def scaled(candidates: DataFrame, tasks: int | None = None) -> DataFrame:
    """Candidates that take part, dealt by owner, with ``scaled``, the share of the owner's best score of the metric."""
    sound = candidates.where("owner is not null and metric is not null and score is not null")
    sound = sound.repartition(tasks, "owner") if tasks else sound.repartition("owner")
    best = F.max(F.abs("score")).over(Window.partitionBy("owner", "metric"))
    return sound.withColumn("_best", best).withColumn("scaled", F.when(F.col("_best") > 0, F.round(F.col("score") / F.col("_best"), 9)).otherwise(F.lit(0.0))).drop("_best")


def _order() -> list:
    return [F.desc("scaled"), F.asc_nulls_last("category"), F.asc_nulls_last("metric"), F.asc_nulls_last("candidate")]


def eligible(rows: DataFrame, caps: Caps) -> DataFrame:
    """The rows that a pass can take, and the first of each narrative (``leads``)."""
    place = lambda *by: F.row_number().over(Window.partitionBy("owner", *by).orderBy(*_order()))
    led = rows.withColumn("leads", place("narrative") == 1).withColumn("_same", place("category", "metric", "entity"))
    kept = led.where("_same = 1 or leads")
    return kept.withColumn("_place", place("category", "metric")).where((F.col("_place") <= caps.most // caps.entity + 2) | F.col("leads")).drop("_same", "_place")


def choose(rows: list[tuple], caps: Caps) -> list[str]:
    """Candidates of one owner in the order in which they are taken; ``rows`` (candidate, category, narrative, metric, entity, leads) by score."""
    taken: list[str] = []
    per_category: Counter = Counter()
    per_entity: Counter = Counter()
    metrics: set[str] = set()

    def visit(part: list[tuple], cap: int) -> None:
        for c, category, _, metric, entity, _ in part:
            if len(taken) >= caps.most:
                return
            if per_category[category] >= cap or metric in metrics or (entity is not None and per_entity[entity] >= caps.entity):
                continue
            taken.append(c)
            per_category[category] += 1
            metrics.add(metric)
            if entity is not None:
                per_entity[entity] += 1

    visit(sorted((r for r in rows if r[5]), key=lambda r: (r[2] is None, r[2] or "")), caps.category)
    visit(rows, caps.category)
    if len(taken) < caps.least:
        visit(rows, caps.relaxed)
    return taken


def diverse_selection(candidates: DataFrame, caps: Caps | None = None, tasks: int | None = None) -> DataFrame:
    """owner, place, candidate of ``candidates`` (owner long, candidate, category, narrative, metric, entity strings, score), dealt to ``tasks`` tasks."""
    caps = caps or Caps()

    columns = ["candidate", "category", "narrative", "metric", "entity", "leads"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        last = None

        def flush() -> list[tuple]:
            return [(last, k, c) for k, c in enumerate(choose(held, caps), 1)]

        for pdf in batches:
            out = []
            for owner, *row in zip(pdf["owner"].tolist(), *(pdf[c].tolist() for c in columns), strict=True):
                if owner != last:
                    out += flush()
                    held, last = [], owner
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=["owner", "place", "candidate"]).astype({"owner": "int64", "place": "int32"})
        yield pd.DataFrame(flush(), columns=["owner", "place", "candidate"]).astype({"owner": "int64", "place": "int32"})

    few = eligible(scaled(candidates, tasks), caps)  # still dealt by owner
    return few.sortWithinPartitions("owner", *_order()).select("owner", *columns).mapInPandas(run, "owner long, place int, candidate string")
