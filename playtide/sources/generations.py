"""Published generations: tables in parts, a manifest that says which files are valid, and a switch in one write.

A generation is a manifest: for every table the folder that holds each part, with hashes of
the parameters and of the source that it was made from.  A new generation writes its own
folders beside the old ones (a shadow), is validated there, and becomes current when its
manifest is committed; until then, and if validation fails, readers see the old one.  A
generation may replace some parts only: the others stay the files they were.  Readers take
the tables if both hashes hold and fall back to the raw computation otherwise.

A manifest is written by Spark under its number, which may be taken once: of two writers of
the same number one fails.  Parts are few (shards, weeks), rows are not: a table is written
by all tasks, a large part in several files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class InvalidGeneration(ValueError):
    """A shadow that did not pass its validation."""


@dataclass(frozen=True)
class Generation:
    root: str
    number: int
    params: str
    source: str
    #: table -> {"schema": JSON, "parts": {part: folder of the generation that wrote it}}
    tables: dict[str, dict] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, parts: Iterable[object] | None = None) -> DataFrame:
        """The rows of ``table``, of some parts only where given."""
        held = self.tables[table]
        schema = StructType.fromJson(held["schema"])
        wanted = held["parts"] if parts is None else {str(p): held["parts"][str(p)] for p in parts if str(p) in held["parts"]}
        paths = [f"{self.root}/{table}/{folder}/_part={part}" for part, folder in sorted(wanted.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def params_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def source_hash(*tables: DataFrame) -> str:
    """Hash of the data of tables: row count and the sum of row hashes, whatever the order or files."""
    out = []
    for t in tables:
        row = F.xxhash64(*[F.col(c) for c in sorted(t.columns)]).cast("decimal(38,0)")
        out.append([t.dtypes, *map(str, t.agg(F.count(F.lit(1)), F.sum(row)).first())])
    return params_hash({"tables": out})


def _manifests(root: str) -> str:
    return f"{root}/_manifests"


def current(spark: SparkSession, root: str) -> Generation | None:
    """The generation with the highest committed number."""
    try:
        rows = spark.read.text(f"{_manifests(root)}/*/part-*", wholetext=True)
        last = rows.select("value").orderBy(F.get_json_object("value", "$.number").cast("long").desc()).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return None if last is None else Generation(root=root, **json.loads(last.value))


def _stage(table: DataFrame, part: str, path: str) -> list[str]:
    """Write ``table`` by ``part``; the parts that it has."""
    table.withColumn("_part", F.col(part).cast("string")).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
    try:
        return [r._part for r in table.sparkSession.read.option("recursiveFileLookup", "false").parquet(path).select(F.col("_part").cast("string").alias("_part")).distinct().collect()]
    except AnalysisException as e:  # no rows, no files
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return []


def publish(
    spark: SparkSession,
    root: str,
    tables: dict[str, tuple[DataFrame, str]],
    params: dict,
    source: str,
    base: Generation | None = None,
    replaced: dict[str, Iterable[object]] | None = None,
    validate: Callable[[Generation], list[str]] | None = None,
) -> Generation:
    """Make the next generation of ``tables`` (table -> rows and part column) current.

    Without ``base`` the tables are whole.  With it they hold the rows of the ``replaced``
    parts (those without rows disappear) and every other part stays as in ``base``.
    """
    last = current(spark, root)
    number = 1 + (last.number if last else 0)
    folder = f"g{number:06d}-{uuid.uuid4().hex[:8]}"
    held = {}
    for name, (rows, part) in tables.items():
        fresh = _stage(rows, part, f"{root}/{name}/{folder}")
        old = dict(base.tables[name]["parts"]) if base else {}
        gone = {str(p) for p in (replaced or {}).get(name, ())}
        unexpected = set(fresh) - gone if base else set()
        if unexpected:
            raise InvalidGeneration(f"{name}: rows of parts that are not replaced: {sorted(unexpected)[:5]}")
        held[name] = {"schema": rows.schema.jsonValue(), "parts": {k: v for k, v in old.items() if k not in gone} | dict.fromkeys(fresh, folder)}
    for name, kept in (base.tables if base else {}).items():
        held.setdefault(name, kept)
    shadow = Generation(root, number, params_hash(params), source, held)
    problems = validate(shadow) if validate else []
    if problems:
        raise InvalidGeneration("; ".join(problems))
    content = json.dumps({"number": number, "params": shadow.params, "source": source, "tables": held})
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(f"{_manifests(root)}/{number:012d}")
    return shadow


def valid(spark: SparkSession, root: str, params: dict, source: str) -> Generation | None:
    """The current generation if it was made with these parameters from this source."""
    now = current(spark, root)
    return now if now and now.params == params_hash(params) and now.source == source else None


def served(spark: SparkSession, root: str, table: str, params: dict, source: str, raw: Callable[[], DataFrame]) -> DataFrame:
    """``table`` of a valid generation, else the raw computation."""
    now = valid(spark, root, params, source)
    return now.read(spark, table) if now else raw()
