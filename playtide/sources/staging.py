"""Staged imports that may be run again: files by content, records by fingerprint.

A batch of export records is taken in three steps, each a join or a grouping: files whose
content is known are left out, whatever their names; of equal records one stays; those that
an earlier batch brought are left out.  The rest becomes a part of the next generation, so
that a reader sees a batch whole or not at all, and earlier parts stay the files they are.
A batch that brings no new file writes nothing.

A fingerprint is the SHA-256 of the record's fields by name, nulls left out.  A file's
content is its number of records and the sum of their hashes, so their order is none of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtide.sources import generations as G
from playtide.sources.publish import scratch

PARAMS = {"import": "staged", "version": 1}


@dataclass(frozen=True)
class Imported:
    """Counts of a batch, and the generation that is current after it."""

    files: int
    known_files: int
    records: int
    added: int
    generation: G.Generation | None


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def import_batch(spark: SparkSession, root: str, table: str, rows: DataFrame, validate=None) -> Imported:  # noqa: ANN001
    """Take ``rows`` (file and the fields of a record) into ``table`` under ``root``."""
    fields = [c for c in rows.columns if c != "file"]
    staged = scratch(rows.withColumn("fingerprint", fingerprint(fields)))
    content = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).cast("string")), 256)
    files = scratch(staged.groupBy("file").agg(F.count(F.lit(1)).alias("records"), content.alias("content")))
    now = G.current(spark, root)
    known = now.read(spark, "files").select("content").distinct() if now else files.select("content").limit(0)
    fresh_files = scratch(files.join(known, "content", "left_anti").groupBy("content", "records").agg(F.min("file").alias("file")))
    n_files, n_fresh, n_records = files.count(), fresh_files.count(), staged.count()
    if not n_fresh:
        return Imported(n_files, n_files, n_records, 0, now)
    taken = staged.join(fresh_files.select("file"), "file", "left_semi").groupBy("fingerprint").agg(F.min(F.struct("file", F.struct(*fields).alias("r"))).alias("m"))
    new = taken.select("fingerprint", "m.file", "m.r.*")
    if now:
        new = new.join(now.read(spark, table).select("fingerprint"), "fingerprint", "left_anti")
    new = scratch(new)
    batch = 1 + (now.number if now else 0)
    tables = {table: (new.withColumn("batch", F.lit(batch)), "batch"), "files": (fresh_files.withColumn("batch", F.lit(batch)), "batch")}
    done = G.publish(spark, root, tables, PARAMS, str(batch), base=now, replaced={table: [batch], "files": [batch]} if now else None, validate=validate)
    return Imported(n_files, n_files - n_fresh, n_records, new.count(), done)
