"""Sinks: ordered CSV, resumable append, reports, provenance, bundles."""

from __future__ import annotations

import csv
import datetime
import gzip
import hashlib
import io
import json
import subprocess
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.sites import KEY, MODEL_KEY, keep_first, most_common
from siteloom.shared import joined, make_folder, moved, names, read_text, remove, write_text


def write_csv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """SNK1, SNK5: one headed file in site order, nulls last, ties by the other columns, so that equal rows give equal bytes.

    Ranges of the order are sorted and written by as many tasks as there are; their files are then joined byte by
    byte (members of a gzip file may follow each other), so that no task ever sees all rows. ``_manifest.json``
    beside the file has the bytes of each range.
    """
    spark, zipped = rows.sparkSession, compression == "gzip"
    if compression not in (None, "none", "gzip"):
        raise ValueError(f"files of {compression} can't be joined")
    order = [*(c for c in KEY if c in rows.columns), *(c for c in rows.columns if c not in KEY)]
    remove(spark, path)
    rows.orderBy(*(F.col(c).asc_nulls_last() for c in order)).write.option("header", False).option("compression", "gzip" if zipped else "none").csv(f"{path}/_parts")
    line = io.StringIO()
    csv.writer(line, lineterminator="\n").writerow(rows.columns)
    head = line.getvalue().encode()
    name = "part-00000.csv" + ".gz" * zipped
    listed = joined(spark, f"{path}/_parts", f"{path}/{name}", gzip.compress(head, mtime=0) if zipped else head)
    remove(spark, f"{path}/_parts")
    write_text(spark, f"{path}/_manifest.json", json.dumps({"file": name, "columns": rows.columns, "parts": listed}, indent=1))


def _published(spark: SparkSession, path: str) -> int:
    """Moves the rows of claimed commits, whose run may have died meanwhile, to their places; the number of commits."""
    claims = names(spark, f"{path}/_log")
    done = set(names(spark, path))
    for claim in claims:
        if f"commit={claim}" not in done:
            moved(spark, f"{path}/_staged/{read_text(spark, f'{path}/_log/{claim}')}", f"{path}/commit={claim}")
    return len(claims)


def append_new(rows: DataFrame, path: str, keys: tuple[str, ...] = MODEL_KEY) -> None:
    """SNK2: adds the rows whose key the table lacks; a rerun after a failure adds what is missing.

    A run writes its rows aside, then claims the next commit number by a rename that only one run can win. The
    loser leaves out the keys that were added meanwhile and tries the number after. A run that dies before its
    claim has added nothing; one that dies after it has added all, as whoever comes next moves its rows. So
    a key comes from one run only. Dead runs leave files in ``_staged``, which nothing reads. Rows of one run that
    share a key all stay; those with a null key part are never found in the table and are added each time.
    """
    spark = rows.sparkSession
    rows, seen, staged = rows.withColumn("written_at", F.current_timestamp()), 0, None
    while True:
        n = _published(spark, path)
        if n > seen:
            there = spark.read.parquet(path).where(F.col("commit").between(seen + 1, n)).select(*keys)
            rows = rows.join(there, list(keys), "left_anti")
        before, own = staged, uuid.uuid4().hex
        staged = f"{path}/_staged/{own}"
        rows.write.parquet(staged)
        if before:
            remove(spark, before)
        rows, seen = spark.read.parquet(staged), n
        if rows.isEmpty():
            remove(spark, staged)
            return
        write_text(spark, f"{staged}.claim", own)
        make_folder(spark, f"{path}/_log")
        if moved(spark, f"{staged}.claim", f"{path}/_log/{n + 1:012d}"):
            _published(spark, path)
            return
        remove(spark, f"{staged}.claim")


def settled(spark: SparkSession, path: str, keys: tuple[str, ...] = MODEL_KEY) -> DataFrame:
    """SNK2: one row of each key, of the commit that added it."""
    _published(spark, path)
    rows = spark.read.parquet(path)
    return keep_first(rows, list(keys), ["commit", "written_at"]).drop("written_at", "commit")


def report(rows: DataFrame) -> dict:
    """SNK4: a one-row table as a nested dict."""
    row = rows.first()
    return row.asDict(recursive=True) if row else {}


def write_report(content: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, default=str))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SNK6: path, size, time and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def partition_counts(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """DQ8: how many rows there are and how many fall into each part; parts that hold all rows once add up."""
    return rows.agg(F.count("*").alias("n_input"), sum((F.count_if(test) for test in parts.values()), F.lit(0)).alias("n_parts"))


def provenance(inputs: dict[str, str], config_hash: str, counts: dict, extra: dict | None = None) -> dict:
    """SNK6 for driver-local inputs: what was read, by which code and configuration."""

    def digest(p: Path) -> str:
        h = hashlib.sha256()
        with p.open("rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.hexdigest()

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.TimeoutExpired):
            return ""

    found = {k: Path(p) for k, p in sorted(inputs.items()) if Path(p).is_file()}
    stamp = lambda p: datetime.datetime.fromtimestamp(p.stat().st_mtime, datetime.UTC).isoformat()
    return {"inputs": {k: {"path": str(p), "sha256": digest(p), "size": p.stat().st_size, "mtime": stamp(p)} for k, p in found.items()}, "config_hash": config_hash, "git": {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}, "counts": counts, "extra": extra or {}, "created": datetime.datetime.now(datetime.UTC).isoformat()}


def bundle_ids(tables: list[DataFrame], manifest: DataFrame) -> DataFrame:
    """SNK7: the distinct structure ids that any of the tables needs."""
    keys = reduce(lambda a, b: a.unionByName(b), [t.select(*KEY) for t in tables]).distinct()
    return manifest.join(keys, list(KEY), "left_semi").select(F.upper("structure_pdb_id").alias("pdb_id")).distinct()


def merge_report(merged: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """SNK8, AGG32: rows merged, rows expected and the share covered."""
    got = merged.select(*keys).distinct().join(expected.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("merged"))
    want = expected.select(*keys).distinct().agg(F.count("*").alias("expected"))
    return got.crossJoin(want).withColumn("coverage", 100 * F.col("merged") / F.col("expected"))  # one row each


def top_reasons(failures: DataFrame, n: int = 5) -> DataFrame:
    """SNK8: the most frequent normalised reasons."""
    from siteloom.functions.exprs import normal_reason

    return most_common(failures.select(normal_reason(F.col("reason")).alias("reason")), "reason", n)
