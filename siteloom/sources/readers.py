"""Scans: delimited text, JSON-line caches, structure manifests, REST pages."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom import schemas
from siteloom.functions.exprs import clean_ids, no_nan
from siteloom.functions.vocab import TRANSFER_TAXA
from siteloom.operators.sites import keep_first
from siteloom.shared import exists


def normalised(rows: DataFrame) -> DataFrame:
    """NaN becomes null in every double or float column, so that aggregates skip it."""
    doubles = [f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({c: no_nan(F.col(c)) for c in doubles}) if doubles else rows


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """SRC1, SRC2: declared columns of a headed file, by name; gzip is read as it is."""
    head = spark.read.option("header", True).option("sep", sep).csv(path, enforceSchema=False).columns
    wanted = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").schema(T.StructType([T.StructField(c, T.StringType()) for c in head])).csv(path)
    return normalised(raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in head else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted)))


def annotation_features(table: DataFrame, accessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC2: (rows of the wanted accessions, accessions that the table lacks)."""
    rows = table.withColumn("accession", F.trim("Entry")).drop("Entry")
    wanted = accessions.select("accession").distinct()
    return rows.join(wanted, "accession", "left_semi"), wanted.join(rows.select("accession"), "accession", "left_anti")


def with_reference(table: DataFrame, accessions: DataFrame, column: str) -> DataFrame:
    """SRC3: wanted accessions whose cross-reference cell isn't blank."""
    rows = table.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(F.trim("Entry").alias("accession"))
    return rows.join(accessions.select("accession"), "accession", "left_semi").distinct().orderBy("accession")


def sequences(table: DataFrame, accessions: DataFrame, order: str) -> DataFrame:
    """SRC4: the last sequence of each wanted accession in the stated order."""
    rows = table.select(F.trim("Entry").alias("accession"), F.trim("Sequence").alias("sequence"), order)
    return rows.join(accessions.select("accession"), "accession", "left_semi").groupBy("accession").agg(F.max_by("sequence", order).alias("sequence"))


def read_cache(spark: SparkSession, path: str, detail: str) -> DataFrame:
    """SRC5: JSON lines {accession, detail, error}; the last line with a detail wins; no file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"accession string, detail {detail}")
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = rows.select("line", F.from_json("value", f"accession string, detail {detail}, error string").alias("j")).where("j.detail is not null")
    return rows.groupBy(F.col("j.accession").alias("accession")).agg(F.max_by("j.detail", "line").alias("detail"))


def glycan_entries(cache: DataFrame) -> DataFrame:
    """Entries of a glycan cache with their categories: the map's keys, or else the single category."""
    rows = cache.select("accession", F.explode("detail.glycosylation").alias("e")).select("accession", "e.*")
    keys = F.coalesce(F.map_keys("site_category_dict"), F.array().cast("array<string>"))
    single = F.when(F.coalesce("site_category", F.lit("")) != "", F.array("site_category")).otherwise(F.array().cast("array<string>"))
    return rows.select("accession", "type", "start_pos", "end_pos", F.when(F.size(keys) > 0, keys).otherwise(single).alias("categories"), F.coalesce("evidence", F.array().cast("array<struct<database:string,id:string>>")).alias("evidence"), F.coalesce("glytoucan_ac", F.lit("")).alias("glytoucan_ac"))


class StructureManifestError(ValueError):
    """Rows were considered but none of their files could be found."""


def structure_manifest(manifest: DataFrame, files: DataFrame, order: str) -> DataFrame:
    """SRC6: accession, pdb_id, path: the recorded path, or else the file of that name; the last row wins."""
    rows = manifest.where("trim(coalesce(accession, '')) <> '' and trim(coalesce(output_path, '')) <> '' and coalesce(status, '') <> 'failed'").withColumn("name", F.element_at(F.split("output_path", "/"), -1))
    own = files.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "^file:/*", "/").alias("plain"))
    exact = rows.join(own.select(F.col("path").alias("exact"), F.col("plain").alias("output_path")), "output_path", "left")
    both = exact.join(own.groupBy("name").agg(F.min("path").alias("by_name")), "name", "left").withColumn("path", F.coalesce("exact", "by_name"))
    found = both.where("path is not null")
    if found.isEmpty() and not rows.isEmpty():
        raise StructureManifestError("no structure of the manifest was found")
    return found.groupBy("accession").agg(F.max_by(F.struct("pdb_id", "path", "all_pdb_ids"), order).alias("r")).select("accession", "r.*")


def extra_structures(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """SRC8, SRC17: cached files of the accession's other structure ids."""
    ids = manifest.select("accession", "pdb_id", F.explode(clean_ids(F.col("all_pdb_ids"))).alias("id")).where(F.upper("id") != F.upper("pdb_id"))
    return ids.join(index.withColumnRenamed("stem", "upper_id").drop("pdb_id"), F.upper("id") == F.col("upper_id")).select("accession", F.upper("id").alias("pdb_id"), F.col("path")).distinct()


def wanted_structures(manifest: DataFrame, cap: int = 20) -> DataFrame:
    """SRC16, SRC17: other structure ids to fetch, sorted, the first few of each accession."""
    others = F.array_sort(F.array_except(F.array_distinct(F.transform(clean_ids(F.col("all_pdb_ids")), lambda x: F.upper(x))), F.array(F.upper("pdb_id"))))
    return manifest.select("accession", F.explode(F.slice(others, 1, cap)).alias("pdb_id"))


def fetch_structures(ids: list[str], folder: Path, get: Callable[[str, str], bytes], delay: float = 0.0) -> dict[str, int]:
    """SRC16: one file a structure id, .pdb or else .cif; what is there already isn't asked for."""
    counts = dict.fromkeys(("requested", "downloaded", "downloaded_mmcif", "cached", "failed"), 0)
    for code in sorted({i.upper() for i in ids}):
        counts["requested"] += 1
        if any(f.is_file() and f.stat().st_size for f in (folder / f"{code}.pdb", folder / f"{code}.cif")):
            counts["cached"] += 1
            continue
        result = "failed"
        for kind, name in (("pdb", "downloaded"), ("cif", "downloaded_mmcif")):
            try:
                content = get(code, kind)
            except OSError:
                continue
            (folder / f"{code}.{kind}").write_bytes(content)
            result = name
            break
        counts[result] += 1
        time.sleep(delay)
    return counts


def first_row(rows: DataFrame) -> DataFrame:
    """SRC18: what a score table says of its origin."""
    names = [c for c in ("model", "conditioning", "n_orders") if c in rows.columns]
    return rows.limit(1).select((F.concat_ws(" / ", *(F.col(c).cast("string") for c in names)) if names else F.lit("unknown")).alias("source"))


# -- network ingest: runs on the driver, one polite request at a time, into a landing folder ---------


def get_text(url: str, timeout: float = 30) -> tuple[str, str]:
    """(body, Link header)."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "text/plain, application/json"}), timeout=timeout) as r:
        return r.read().decode(), r.headers.get("Link", "")


def next_link(header: str) -> str | None:
    m = re.search(r'<([^>]+)>;\s*rel="next"', header or "")
    return m[1] if m else None


def pages(url: str, get: Callable[[str], tuple[str, str]] = get_text, limit: int | None = None, delay: float = 0.0) -> Iterator[str]:
    """SRC13: rows of a paged TSV; the first page's header is the header."""
    header, n = None, 0
    while url:
        body, link = get(url)
        lines = [x for x in body.split("\n") if x]
        if lines and header is None:
            header = lines[0]
            yield header
        for line in lines[1:]:
            if limit is not None and n >= limit:
                return
            n += 1
            yield line
        url = next_link(link)
        time.sleep(delay)


def fetch_details(accessions: list[str], known: set[str], get: Callable[[str], dict], write: Callable[[str], None], retries: int = 3, delay: float = 0.0) -> dict[str, int]:
    """SRC14, SRC15: one JSON line for each accession not known yet. HTTP errors are final, others are retried."""
    counts = {"requested": 0, "fetched": 0, "failed": 0}
    for accession in sorted(set(accessions) - known):
        counts["requested"] += 1
        detail, error = None, "no attempt"
        for attempt in range(max(1, retries)):
            try:
                detail, error = get(accession), None
                break
            except urllib.error.HTTPError as e:
                error = f"HTTPError: {e.code}"
                break
            except (urllib.error.URLError, TimeoutError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(delay * (attempt + 1))
        counts["failed" if error else "fetched"] += 1
        write(json.dumps({"accession": accession, "detail": detail, "error": error}))
        time.sleep(delay)
    return counts


def two_step(search: Callable[[str], dict], detail: Callable[[str], dict]) -> Callable[[str], dict]:
    """SRC15: the first hit's id, then its record."""

    def get(accession: str) -> dict:
        hits = search(accession).get("hits") or []
        if not hits:
            raise ValueError("no hit")
        return detail(str(hits[0]["id"]))

    return get


# The control sets' queries are conjunctions of these terms.
CONTROL_TERMS = {
    "cytosolic_eukaryotic": ("reviewed:true", "taxonomy_id:2759", "go:0005829", "database:pdb", "NOT keyword:KW-0325", "NOT keyword:KW-0732", "NOT keyword:KW-0812"),
    "secretory_eukaryotic_unannotated": ("reviewed:true", "taxonomy_id:2759", "database:pdb", "(keyword:KW-0964 OR keyword:KW-0812 OR keyword:KW-0732)", "NOT keyword:KW-0325"),
    "bacterial_extracytoplasmic": ("reviewed:true", "taxonomy_id:2", "database:pdb", "(keyword:KW-0574 OR keyword:KW-0998 OR keyword:KW-0964)", "NOT keyword:KW-0325", *(f"NOT taxonomy_id:{t}" for t in TRANSFER_TAXA)),
}


def control_query(name: str) -> str:
    """FLT17 as a search string."""
    return " AND ".join(CONTROL_TERMS[name])


def control_set(proteins: DataFrame, name: str) -> DataFrame:
    """FLT17 on a table (reviewed, has_structure, taxonomy_ids, keywords, go_ids), tagged; DDP2."""
    has = lambda c, k: F.array_contains(c, k)
    base = F.col("reviewed") & F.col("has_structure") & ~has("keywords", "KW-0325")
    secreted = lambda *ks: sum((has("keywords", k).cast("int") for k in ks), F.lit(0)) > 0
    test = {
        "cytosolic_eukaryotic": base & has("taxonomy_ids", 2759) & has("go_ids", "0005829") & ~has("keywords", "KW-0732") & ~has("keywords", "KW-0812"),
        "secretory_eukaryotic_unannotated": base & has("taxonomy_ids", 2759) & secreted("KW-0964", "KW-0812", "KW-0732"),
        "bacterial_extracytoplasmic": base & has("taxonomy_ids", 2) & secreted("KW-0574", "KW-0998", "KW-0964") & ~F.arrays_overlap("taxonomy_ids", F.array(*map(F.lit, TRANSFER_TAXA))),
    }[name]
    rest = [c for c in sorted(proteins.columns) if c != "Entry"]
    return keep_first(proteins.where(test), ["Entry"], [F.to_json(F.struct(*rest))]).withColumn("control_set", F.lit(name))
