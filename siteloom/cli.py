"""Command line: validate a configuration, run the evidence engine, fetch caches, list models."""

from __future__ import annotations

import argparse
import json
import urllib.parse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import config, schemas
from siteloom.functions import exprs as x
from siteloom.operators import evidence as ev
from siteloom.operators import structures as sr
from siteloom.operators.scoring import available
from siteloom.operators.sites import KEY, splits
from siteloom.plans import runs
from siteloom.sources import readers as rd
from siteloom.sources import sinks as sk

COMMANDS = ("validate", "fetch-glygen", "fetch-glyconnect", "fetch-structures", "fetch-controls", "models", "run")
# Names of the caches below cache_dir.
CACHES = {"glygen": "glygen_protein_detail.jsonl", "glyconnect": "glyconnect_protein_detail.jsonl", "structure": "pdb"}


def _structures(spark: SparkSession, path: dict[str, str], sites: DataFrame, table: DataFrame) -> DataFrame:
    """CMP4 from configured files: the recorded structure of each protein, then the other cached ones."""
    manifest = rd.read_csv(spark, path["structure_manifest"], schemas.STRUCTURE_MANIFEST).withColumn("line_no", F.monotonically_increasing_id())
    own = sr.structure_files(spark, path["structure_dir"])
    located = rd.structure_manifest(manifest, own, "line_no")
    cache = Path(path.get("cache_dir", "."), CACHES["structure"])
    files = own
    extras = located.select("accession", "pdb_id", "path").limit(0)
    if cache.is_dir() and any(cache.iterdir()):
        more = sr.structure_files(spark, str(cache))
        files = own.unionByName(more)
        extras = rd.extra_structures(located, sr.indexed(more, [str(cache)]))
    sequences = rd.sequences(table.withColumnRenamed("accession", "Entry"), sites.select("accession").distinct(), "line_no")
    return sr.structure_layer(sites, sequences, located, extras, files)


def evidence_run(spark: SparkSession, settings: dict) -> dict:
    """CMP1, CMP2 from configured files to tables and a summary."""
    path = {k: str(p) for k, p in settings["paths"].items()}
    layer_on = settings["layers"]
    policy = ev.Policy.of(settings["policy"])
    pairs = rd.read_csv(spark, path["pairs_master"], schemas.PAIRS)
    homology = rd.read_csv(spark, path["homology_qc"], schemas.HOMOLOGY).withColumn("line_no", F.monotonically_increasing_id())
    annotated = rd.read_csv(spark, path["uniprot_tsv"], schemas.ANNOTATION, "\t").withColumn("line_no", F.monotonically_increasing_id())
    table, missing = rd.annotation_features(annotated, pairs.select(F.col("pos_accession").alias("accession")))
    base = runs.baseline(pairs, homology, x.parse_features(table), missing, policy, ["line_no"])
    cache = path.get("cache_dir", ".")
    layers: dict[str, DataFrame] = {}
    if layer_on["glygen"]:
        layers["glygen"] = ev.layer_on_sites(base["sites"], ev.glycan_sites(rd.glycan_entries(rd.read_cache(spark, f"{cache}/{CACHES['glygen']}", schemas.GLYCAN_DETAIL))))
    if layer_on["glyconnect"]:
        records = rd.read_cache(spark, f"{cache}/{CACHES['glyconnect']}", schemas.COMPOSITION_DETAIL)
        layers["glyconnect"] = ev.layer_on_sites(base["sites"], ev.composition_sites(records.select("accession", F.explode("detail.structures").alias("s")).select("accession", "s.*")))
    if layer_on["structure"]:
        layers["structure"] = _structures(spark, path, base["sites"], table)
    combined = ev.combine(base["evidence"], list(layers.values()), policy).persist()
    out = path.get("results_dir", "results")
    tables = {
        "uniprot_exact_n_linked_sites": base["inventory"], "candidate_sites": base["sites"], "site_pair_associations": base["associations"],
        "experimental_sites_uniprot_baseline": base["qualifying"], **{f"{name}_site_evidence": rows for name, rows in layers.items()},
    }
    counts = {}
    for name, rows in {"combined": combined, **splits(combined)}.items():
        sk.write_csv(rows, config.variant_path(out, name))
        counts[name] = rows.select(*KEY).count()
    for name, rows in tables.items():
        sk.write_csv(rows, config.variant_path(out, name))
    report = {"baseline": sk.report(base["counts"]), "counts": counts, "layer_support": sk.report(ev.layer_support(combined))}
    sk.write_report(report, f"{out}/summary.json")
    inputs = {k: p for k, p in path.items() if config.PATHS.get(k) == "read"}
    sk.write_report(sk.provenance(inputs, settings["digest"], counts, {"layers": layer_on, "policy": settings["policy"]}), f"{out}/provenance.json")
    combined.unpersist()
    return report


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siteloom")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--config", default="config.toml")
    parser.add_argument("--accessions", nargs="*", default=[])
    parser.add_argument("--set", dest="control_set", choices=sorted(rd.CONTROL_TERMS), default=None)
    parser.add_argument("--limit", type=int, default=None)
    given = parser.parse_args(arguments)
    if given.command == "models":
        print("\n".join(available()))
        return 0
    settings = config.read(given.config)
    found = config.problems(settings)
    if given.command == "validate" or found:
        print("\n".join(found) or "ok")
        return int(bool(found))
    if given.command == "run":
        print(json.dumps(evidence_run(spark or SparkSession.builder.getOrCreate(), settings), indent=2))
        return 0
    folder, api = settings["paths"]["cache_dir"], settings["api"]
    folder.mkdir(parents=True, exist_ok=True)
    get_text = lambda url: rd.get_text(url, api["timeout_seconds"])
    if given.command == "fetch-controls":
        for name in [given.control_set] if given.control_set else sorted(rd.CONTROL_TERMS):
            url = f"{api['uniprot_search_url']}?{urllib.parse.urlencode({'query': rd.control_query(name), 'format': 'tsv', 'size': 500})}"
            with (folder / f"{name}.tsv").open("w") as f:
                f.writelines(f"{line}\n" for line in rd.pages(url, get_text, given.limit, api["delay_seconds"]))
        return 0
    if given.command == "fetch-structures":
        place = folder / CACHES["structure"]
        place.mkdir(exist_ok=True)
        get = lambda code, kind: get_text(api["structure_url"].format(id=code, kind=kind))[0].encode()
        print(json.dumps(rd.fetch_structures(given.accessions, place, get, api["delay_seconds"])))
        return 0
    name = given.command.removeprefix("fetch-")
    cache = folder / CACHES[name]
    known = {json.loads(line)["accession"] for line in cache.read_text().splitlines() if line.strip()} if cache.exists() else set()
    one = lambda key, **place: json.loads(get_text(api[key].format(**place))[0])
    get = (lambda a: one("glygen_url", accession=a)) if name == "glygen" else rd.two_step(lambda a: one("glyconnect_search_url", accession=a), lambda i: one("glyconnect_detail_url", protein_id=i))
    with cache.open("a") as f:

        def keep(line: str) -> None:
            f.write(line + "\n")
            f.flush()

        print(json.dumps(rd.fetch_details(given.accessions, known, get, keep, api["max_retries"], api["delay_seconds"])))
    return 0
