"""Queries that go through files and pages: what is written is what is read back."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom import config
from siteloom.operators import sites as st
from siteloom.plans import analogues as an
from siteloom.plans.registry import add
from siteloom.shared import own_folder
from siteloom.sources import readers as rd
from siteloom.sources import sinks as sk


def _written(rows: DataFrame, name: str, sep: str = ",", compression: str = "none") -> str:
    path = f"{own_folder(rows.sparkSession, name)}/table"
    rows.write.option("header", True).option("sep", sep).option("compression", compression).option("escape", '"').csv(path)
    return path


# -- sources ----------------------------------------------------------------------------------------


@add("SRC1", "SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber <> 7 THEN l_quantity END l_quantity, CAST(NULL AS VARCHAR) l_absent FROM lineitem")
def _(s, d):
    rows = an.table(s, d, "lineitem").select("l_returnflag", "l_partkey", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"), "l_orderkey")
    return rd.read_csv(s, _written(rows, "src1"), "l_orderkey bigint, l_partkey bigint, l_quantity double, l_absent string")


@add("SRC2", "SELECT CAST(p_partkey AS VARCHAR) accession, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    part = an.table(s, d, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("Entry"), "p_name")
    table = rd.read_csv(s, _written(part, "src2", "\t", "gzip"), "Entry string, p_name string", "\t")
    wanted = an.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("accession"))
    return rd.annotation_features(table, wanted)[0].select("accession", "p_name")


@add("SRC5", "SELECT CAST(user_id AS VARCHAR) accession, CAST(arg_max(json_extract_string(props, '$.k'), event_id) AS INTEGER) k FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(s, d):
    ok = F.col("event_type") != "error"
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("accession"), F.when(ok, F.from_json("props", "k int")).alias("detail"), F.when(~ok, "HTTPError: 404").alias("error")))
    path = f"{own_folder(s, 'src5')}/cache"
    an.table(s, d, "events").orderBy("event_id").select(line.alias("value")).write.text(path)
    return rd.read_cache(s, path, "struct<k:int>").select("accession", "detail.k")


def _pages(rows: list[tuple], columns: tuple[str, ...], size: int):
    """A server of a paged table, in place of the network."""
    chunks = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]

    def get(url: str) -> tuple[str, str]:
        n = int(url.rsplit("=", 1)[1])
        body = "\n".join(["\t".join(columns), *("\t".join(map(str, r)) for r in chunks[n])])
        return body, f'<http://here/?page={n + 1}>; rel="next"' if n + 1 < len(chunks) else ""

    return get


@add("SRC13", "SELECT CAST(n_nationkey AS VARCHAR) Entry, n_name Organism FROM nation")
def _(s, d):
    rows = [tuple(r) for r in an.table(s, d, "nation").select("n_nationkey", "n_name").collect()]  # a nation a row
    lines = [line.split("\t") for line in rd.pages("http://here/?page=0", _pages(rows, ("Entry", "Organism"), 7))]
    return s.createDataFrame(lines[1:], ", ".join(f"{c} string" for c in lines[0]))


def _fetched(s: SparkSession, d: str, get) -> DataFrame:
    lines: list[str] = []
    keys = [str(r[0]) for r in an.table(s, d, "nation").select("n_nationkey").collect()]  # a nation a row
    rd.fetch_details(keys, {"3", "4"}, get, lines.append, 2)
    return s.createDataFrame([(r["accession"], json.dumps(r["detail"]), r["error"]) for r in map(json.loads, lines)], "accession string, detail string, error string")


@add("SRC14", "SELECT CAST(n_nationkey AS VARCHAR) accession, CASE WHEN n_nationkey % 5 = 0 THEN 'null' ELSE '{\"n\": ' || n_nationkey || '}' END detail, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError: odd' END error FROM nation WHERE n_nationkey NOT IN (3, 4)")
def _(s, d):
    def get(key: str) -> dict:
        if int(key) % 5 == 0:
            raise ValueError("odd")
        return {"n": int(key)}

    return _fetched(s, d, get)


@add("SRC15", "SELECT CAST(n_nationkey AS VARCHAR) accession, CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '{\"id\": \"7' || n_nationkey || '\"}' END detail, CASE WHEN n_nationkey % 2 = 0 THEN 'ValueError: no hit' END error FROM nation WHERE n_nationkey NOT IN (3, 4)")
def _(s, d):
    search = lambda key: {"hits": [{"id": f"7{key}"}, {"id": "0"}] if int(key) % 2 else []}
    return _fetched(s, d, rd.two_step(search, lambda i: {"id": i}))


@add("SRC16", "SELECT count(*) requested, count(*) FILTER (n_nationkey % 2 = 0) downloaded, count(*) FILTER (n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0 AND n_nationkey <> 1) downloaded_mmcif, count(*) FILTER (n_nationkey = 1) cached, count(*) FILTER (n_nationkey % 2 = 1 AND n_nationkey % 3 = 0) failed FROM nation")
def _(s, d):
    """Even ids are there as .pdb, odd ones as .cif unless three divides them; one is cached already."""

    def get(code: str, kind: str) -> bytes:
        n = int(code[1:])
        if kind == "pdb" and n % 2 or kind == "cif" and n % 3 == 0:
            raise OSError(code)
        return b"x"

    with tempfile.TemporaryDirectory() as folder:  # the driver's own landing folder, gone at once
        Path(folder, "S1.cif").write_text("x")
        ids = [f"s{r[0]}" for r in an.table(s, d, "nation").select("n_nationkey").collect()]  # a nation a row
        return s.createDataFrame([tuple(rd.fetch_structures(ids, Path(folder), get).values())], "requested long, downloaded long, downloaded_mmcif long, cached long, failed long")


@add("SRC18", "SELECT 'AFRICA / 0' AS source, 'unknown' nothing")
def _(s, d):
    rows = an.table(s, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("model"), F.col("r_regionkey").alias("n_orders"), "r_name")
    return rd.first_row(rows).crossJoin(rd.first_row(rows.select("r_name")).select(F.col("source").alias("nothing")))  # one row each


_TOML = """[paths]
pairs_master = "in/pairs.csv"
results_dir = "../out"
[layers]
structure = true
[policy]
strict_buckets = ["a", "b"]
glyconnect_qualifes = true
"""


@add("SRC19", "SELECT * FROM (VALUES ('paths.pairs_master', '/base/conf/in/pairs.csv'), ('paths.results_dir', '/base/out'), ('layers.structure', 'True'), ('layers.glygen', 'False'), ('policy.strict_buckets', 'a,b'), ('problem', '[paths] pairs_master: /base/conf/in/pairs.csv does not exist'), ('problem', '[policy] glyconnect_qualifes is no key')) t(name, value)")
def _(s, d):
    settings = config.read_text(_TOML, "/base/conf")
    wanted = {"paths.pairs_master", "paths.results_dir", "layers.structure", "layers.glygen", "policy.strict_buckets"}
    rows = [(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in config.leaves({k: settings[k] for k in ("paths", "layers", "policy")}) if k in wanted]
    return s.createDataFrame(rows + [("problem", p) for p in config.problems(settings)], "name string, value string")


# -- sinks ------------------------------------------------------------------------------------------


def _sites(s: SparkSession, d: str) -> DataFrame:
    return st.candidate_sites(an.pairs(s, d))


@add("SNK1", f"WITH {an.SITES} SELECT accession, position, row_number() OVER (ORDER BY accession, position) line FROM (SELECT DISTINCT accession, position FROM links)")
def _(s, d):
    path = f"{own_folder(s, 'snk1')}/sites"
    sk.write_csv(_sites(s, d), path)
    # one file, whose first line is the head; it may be read in several blocks, and not in their order
    lines = s.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("block", "first", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a block
    lines = lines.join(F.broadcast(blocks), "block").withColumn("line", F.col("at") - F.col("first") + F.col("before")).where("line > 0")
    parts = F.split("value", ",")
    return lines.select(parts[0].alias("accession"), parts[1].cast("int").alias("position"), "line")


@add("SNK5", f"WITH {an.SITES} SELECT DISTINCT accession, position FROM links")
def _(s, d):
    path = f"{own_folder(s, 'snk5')}/sites"
    sk.write_csv(_sites(s, d), path, "gzip")
    return rd.read_csv(s, f"{path}/*.csv.gz", "accession string, position int")


@add("SNK2", "SELECT CAST(l_partkey AS VARCHAR) accession, min(CASE WHEN l_linenumber < 4 THEN 'first' ELSE 'second' END) run FROM lineitem GROUP BY 1")
def _(s, d):
    rows = an.table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("accession"), "l_linenumber")
    path = f"{own_folder(s, 'snk2')}/scores"
    for test, run in (("l_linenumber < 4", "first"), ("true", "second"), ("true", "third")):
        sk.append_new(rows.where(test).select("accession").distinct().withColumn("run", F.lit(run)), path, ("accession",))
    return sk.settled(s, path, ("accession",))


@add("SNK4", "SELECT count(*) n, sum(c_custkey) total, min(c_mktsegment) first FROM customer")
def _(s, d):
    numbers = an.table(s, d, "customer").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"), F.min("c_mktsegment").alias("first"))
    with tempfile.TemporaryDirectory() as folder:  # a report is a file of the driver
        sk.write_report({"summary": sk.report(numbers)}, f"{folder}/a/report.json")
        found = json.loads(Path(folder, "a/report.json").read_text())["summary"]
    return s.createDataFrame([(found["n"], found["total"], found["first"])], "n long, total long, first string")


@add("SNK6", "SELECT n_name, sha256(n_name || chr(10)) sha256, CAST(length(n_name) + 1 AS BIGINT) size FROM nation")
def _(s, d):
    path = f"{own_folder(s, 'snk6')}/files"
    an.table(s, d, "nation").select("n_name", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_name").text(path)
    return sk.file_digests(s, path).select(F.regexp_extract("path", "n_name=([^/]*)", 1).alias("n_name"), "sha256", "size")


@add("FN34", "SELECT r_name, 'out/scores' || CASE r_regionkey WHEN 0 THEN '' ELSE '_' || lower(r_name) END path FROM region")
def _(s, d):
    rows = [(r.r_name, config.variant_path("out/", "scores", r.r_name.lower() if r.r_regionkey else "")) for r in an.table(s, d, "region").collect()]  # five rows
    return s.createDataFrame(rows, "r_name string, path string")


@add("FN40", "SELECT given, suffix FROM (VALUES ('x', '_x'), (' _x', '_x'), ('x__ ', '_x'), ('', ''), ('  ', ''), ('a_b', '_a_b')) t(given, suffix)")
def _(s, d):
    return s.createDataFrame([(g, config.variant_suffix(g)) for g in ("x", " _x", "x__ ", "", "  ", "a_b")], "given string, suffix string")
