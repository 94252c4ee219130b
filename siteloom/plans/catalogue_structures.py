"""Queries over structure files, alignments, model places, designs: suppliers as files, nations as proteins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.functions import vocab as v
from siteloom.operators import adapters as ad
from siteloom.operators import matching as ma
from siteloom.operators import scoring as sc
from siteloom.operators import sites as st
from siteloom.operators import structures as sr
from siteloom.plans import analogues as an
from siteloom.plans import runs
from siteloom.plans.registry import add, r6
from siteloom.sources import readers as rd

# -- files ------------------------------------------------------------------------------------------


@add("SRC7", "SELECT 'S' || s_suppkey stem, CASE WHEN s_suppkey % 3 = 0 THEN 'first/S' || s_suppkey || '.pdb' WHEN s_suppkey % 2 = 0 THEN 'first/S' || s_suppkey || '.cif' ELSE 'second/S' || s_suppkey || '.pdb' END path FROM supplier")
def _(s, d):
    key = F.col("s_suppkey")
    places = F.array_compact(F.array(F.when(key % 3 == 0, F.struct(F.lit("first/").alias("at"), F.lit("pdb").alias("kind"))), F.when(key % 2 == 0, F.struct(F.lit("first/").alias("at"), F.lit("cif").alias("kind"))), F.struct(F.lit("second/").alias("at"), F.lit("pdb").alias("kind"))))
    rows = an.table(s, d, "supplier").select(key, F.explode(places).alias("p")).select(F.concat("p.at", F.lit("S"), key, F.lit("."), "p.kind").alias("path"), F.lit(9).cast("long").alias("length"))
    return sr.indexed(sr.named(rows), ["first/", "second/"])


@add("FLT16", "SELECT 'f/L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.pdb' path, 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey stem, 'pdb' kind FROM lineitem WHERE l_quantity > 1 AND CAST(l_quantity AS BIGINT) * 500000 <= 20000000")
def _(s, d):
    name = F.concat(F.lit("f/L"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), F.lit(".pdb"))
    listing = an.table(s, d, "lineitem").select(name.alias("path"), F.when(F.col("l_quantity") > 1, F.col("l_quantity").cast("long") * 500_000).otherwise(0).alias("length"))
    return sr.named(listing).select("path", "stem", "kind")


def _site_rows(links: DataFrame) -> DataFrame:
    return links.select("path", "chain_id", "resseq", "icode", "glycan_resname")


@add("SRC9", f"WITH {an.FILES}, {an.LINKS} SELECT path, 'A' chain_id, seq resseq, '' icode, name glycan_resname FROM links WHERE kind = 'pdb'")
def _(s, d):
    return _site_rows(sr.file_links(an.structures(s, d).where("kind = 'pdb'")))


@add("SRC10", f"WITH {an.FILES}, {an.LINKS} SELECT path, 'A' chain_id, seq resseq, '' icode, name glycan_resname FROM links WHERE kind = 'cif'")
def _(s, d):
    return _site_rows(sr.file_links(an.structures(s, d).where("kind = 'cif'")))


def _chain_rows(s: SparkSession, d: str) -> DataFrame:
    return sr.chains(sr.residues(sr.atoms(an.structures(s, d))))


@add("SRC11", f"WITH {an.RESIDUES} SELECT path, 'A' chain_id, string_agg(aa, '' ORDER BY i) AS sequence, CAST(count(*) AS INTEGER) n_residues, max(i) last_resseq FROM residues GROUP BY 1")
def _(s, d):
    return _chain_rows(s, d).select("path", "chain_id", "sequence", F.size("residue_ids").alias("n_residues"), F.element_at("residue_ids", -1)["resseq"].alias("last_resseq"))


@add("SRC12", f"WITH {an.FILES} SELECT path, CASE n % 2 WHEN 0 THEN 'HOMO SAPIENS (HEK293)' ELSE 'ESCHERICHIA COLI' END host FROM files")
def _(s, d):
    return sr.file_hosts(an.structures(s, d))


_MANIFEST = "SELECT 'N' || s_nationkey accession, s_suppkey k FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"


def _recorded(s: SparkSession, d: str) -> DataFrame:
    """What a download left behind: failed rows, rows without an accession, paths of another machine."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("S"), key, F.when(key % 4 == 0, ".cif").otherwise(".pdb"))
    return an.table(s, d, "supplier").select(F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("N"), "s_nationkey")).alias("accession"), F.concat(F.lit("S"), key).alias("pdb_id"), F.concat(F.when(key % 2 == 0, "mem/").otherwise("/elsewhere/"), name).alias("output_path"), F.when(key % 7 == 0, "failed").otherwise("ok").alias("status"), F.lit("S1; s2;;S3 ").alias("all_pdb_ids"), key.alias("line_no"))


@add("SRC6", f"SELECT accession, 'S' || max(k) pdb_id, 'mem/S' || max(k) || CASE max(k) % 4 WHEN 0 THEN '.cif' ELSE '.pdb' END path FROM ({_MANIFEST}) GROUP BY 1")
def _(s, d):
    files = an.structures(s, d).withColumn("length", F.when(F.col("s_suppkey") % 13 != 0, F.col("length")).otherwise(0))
    return rd.structure_manifest(_recorded(s, d), files, "line_no").select("accession", "pdb_id", "path")


@add("SRC8", f"WITH m AS (SELECT accession, max(k) k FROM ({_MANIFEST}) GROUP BY 1) SELECT accession, 'S' || i pdb_id, 'mem/S' || i || '.pdb' path FROM m, (SELECT unnest([1, 2, 3]) i) WHERE k <> i")
def _(s, d):
    files = an.structures(s, d)
    usable = files.withColumn("length", F.when(F.col("s_suppkey") % 13 != 0, F.col("length")).otherwise(0))
    return rd.extra_structures(rd.structure_manifest(_recorded(s, d), usable, "line_no"), sr.indexed(files, ["mem/"]))


_LISTED = "listed AS (SELECT 'N' || n_nationkey accession, n_nationkey n, ['X9', 'S' || (n_nationkey * 5 + 1), 'S2'] ids FROM nation), own AS (SELECT n, unnest(ids) id, generate_subscripts(ids, 1) i FROM listed)"


def _listed(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("accession", "N(.*)", 1).cast("int")
    sequence = F.when(n % 6 != 0, F.col("sequence")).otherwise("")
    return an.nations(s, d).select("accession", sequence.alias("sequence"), F.concat(F.lit("x9; s"), (n * 5 + 1).cast("string"), F.lit(";S2;")).alias("pdb_ids"), F.concat(F.lit("set"), n % 2).alias("control_set"))


@add("FLT18", f"WITH {an.FILES}, {_LISTED} SELECT 'N' || o.n accession, arg_min(f.stem, i) pdb_id, arg_min(f.path, i) path FROM own o JOIN files f ON f.stem = o.id WHERE o.n % 6 <> 0 GROUP BY o.n")
def _(s, d):
    return sr.first_usable(_listed(s, d), sr.indexed(an.structures(s, d), ["mem/"]))


@add("CMP7", "SELECT control_set, accession, 'x9' pdb_id FROM (SELECT 'set' || n_nationkey % 2 control_set, 'N' || n_nationkey accession, row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY md5('4-N' || n_nationkey)) i FROM nation) WHERE control_set = 'set0' OR i <= 5")
def _(s, d):
    return sr.control_targets(_listed(s, d), {"set1": 5}, 4)


# -- alignment, assessment, features ----------------------------------------------------------------

_SHAPES = "w AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) || upper(p_type) a FROM part), b AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN a WHEN 1 THEN a[1:4] || '#' || a[6:] ELSE 'zz' || a || 'zz' END b FROM w)"


@add("JN22", f"WITH {_SHAPES} SELECT p_partkey, round(CASE p_partkey % 3 WHEN 1 THEN (length(a) - 1) / length(a) ELSE 1 END, 6) AS identity, CAST(length(a) AS INTEGER) n_aligned, round(length(a) / length(b), 6) coverage_chain, CASE p_partkey % 3 WHEN 2 THEN 3 ELSE 1 END first_place FROM b")
def _(s, d):
    """Whole words against themselves, with one letter changed, and within others: the best alignment is known."""
    a = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.upper("p_type"))
    rows = an.dealt(an.table(s, d, "part"), 20_000).select("p_partkey", a.alias("a")).withColumn("b", F.when(F.col("p_partkey") % 3 == 0, F.col("a")).when(F.col("p_partkey") % 3 == 1, F.overlay("a", F.lit("#"), 5, 1)).otherwise(F.concat(F.lit("zz"), "a", F.lit("zz"))))
    return rows.withColumn("al", sr.aligned("a", "b")).select("p_partkey", F.round("al.identity", 6).alias("identity"), "al.n_aligned", F.round("al.coverage_chain", 6).alias("coverage_chain"), F.element_at("al.pairs", 1).alias("first_place"))


_PLACES = (5, 10, 20, 30, 60)
_ASSESSED = f"""{an.RESIDUES}, {an.LINKS}, sites AS (SELECT n_nationkey n, p FROM nation, (SELECT unnest([5, 10, 20, 30, 60]) p)),
heads AS (SELECT n, min(k) k FROM files GROUP BY 1),
seen AS (SELECT s.n, s.p, f.k, f.path, r.aa, (SELECT count(*) FROM links l WHERE l.k = f.k) n_links, EXISTS (SELECT 1 FROM links l WHERE l.k = f.k AND l.seq = s.p) linked, CASE WHEN f.k = heads.k THEN 0 ELSE 1 END turn FROM sites s JOIN files f USING (n) JOIN heads USING (n) LEFT JOIN residues r ON r.k = f.k AND r.i = s.p WHERE s.n <> 7),
tiers AS (SELECT *, CASE WHEN aa IS NULL THEN 'structure_residue_unresolved' WHEN linked THEN 'structure_linked_glycan' ELSE 'structure_residue_resolved' END tier, CASE WHEN aa IS NULL THEN 1 WHEN linked THEN 3 ELSE 2 END rank FROM seen),
best AS (SELECT *, count(*) OVER (PARTITION BY n, p) n_available, row_number() OVER (PARTITION BY n, p ORDER BY rank DESC, turn, path) i FROM tiers),
assessed AS (SELECT 'N' || s.n accession, CAST(s.p AS INTEGER) AS position, coalesce(b.tier, 'structure_not_assessed') structure_tier, coalesce('S' || b.k, 'S' || h.k, '') structure_pdb_id, coalesce(b.aa, '') structure_observed_residue,
  CASE WHEN h.k IS NULL THEN 'no_cached_structure' WHEN s.n = 7 THEN 'no_uniprot_sequence' WHEN b.aa IS NULL THEN 'position_not_in_model' WHEN b.aa = 'N' THEN '' ELSE 'residue_mismatch:' || b.aa END structure_detail,
  coalesce(b.tier = 'structure_residue_resolved' AND b.aa = 'N' AND b.n_links > 0 AND b.n % 2 = 0, false) structure_internal_control, coalesce(b.n_available, 0) structure_n_available
  FROM sites s LEFT JOIN heads h USING (n) LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON b.n = s.n AND b.p = s.p)"""


def _nation_sites(s: SparkSession, d: str) -> DataFrame:
    return an.nations(s, d).select("accession", F.explode(F.array(*map(F.lit, _PLACES))).alias("position"))


def _assessed(s: SparkSession, d: str) -> DataFrame:
    every = an.nation_structures(s, d)
    first = every.groupBy("accession").agg(F.min("s_suppkey").alias("s_suppkey"))
    manifest, extras = every.join(first, ["accession", "s_suppkey"]), every.join(first, ["accession", "s_suppkey"], "left_anti")
    sequences = an.nations(s, d).withColumn("sequence", F.when(F.col("accession") != "N7", F.col("sequence")).otherwise(""))
    return sr.structure_layer(_nation_sites(s, d), sequences, manifest, extras, an.structures(s, d))


@add("CMP4", f"WITH {_ASSESSED} SELECT * FROM assessed")
def _(s, d):
    return _assessed(s, d).select("accession", "position", "structure_tier", "structure_pdb_id", "structure_observed_residue", "structure_detail", "structure_internal_control", "structure_n_available")


@add("JN6", f"WITH {_ASSESSED} SELECT accession, position, structure_n_available FROM assessed")
def _(s, d):
    return _assessed(s, d).select("accession", "position", "structure_n_available")


@add("FN23", f"WITH {_ASSESSED} SELECT structure_tier, structure_detail, count(*) n FROM assessed GROUP BY 1, 2")
def _(s, d):
    return st.crosstab(_assessed(s, d), "structure_tier", "structure_detail")


@add("FN24", f"WITH {_ASSESSED} SELECT accession, position FROM assessed WHERE structure_internal_control")
def _(s, d):
    return _assessed(s, d).where("structure_internal_control").select("accession", "position")


@add("SRT5", f"WITH {_ASSESSED} SELECT accession, position, structure_tier, structure_pdb_id FROM assessed WHERE position IN (10, 20)")
def _(s, d):
    return _assessed(s, d).where("position in (10, 20)").select("accession", "position", "structure_tier", "structure_pdb_id")


@add("SRT6", f"WITH {an.FILES} SELECT 'N' || n accession, 10 AS position, CASE WHEN min(k) % 3 = 0 THEN 'B' ELSE 'A' END chain_id FROM files GROUP BY n")
def _(s, d):
    """Two copies of a chain and a short one: the linked copy wins, else the first of equal rank."""
    every = an.nation_structures(s, d)
    first = every.groupBy("accession").agg(F.min("s_suppkey").alias("s_suppkey"))
    heads = every.join(first, ["accession", "s_suppkey"])
    chains = heads.join(an.nations(s, d), "accession").select("path", F.explode(F.array(*map(F.lit, "ABC"))).alias("chain_id"), "sequence").withColumn("sequence", F.when(F.col("chain_id") == "C", F.substring("sequence", 1, 12)).otherwise(F.col("sequence")))
    ids = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.struct(i.alias("resseq"), F.lit("").alias("icode")))
    links = heads.where("s_suppkey % 3 = 0").select("path", F.explode(F.array(F.lit("B"), F.lit("C"))).alias("chain_id"), F.lit(10).alias("resseq"), F.lit("").alias("icode"), F.lit("NAG").alias("glycan_resname"))
    sites = heads.join(an.nations(s, d), "accession").select("accession", F.lit(10).alias("position"), "sequence", "path", "pdb_id")
    out = sr.assess(sites, chains.withColumn("residue_ids", ids), links, heads.select("path", F.lit("").alias("host")))
    return out.select("accession", "position", F.col("structure_chain_id").alias("chain_id"))


_KINDS = {k: "".join(a for a in an.AAS if a in group) for k, group in (("h", v.HYDROPHOBIC), ("c", v.CHARGED))}
_NEAR = f"""{an.RESIDUES}, near AS (SELECT a.path, a.i, a.aa, count(b.i) n, count(*) FILTER (contains('{_KINDS["h"]}', b.aa)) h, count(*) FILTER (contains('{_KINDS["c"]}', b.aa)) c FROM residues a JOIN residues b ON a.path = b.path AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY 1, 2, 3)"""


@add("FN21", f"WITH {_NEAR} SELECT path, i resseq, aa observed_residue, n n_neighbours_8a, round(h / n, 6) hydrophobic_fraction_8a, round(c / n, 6) charged_fraction_8a, 40 chain_length_resolved, least(i - 1, 40 - i) distance_to_chain_terminus FROM near")
def _(s, d):
    rows = sr.environment(sr.residues(sr.atoms(an.structures(s, d))))
    return rows.select("path", "resseq", "observed_residue", "n_neighbours_8a", r6("hydrophobic_fraction_8a"), r6("charged_fraction_8a"), F.col("chain_length_resolved").cast("int").alias("chain_length_resolved"), "distance_to_chain_terminus")


_MAX = "CASE aa " + " ".join(f"WHEN '{a}' THEN {m}" for a, m in v.MAX_ASA.items()) + " END"


@add("FN20", f"WITH {an.RESIDUES} SELECT path, i resseq, round(4 * pi() * 3.1 * 3.1, 4) sasa, round(least(4 * pi() * 3.1 * 3.1 / {_MAX}, 1.5), 6) rsa, 'exposed' rsa_bin FROM residues")
def _(s, d):
    """Atoms far apart: each has the whole of its sphere. Tests try overlapping ones."""
    areas = sr.residue_areas(sr.atoms(an.structures(s, d, 10.0)))
    return areas.select("path", "resseq", F.round("sasa", 4).alias("sasa"), r6("rsa"), "rsa_bin")


_DOTS = """dots AS (SELECT k, sqrt(1 - pow(1 - (2 * k + 1) / 100, 2)) * cos(pi() * (1 + sqrt(5)) * (k + 0.5)) px FROM (SELECT unnest(range(100)) k)),
line AS (SELECT *, 2.5 + k % 5 * 0.6 step FROM residues),
covered AS (SELECT DISTINCT a.path, a.i, dots.k FROM line a JOIN line b ON a.path = b.path AND a.i <> b.i AND abs(a.i - b.i) * a.step < 6.2, dots WHERE px * (b.i - a.i) * a.step > pow((b.i - a.i) * a.step, 2) / 6.2),
open AS (SELECT a.path, a.i, a.aa, a.step, 4 * pi() * 3.1 * 3.1 * (100 - count(c.k)) / 100 sasa FROM line a LEFT JOIN covered c USING (path, i) GROUP BY 1, 2, 3, 4)"""


@add("FN20_overlap", f"""WITH {an.RESIDUES}, {_DOTS} SELECT path, i resseq, round(sasa, 4) sasa, round(least(sasa / {_MAX}, 1.5), 6) rsa,
  abs(sasa - CASE WHEN i IN (1, 40) THEN 2 * pi() * 3.1 * (3.1 + step / 2) ELSE 2 * pi() * 3.1 * step END) < 0.04 * 4 * pi() * 3.1 * 3.1 near_caps FROM open""")
def _(s, d):
    """Spheres in a line that cover up to four others; in closed form what stays is the sphere less one or two caps."""
    step = F.lit(2.5) + F.regexp_extract("path", "S([0-9]+)", 1).cast("int") % 5 * 0.6
    areas = sr.residue_areas(sr.atoms(an.structures(s, d, "(2.5 + s_suppkey % 5 * 0.6)")))
    whole = F.lit(2 * math.pi * 3.1)
    caps = F.when(F.col("resseq").isin(1, 40), whole * (3.1 + step / 2)).otherwise(whole * step)
    return areas.select("path", "resseq", F.round("sasa", 4).alias("sasa"), r6("rsa"), (F.abs(F.col("sasa") - caps) < 0.04 * 4 * math.pi * 3.1 * 3.1).alias("near_caps"))


def _featured(s: SparkSession, d: str) -> DataFrame:
    """CMP5 over the first structure of each nation; site 60 has no residue."""
    files = an.structures(s, d, 10.0)
    every = an.nation_structures(s, d)
    heads = every.join(every.groupBy("accession").agg(F.min("s_suppkey").alias("s_suppkey")), ["accession", "s_suppkey"])
    sites = _nation_sites(s, d).join(heads, "accession").select("accession", "position", "path", F.lit("A").alias("chain_id"), F.col("position").alias("resseq"), F.lit("").alias("icode"), F.col("pdb_id").alias("structure_pdb_id"), "s_suppkey")
    atoms = sr.atoms(files.join(heads.select("path"), "path", "left_semi"))
    return sr.site_features(sites, sr.environment(sr.residues(atoms)), sr.residue_areas(atoms))


@add("CMP5", f"WITH {an.RESIDUES}, heads AS (SELECT n, min(k) k FROM files GROUP BY 1) SELECT 'N' || h.n accession, CAST(p AS INTEGER) AS position, r.aa IS NOT NULL features_available, r.aa observed_residue, CASE WHEN aa IS NOT NULL THEN round(least(4 * pi() * 3.1 * 3.1 / {_MAX}, 1.5), 6) END rsa FROM heads h CROSS JOIN (SELECT unnest([5, 10, 20, 30, 60]) p) LEFT JOIN residues r ON r.k = h.k AND r.i = p")
def _(s, d):
    return _featured(s, d).select("accession", "position", "features_available", "observed_residue", r6("rsa"))


_CANDIDATES = f"""{an.RESIDUES}, {an.SEQUENCES}, heads AS (SELECT n, min(k) k FROM files GROUP BY 1), f AS (SELECT h.n, h.k, p FROM heads h, (SELECT unnest([5, 10, 20, 30]) p) WHERE h.k % 3 <> 1 OR p <> 10),
m AS (SELECT f.n, f.k, p, sequence[p:p + 2] triplet FROM f JOIN seqs USING (n))"""


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    status = F.when((F.col("s_suppkey") % 3 == 1) & (F.col("position") == 10), "unknown").when(F.col("position") == 20, v.UNMODIFIED).otherwise(v.OCCUPIED)
    features = _featured(s, d).withColumnRenamed("chain_id", "structure_chain_id").withColumn("occupancy_status", status).drop("path", "icode")
    links = _nation_sites(s, d).select("accession", "position", F.concat(F.lit("c"), "accession").alias("cluster_id"))
    return runs.candidate_manifest(features, links, an.nations(s, d), _chain_rows(s, d), sr.indexed(an.structures(s, d), ["mem/"]))


@add("CMP9", f"WITH {_CANDIDATES} SELECT 'N' || n accession, CAST(p AS INTEGER) AS position, CASE p WHEN 20 THEN '{v.UNMODIFIED}' ELSE '{v.OCCUPIED}' END occupancy_status, 'cN' || n ortholog_clusters, 'NX' || triplet[3] subtype, CAST(p - 1 AS INTEGER) n_model_index, CAST(p + 2 AS INTEGER) plus2_resseq FROM m WHERE regexp_full_match(triplet, 'N[^P][ST]')")
def _(s, d):
    return _candidates(s, d)[0].select("accession", "position", "occupancy_status", "ortholog_clusters", "subtype", "n_model_index", "plus2_resseq")


@add("CMP6", f"WITH {_CANDIDATES} SELECT CASE WHEN regexp_full_match(triplet, 'N[^P][ST]') THEN 'mapped' ELSE 'triplet_not_a_sequon' END outcome, count(*) n FROM m GROUP BY 1")
def _(s, d):
    good, bad = _candidates(s, d)
    return st.crosstab(st.stacked([good.select(F.lit("mapped").alias("outcome")), bad.select(F.col("exclusion_reason").alias("outcome"))]), "outcome")


@add("FN25", f"""WITH {an.FILES}, {an.SEQUENCES}, q AS (SELECT n, k, p, sequence FROM files JOIN seqs USING (n), (SELECT unnest([10, 20, 39, 40]) p))
SELECT path, CAST(p AS INTEGER) AS position, CASE p WHEN 39 THEN 'plus2_not_mapped' WHEN 40 THEN 'plus1_not_mapped' END exclusion_reason, CASE WHEN p < 39 THEN 'NX' || sequence[p + 2] END subtype, CAST(p - 1 AS INTEGER) n_model_index FROM q JOIN files USING (n, k)""")
def _(s, d):
    sites = an.nation_structures(s, d).join(an.nations(s, d), "accession").select("accession", "path", "sequence", F.lit("A").alias("chain_id"), F.explode(F.array(*map(F.lit, (10, 20, 39, 40)))).alias("position"))
    rows = sr.map_sequons(sites, _chain_rows(s, d))
    return rows.select("path", "position", "exclusion_reason", F.when(F.col("exclusion_reason").isNull(), F.col("subtype")).alias("subtype"), "n_model_index")


_STATUS = f"CASE p_type WHEN 'PROMO' THEN '{v.OCCUPIED}' WHEN 'ECONOMY' THEN '{v.UNMODIFIED}' ELSE '{v.UNKNOWN}' END"
_OTHER = """SELECT CAST(a.p_partkey AS VARCHAR) || '|' || b.p_partkey group_id, CAST(a.p_partkey AS VARCHAR) accession_occ, CAST(b.p_partkey AS VARCHAR) accession_unm, true same_structure
FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY'"""


@add("JN16", _OTHER)
def _(s, d):
    rows = an.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.lit(1).alias("position"), F.concat_ws("-", "p_size", "p_brand").alias("structure_pdb_id"), F.expr(_STATUS).alias("occupancy_status"))
    return sr.within_structure_pairs(rows).select("group_id", "accession_occ", "accession_unm", "same_structure")


def _named_parts(s: SparkSession, d: str) -> DataFrame:
    return an.table(s, d, "part").select(F.concat_ws("-", "p_name", "p_brand").alias("accession"), F.col("p_partkey").cast("int").alias("position"), F.col("p_size").cast("string").alias("structure_pdb_id"), F.expr(_STATUS).alias("occupancy_status"))


_SAME = "SELECT a.p_name || '-' || a.p_brand group_id, CAST(a.p_partkey AS INTEGER) position_occ, CAST(b.p_partkey AS INTEGER) position_unm, a.p_size = b.p_size same_structure FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY'"


@add("JN15", _SAME)
def _(s, d):
    own = sr.within_structure_pairs(_named_parts(s, d)).where("accession_occ = accession_unm")
    return own.select("group_id", "position_occ", "position_unm", "same_structure")


@add("CMP8", f"SELECT group_id, position_occ, position_unm, same_structure FROM ({_SAME}) UNION SELECT a.p_name || '-' || a.p_brand || '|' || b.p_name || '-' || b.p_brand, a.p_partkey, b.p_partkey, true FROM part a JOIN part b ON a.p_size = b.p_size AND (a.p_name <> b.p_name OR a.p_brand <> b.p_brand) WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY'")
def _(s, d):
    return sr.within_structure_pairs(_named_parts(s, d)).select("group_id", "position_occ", "position_unm", "same_structure")


# -- models -----------------------------------------------------------------------------------------


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """Three places of each supplier's chain: two motifs, and one whose third residue lies outside."""
    rows = an.structures(s, d).select("s_suppkey", F.col("stem").alias("structure_pdb_id"), F.lit("A").alias("structure_chain_id"), F.explode(F.array(*map(F.lit, (10, 20, 39)))).alias("position"))
    home = an.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("accession"))
    return rows.join(home, "s_suppkey").select("accession", "position", "structure_pdb_id", "structure_chain_id", *((F.col("position") - 1 + k).alias(f"{n}_model_index") for k, n in enumerate(("n", "plus1", "plus2"))))


def _model_chains(s: SparkSession, d: str) -> DataFrame:
    """The chains, but for every eleventh supplier's."""
    rows = an.nation_structures(s, d).join(an.nations(s, d), "accession").where("s_suppkey % 11 <> 0")
    return rows.select(F.col("pdb_id").alias("structure_pdb_id"), F.lit("A").alias("structure_chain_id"), "sequence", "s_suppkey")


_ASKED = f"{an.FILES}, {an.SEQUENCES}, asked AS (SELECT 'N' || n accession, k, stem structure_pdb_id, CAST(p AS INTEGER) AS position, sequence FROM files JOIN seqs USING (n), (SELECT unnest([10, 20, 39]) p))"


@add("SNK3", f"WITH {_ASKED} SELECT accession, position, structure_pdb_id, CASE WHEN k % 11 = 0 THEN 'ValueError: chain_not_found' ELSE 'ValueError: incomplete_backbone_at_model_index_[38, 39, 40]' END reason FROM asked WHERE k % 11 = 0 OR position = 39")
def _(s, d):
    return sc.failures(sc.score_chains(_manifest(s, d), _model_chains(s, d), "hash", n_orders=2)).select("accession", "position", "structure_pdb_id", "reason")


@add("UDF8", f"WITH {_ASKED} SELECT model, conditioning, n_orders, seed, count(*) n FROM (SELECT 'hash' model, 'none' conditioning, 3 n_orders, 5 seed FROM asked) GROUP BY ALL")
def _(s, d):
    return st.crosstab(sc.score_chains(_manifest(s, d), _model_chains(s, d), "hash", n_orders=3, seed=5), "model", "conditioning", "n_orders", "seed")


@add("UDF4", f"WITH {_ASKED} SELECT n_decoding_orders, count(*) n FROM (SELECT CASE WHEN k % 11 <> 0 AND position < 39 THEN 8 END n_decoding_orders FROM asked) GROUP BY 1")
def _(s, d):
    """An option that is None is the model's own default."""
    return st.crosstab(sc.score_chains(_manifest(s, d), _model_chains(s, d), "hash", n_orders=None, seed=None), "n_decoding_orders")


@add("UDF2", f"WITH {_ASKED} SELECT accession, structure_pdb_id, position, CAST(16 AS INTEGER) n_all, CAST(4 AS INTEGER) n_first, 1.0 share FROM asked WHERE position < 39 AND k % 11 <> 0")
def _(s, d):
    """At temperature 0 the stand-in writes the native chain, which keeps every motif."""
    rows = sc.design_chains(_manifest(s, d).where("position < 39"), _model_chains(s, d), "hash", 16, 0.0, 1, 4)
    return rows.select("accession", "structure_pdb_id", "position", F.col("std.n_full_sequon_retained").alias("n_all"), F.col("pre.n_designs_scored").alias("n_first"), F.col("std.frac_full_sequon_retained").alias("share"))


_SHIFT = f"{_ASKED}, g AS (SELECT *, sequence[position:position + 2] triplet FROM asked)"


def _maps(s: SparkSession, d: str) -> DataFrame:
    """A model that lacks the first two residues of each third chain and has no backbone at every fifth's place 21."""
    chains = _model_chains(s, d)
    cut = F.col("s_suppkey") % 3 == 0
    own = chains.withColumn("model_sequence", F.when(cut, F.substring("sequence", 3, 99)).otherwise(F.col("sequence")))
    gap = F.when(cut, 18).otherwise(20)
    finite = F.transform(F.sequence(F.lit(0), F.length("model_sequence") - 1), lambda i: ~((F.col("s_suppkey") % 5 == 0) & (i == gap)))
    return sc.index_maps(chains, own.withColumn("finite", finite))


@add("JN23", f"WITH {_ASKED} SELECT DISTINCT structure_pdb_id, CAST(CASE k % 3 WHEN 0 THEN 38 ELSE 40 END AS INTEGER) n_mapped, CAST(CASE k % 3 WHEN 0 THEN 7 ELSE 9 END AS INTEGER) tenth FROM asked WHERE k % 11 <> 0")
def _(s, d):
    return _maps(s, d).select("structure_pdb_id", F.size("to_model").alias("n_mapped"), F.element_at("to_model", 9).alias("tenth"))


@add("FN38", f"""WITH {_SHIFT} SELECT accession, position, structure_pdb_id, CASE WHEN k % 11 = 0 THEN 'ChainUnreadableError: chain_not_found' WHEN k % 5 = 0 AND position = 20 THEN 'IncompleteBackboneError: incomplete at [' || CASE k % 3 WHEN 0 THEN 18 ELSE 20 END || ']'
WHEN k % 7 = 0 THEN 'SequonMismatchError: ' || triplet || ' for NNN' END error, CASE WHEN k % 11 <> 0 AND NOT (k % 5 = 0 AND position = 20) AND k % 7 <> 0 THEN CAST(position - 1 - CASE k % 3 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) END first_place FROM g WHERE position < 39""")
def _(s, d):
    right = F.substring("sequence", F.col("position"), F.lit(3))
    triplets = an.nations(s, d).select("accession", "sequence")
    rows = _manifest(s, d).where("position < 39").join(triplets, "accession")
    rows = rows.withColumn("triplet", F.when(F.regexp_extract("structure_pdb_id", "S(.*)", 1).cast("int") % 7 == 0, "NNN").otherwise(right)).drop("sequence")
    return sc.guarded_indices(rows, _maps(s, d)).select("accession", "position", "structure_pdb_id", "error", F.get("places", F.lit(0)).alias("first_place"))


_ODD = "q AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 o, least(greatest(p[12], 1e-6), 1 - 1e-6) n, least(greatest(p[16] + p[17], 1e-6), 1 - 1e-6) st FROM vectors)"


@add("FN39", f"WITH {an.VECTORS}, {_ODD} SELECT label AS key, count(*) n_orders, round(avg((ln(n / (1 - n)) + ln(st / (1 - st))) / 2), 6) score FROM q WHERE o < 4 GROUP BY 1")
def _(s, d):
    """The first four of a label's vectors as its orders."""
    rows = an.vectors(s, d).groupBy(F.col("label").alias("key")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "p"))).alias("l"))
    rows = rows.select("key", F.posexplode("l").alias("order", "e")).select("key", "order", F.col("e.p").alias("at_n"), F.col("e.p").alias("at_plus2"))
    return sc.order_scores(rows, 4).select("key", "n_orders", r6("score"))


@add("UDF3", "SELECT unnest(['esm_if', 'esmc', 'hash', 'proteinmpnn']) AS model")
def _(s, d):
    return s.createDataFrame([(m,) for m in sc.available()], "model string")


def _weighted(name: str, mask: str, network: type = ad.EchoNetwork):
    """A query that scores every supplier's two motifs by the model's own steps around that network."""

    def run(s: SparkSession, d: str) -> DataFrame:
        def factory():
            ad.register_backend(name, network)
            return ad.WeightedModel(name, mask_mode=mask)

        sc.register(f"{name}-{mask}-echo", factory)
        try:
            rows = sc.score_chains(_manifest(s, d).where("position < 39"), _model_chains(s, d), f"{name}-{mask}-echo")
        finally:
            sc.unregister(f"{name}-{mask}-echo")
        return rows.where("error is null").select("accession", "position", "structure_pdb_id", "n_decoding_orders", "model", "conditioning", F.round("conditional_sequon_score", 6).alias("score"))

    return run


_RIGHT = "(ln(0.9 / 0.1) + ln((0.9 + 0.005) / (1 - 0.905))) / 2"
_FLAT = "(ln((1 / 21.0) / (1 - 1 / 21.0)) + ln((2 / 21.0) / (1 - 2 / 21.0))) / 2"


def _weighted_sql(model: str, mask: str, orders: int, odds: str) -> str:
    return f"WITH {_ASKED} SELECT accession, position, structure_pdb_id, {orders} n_decoding_orders, '{ad.MODELS[model]['checkpoint']}' model, '{ad.MODELS[model]['masks'][mask]}' conditioning, round({odds}, 6) score FROM asked WHERE position < 39 AND k % 11 <> 0"


add("UDF5", _weighted_sql("proteinmpnn", "joint", 8, _FLAT))(_weighted("proteinmpnn", "joint"))
add("UDF6", _weighted_sql("esm_if", "single", 1, _RIGHT))(_weighted("esm_if", "single"))
add("UDF7", _weighted_sql("esmc", "single", 1, _RIGHT))(_weighted("esmc", "single"))


def _stepped_sql(model: str, mask: str, orders: int) -> str:
    """What StepNetwork gives at the first and third residue of a motif; with joint masks it can't see the second beside the first."""
    hidden, beside = (2, "21") if mask == "joint" else (0, f"(instr('{v.ALPHABET}', sequence[position + 1]) - 1)")
    weight = lambda k, place, seen: f"(1 + (7 * {k} + 3 * ({place}) + 5 * o + {11 * hidden} + 17 * {seen}) % 13)"
    share = lambda letters, place, seen: "(" + " + ".join(weight(v.ALPHABET.index(c), place, seen) for c in letters) + f") / list_sum(list_transform(range(21), lambda k: {weight('k', place, seen)}))"
    last = f"(instr('{v.ALPHABET}', sequence[position + 3]) - 1)"
    return f"""WITH {_ASKED}, q AS (SELECT accession, position, structure_pdb_id, {share("N", "position - 1", beside)} n, {share("ST", "position + 1", last)} st FROM asked, (SELECT unnest(range({orders})) o) WHERE position < 39 AND k % 11 <> 0)
SELECT accession, position, structure_pdb_id, CAST(count(*) AS INTEGER) n_decoding_orders, '{ad.MODELS[model]["checkpoint"]}' model, '{ad.MODELS[model]["masks"][mask]}' conditioning, round(avg((ln(n / (1 - n)) + ln(st / (1 - st))) / 2), 6) score FROM q GROUP BY 1, 2, 3"""


add("UDF5_network", _stepped_sql("proteinmpnn", "joint", 8))(_weighted("proteinmpnn", "joint", ad.StepNetwork))
add("UDF6_network", _stepped_sql("esm_if", "single", 1))(_weighted("esm_if", "single", ad.StepNetwork))
add("UDF7_network", _stepped_sql("esmc", "joint", 1))(_weighted("esmc", "joint", ad.StepNetwork))


@add("UDF10", "SELECT 'cpu' AS device, true AS refused")
def _(s, d):
    """Where no accelerator is there, and no folder holds the weights."""
    try:
        ad.located("weights.pt", ["/nowhere"], "SITELOOM_NO_SUCH_VARIABLE")
        refused = False
    except ad.ModelUnavailableError:
        refused = True
    return s.createDataFrame([(ad.resolved_device("cuda"), refused)], "device string, refused boolean")
