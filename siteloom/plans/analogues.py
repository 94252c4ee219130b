"""The driver's tables seen as the engine's inputs, in DataFrame form and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """Rows that take long, dealt over tasks, ``each`` to one: a small file is one partition however many cores there are."""
    n = -(-rows.count() // each)
    return rows.repartition(n) if n > 1 else rows


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with orders as site pairs: a part is an accession, a line number a position (7: unknown)."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(text("l_orderkey").alias("pair_id"), text("l_partkey").alias("pos_accession"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("double")).alias("best_loss_positive_position"), (F.col("l_returnflag") != "R").alias("analysis_ready"), text("l_suppkey").alias("cluster_id"), text("o_custkey").alias("neg_accession"), F.col("l_linestatus").alias("source"))


PAIRS = """pairs AS (SELECT CAST(l_orderkey AS VARCHAR) pair_id, CAST(l_partkey AS VARCHAR) pos_accession,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS DOUBLE) END best_loss_positive_position, l_returnflag <> 'R' analysis_ready,
  CAST(l_suppkey AS VARCHAR) cluster_id, CAST(o_custkey AS VARCHAR) neg_accession, l_linestatus source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SITES = PAIRS + """, links AS (SELECT pos_accession accession, CAST(best_loss_positive_position AS INTEGER) AS position, pair_id, cluster_id, neg_accession, source
  FROM pairs WHERE analysis_ready AND best_loss_positive_position IS NOT NULL)"""


def homology(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("o_orderpriority") == "1-URGENT", "strict").when(F.col("o_orderpriority") == "2-HIGH", "plausible").otherwise("weak")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("pair_id"), bucket.alias("homology_qc_bucket"), F.col("o_orderdate").alias("line_no"))


HOMOLOGY = """homology AS (SELECT CAST(o_orderkey AS VARCHAR) pair_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'strict' WHEN '2-HIGH' THEN 'plausible' ELSE 'weak' END homology_qc_bucket FROM orders)"""
ASSOCIATED = SITES + ", " + HOMOLOGY + ", associated AS (SELECT links.*, homology_qc_bucket FROM links LEFT JOIN homology USING (pair_id))"


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """part as annotated proteins: one exact feature each, and a range for the smallest."""
    code = F.element_at(F.array(*map(F.lit, ("ECO:0000269", "ECO:0007744", "ECO:0000305", "ECO:0000255", "ECO:0000250", "ECO:0000256", "ECO:9999999"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    note = F.when(F.col("p_type") == "PROMO", "N-linked (GlcNAc...) asparagine").when(F.col("p_type") == "ECONOMY", "O-linked (GalNAc...) serine").when(F.col("p_type") == "LARGE", "N-linked (Glc) (glycation) lysine").otherwise("N-linked (GlcNAc...) asparagine")
    one = F.concat(F.lit("CARBOHYD "), F.col("p_size").cast("string"), F.lit('; /note="'), note, F.lit('"; /evidence="'), code, F.lit('|PubMed:1"; '))
    span = F.when(F.col("p_size") < 5, F.lit('CARBOHYD 3..9; /note="N-linked (GlcNAc...) asparagine"; ')).otherwise("")
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("accession"), F.concat(one, span).alias("Glycosylation"))


FEATURES = """features AS (SELECT CAST(p_partkey AS VARCHAR) accession, CAST(p_size AS INTEGER) AS position,
    CASE p_type WHEN 'ECONOMY' THEN 'O-linked' WHEN 'LARGE' THEN 'glycation' ELSE 'N-linked' END glyco_type,
    ['ECO:0000269','ECO:0007744','ECO:0000305','ECO:0000255','ECO:0000250','ECO:0000256','ECO:9999999'][CAST(p_partkey % 7 + 1 AS INTEGER)] code, 'ok' parse_status FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, 'N-linked', NULL, 'uncertain_or_range_position' FROM part WHERE p_size < 5)"""
TIER = """CASE code WHEN 'ECO:0000269' THEN 'manual_experimental' WHEN 'ECO:0007744' THEN 'manual_combinatorial' WHEN 'ECO:0000305' THEN 'manual_curator_inference'
  WHEN 'ECO:0000255' THEN 'manual_sequence_model' WHEN 'ECO:0000250' THEN 'sequence_similarity' WHEN 'ECO:0000256' THEN 'automatic_sequence_model' ELSE 'annotation_without_qualifying_evidence' END"""


def feature_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate sites over the annotated proteins and one range of others: every part at the size of the part itself and at 1."""
    part = table(spark, sf, "part")
    acc = F.col("p_partkey").cast("string").alias("accession")
    return part.select(acc, F.col("p_size").cast("int").alias("position")).union(part.select(acc, F.lit(1))).union(part.select(F.concat(F.lit("x"), "p_partkey").alias("accession"), F.lit(1))).distinct()


FEATURE_SITES = """sites AS (SELECT CAST(p_partkey AS VARCHAR) accession, CAST(p_size AS INTEGER) AS position FROM part UNION SELECT CAST(p_partkey AS VARCHAR), 1 FROM part UNION SELECT 'x' || p_partkey, 1 FROM part)"""


def glycan_entries(spark: SparkSession, sf: str) -> DataFrame:
    """events as glycan database entries: user and k are the site."""
    k = F.from_json("props", "k int")["k"]
    kind = F.col("event_type")
    category = F.when(kind == "purchase", "reported_with_glycan").when(kind.isin("click", "view"), "reported").when(kind == "signup", "predicted").otherwise("other")
    database = F.when(kind == "click", "PubMed").otherwise("UniProtKB")
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("accession"), F.lit("N-linked").alias("type"), k.alias("start_pos"), k.alias("end_pos"), F.array(category).alias("categories"), F.array(F.struct(database.alias("database"), F.col("event_id").cast("string").alias("id"))).alias("evidence"), F.concat(F.lit("G"), (F.col("event_id") % 5).cast("string")).alias("glytoucan_ac"))


ENTRIES = """entries AS (SELECT CAST(user_id AS VARCHAR) accession, CAST(json_extract_string(props, '$.k') AS INTEGER) AS position, event_id,
  CASE WHEN event_type = 'purchase' THEN 'reported_with_glycan' WHEN event_type IN ('click','view') THEN 'reported' WHEN event_type = 'signup' THEN 'predicted' ELSE 'other' END category,
  CASE WHEN event_type = 'click' THEN 'PubMed' ELSE 'UniProtKB' END db,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END rank FROM events)"""
GLYCAN_TIERS = "['glygen_reported_with_glycan','glygen_reported_independent','glygen_reported_uniprot_derived','glygen_predicted','glygen_unclassified']"


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sequences: the text's ASCII letters, upper-cased."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), letters.alias("sequence"), F.col("source").alias("control_set"), F.concat_ws("; ", "lang", "source").alias("pdb_ids"))


PROTEINS = """proteins AS (SELECT CAST(doc_id AS VARCHAR) accession, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence, source control_set, lang || '; ' || source pdb_ids FROM documents)"""


def side(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """part as cases (PROMO) and controls (ECONOMY)."""
    return table(spark, sf, "part").where(F.col("p_type") == kind).select(F.col("p_partkey").cast("string").alias("accession"), F.lit(1).alias("position"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


SIDES = """scale AS (SELECT stddev_samp(p_size) s, stddev_samp(p_retailprice) r FROM part WHERE p_type IN ('PROMO','ECONOMY')),
edges AS (SELECT CAST(a.p_partkey AS VARCHAR) case_accession, 1 case_position, CAST(b.p_partkey AS VARCHAR) control_accession, 1 control_position, a.p_brand brand,
  sqrt(((a.p_size - b.p_size) / s) ** 2 + ((a.p_retailprice - b.p_retailprice) / r) ** 2) distance
  FROM part a JOIN part b ON a.p_brand = b.p_brand, scale WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY')"""
NEAR = SIDES + ", near AS (SELECT * FROM edges WHERE distance <= 0.25)"
NEAREST = NEAR + ", nearest AS (SELECT *, row_number() OVER (PARTITION BY case_accession ORDER BY distance, control_accession) match_rank FROM near)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean line price of a part as its score; parts without lines have none. Prices are added up exactly, in whatever order they come."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(26,6)")).cast("double")
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("accession")).agg((total / F.count("l_extendedprice")).alias("score")).withColumn("position", F.lit(1))


SCORES = "scores AS (SELECT CAST(l_partkey AS VARCHAR) accession, avg(l_extendedprice) score FROM lineitem GROUP BY 1)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of unit vectors as distributions."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double") * e.cast("double")).alias("p"))


VECTORS = "vectors AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)) p FROM embeddings)"


# supplier as structure files: 40 residues of chain A on a straight line, the sequence by nation, bonds by supplier

AAS = "ACDEFGHIKLMNPQRSTVWY"
_FIXED = {10: "N", 11: "G", 12: "S", 20: "N", 21: "G", 22: "T", 30: "N", 31: "G", 32: "S"}


def _letter(n: str, i: str) -> str:
    """The residue at place i of nation n, as SQL that both engines read."""
    fixed = " ".join(f"WHEN {k} THEN '{a}'" for k, a in _FIXED.items())
    return f"CASE {i} {fixed} ELSE substr('{AAS}', CAST(({n} * 7 + {i} * {i} + 3 * {i}) % 20 + 1 AS INTEGER), 1) END"


def nation_sequence(n: str) -> str:
    return f"array_join(transform(sequence(1, 40), i -> {_letter(n, 'i')}), '')"


def structures(spark: SparkSession, sf: str, spacing: float | str = 3.8) -> DataFrame:
    """path, length, content, stem, kind: every fourth supplier is an mmCIF file, the others are PDB files.

    A glycan hangs on residue 10 of every third and on 20 of every fifth; residue 30 is bound to a metal and
    20 to a glycine, which mean nothing. Hosts of even nations can glycosylate. Alpha carbons lie in a line,
    ``spacing`` apart: a number, or an expression over supplier.
    """
    from siteloom.functions import vocab as v

    three = {a: t for t, a in sorted(v.THREE_TO_ONE.items(), reverse=True)} | {"M": "MET"}
    names = "map(" + ", ".join(f"'{a}', '{three[a]}'" for a in AAS) + ")"
    host = "if(s_nationkey % 2 = 0, 'HOMO SAPIENS (HEK293)', 'ESCHERICHIA COLI')"
    bonds = "filter(array(if(s_suppkey % 3 = 0, struct(10 as at, 'NAG' as other), null), if(s_suppkey % 5 = 0, struct(20 as at, 'BMA' as other), null), struct(30 as at, ' CA' as other), struct(20 as at, 'GLY' as other)), b -> b is not null)"
    rows = dealt(table(spark, sf, "supplier"), 500).select("s_suppkey", F.expr(f"transform(sequence(1, 40), i -> struct(i as i, {names}[{_letter('s_nationkey', 'i')}] as name))").alias("r"), F.expr(bonds).alias("b"), F.expr(host).alias("host"))
    pdb = f"""array_join(concat(array(concat('SOURCE   2 EXPRESSION_SYSTEM: ', host, ';')),
      transform(b, x -> if(x.at = 20, format_string('LINK         C1  %3s A 101                 ND2 ASN A%4d     1555   1555  1.45', x.other, x.at), format_string('LINK         ND2 ASN A%4d                 C1  %3s A 101     1555   1555  1.45', x.at, x.other))),
      transform(r, x -> format_string('ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           %2s', x.i, x.name, x.i, cast(x.i * {spacing} as double), 0.0D, 0.0D, 'C'))), '\\n')"""
    cif = f"""array_join(concat(array('data_x', concat('# EXPRESSION_SYSTEM: ', host, ';'), 'loop_', '_struct_conn.conn_type_id'),
      flatten(transform(array(1, 2), k -> array(format_string('_struct_conn.ptnr%d_label_comp_id', k), format_string('_struct_conn.ptnr%d_auth_asym_id', k), format_string('_struct_conn.ptnr%d_auth_seq_id', k), format_string('_struct_conn.pdbx_ptnr%d_PDB_ins_code', k)))),
      transform(b, x -> format_string('%s ASN A %d ? %s A 101 .', if(trim(x.other) = 'CA', 'metalc', 'covale'), x.at, x.other)),
      array('#', 'loop_'), transform(array('group_PDB', 'type_symbol', 'label_atom_id', 'auth_comp_id', 'auth_asym_id', 'auth_seq_id', 'pdbx_PDB_ins_code', 'Cartn_x', 'Cartn_y', 'Cartn_z'), c -> concat('_atom_site.', c)),
      transform(r, x -> format_string('ATOM C CA %s A %d ? %.3f 0.0 0.0', x.name, x.i, cast(x.i * {spacing} as double)))), '\\n')"""
    kind = F.when(F.col("s_suppkey") % 4 == 0, "cif").otherwise("pdb")
    content = F.encode(F.when(kind == "cif", F.expr(cif)).otherwise(F.expr(pdb)), "utf-8")
    stem = F.concat(F.lit("S"), "s_suppkey")
    return rows.select(F.concat(F.lit("mem/"), stem, F.lit("."), kind).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), stem.alias("stem"), kind.alias("kind"), "s_suppkey")


FILES = """files AS (SELECT s_suppkey k, s_nationkey n, 'S' || s_suppkey stem, CASE s_suppkey % 4 WHEN 0 THEN 'cif' ELSE 'pdb' END kind, 'mem/S' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.cif' ELSE '.pdb' END path FROM supplier)"""
RESIDUES = FILES + f", residues AS (SELECT k, n, path, CAST(i AS INTEGER) i, {_letter('n', 'i')} aa FROM files, (SELECT unnest(range(1, 41)) i))"
LINKS = "links AS (SELECT k, path, kind, 10 AS seq, 'NAG' AS name FROM files WHERE k % 3 = 0 UNION ALL SELECT k, path, kind, 20, 'BMA' FROM files WHERE k % 5 = 0)"
SEQUENCES = f"seqs AS (SELECT n, string_agg(aa, '' ORDER BY i) AS sequence FROM (SELECT n, i, {_letter('n', 'i')} aa FROM (SELECT DISTINCT n FROM files), (SELECT unnest(range(1, 41)) i)) GROUP BY 1)"


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """(accession, sequence) of each nation."""
    return table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("accession"), F.expr(nation_sequence("n_nationkey")).alias("sequence"))


def nation_structures(spark: SparkSession, sf: str) -> DataFrame:
    """(accession, pdb_id, path, s_suppkey): the structures of each nation's protein."""
    files = structures(spark, sf).select("path", "stem", "s_suppkey")
    home = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("accession"))
    return files.join(home, "s_suppkey").select("accession", F.col("stem").alias("pdb_id"), "path", "s_suppkey")
