import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siteloom.functions import vocab as v
from siteloom.operators import structures as sr

SEQ = "MNKTALWDGYSPVHCEQFIRGSTVLIPFYHQEDKMWNACR"
THREE = {"A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "E": "GLU", "Q": "GLN", "G": "GLY", "H": "HIS", "I": "ILE", "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL"}


def atom(i, aa, chain="A", x=0.0, y=0.0, z=0.0, name="CA"):
    return f"ATOM  {i:5d}  {name:<3s} {THREE[aa]:3s} {chain}{i:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {name[0]:>2s}"


def link(chain="A", seq=2, other="NAG", icode=" "):
    return f"LINK         ND2 ASN {chain}{seq:4d}{icode}                C1  {other} {chain} 101     1555   1555  1.45"


CIF = """data_x
loop_
_struct_conn.id
_struct_conn.conn_type_id
_struct_conn.ptnr1_auth_comp_id
_struct_conn.ptnr1_auth_asym_id
_struct_conn.ptnr1_auth_seq_id
_struct_conn.pdbx_ptnr1_PDB_ins_code
_struct_conn.ptnr2_auth_comp_id
_struct_conn.ptnr2_auth_asym_id
_struct_conn.ptnr2_auth_seq_id
_struct_conn.pdbx_ptnr2_PDB_ins_code
c1 covale ASN A 61 ? NAG A 401 ?
c2 covale NAG B 402 ? ASN B 74 A
c3 disulf CYS A 5 ? CYS A 9 ?
c4 covale SER A 8 ? MAN A 403 ?
c5 covale ASN A 90 ? GLY A 91 ?
c6 metalc ASN A 92 ? CA A 404 ?
c7 covale ASN A x ? NAG A 405 ?
#
"""


def write(tmp_path):
    lines = ["SOURCE   2 EXPRESSION_SYSTEM: HOMO SAPIENS;", link(seq=37), link(seq=20, other=" CA"), link(seq=21, other="GLY"), link(seq=-4, icode="B")] + [atom(i + 1, a, x=3.8 * i) for i, a in enumerate(SEQ)] + ["ENDMDL", atom(1, "G", "B"), "END"]
    (tmp_path / "1abc.pdb").write_text("\n".join(lines))
    (tmp_path / "1abc.cif").write_text(CIF)
    (tmp_path / "empty.pdb").write_text("")
    return f"file://{tmp_path}"


def test_files_links_chains(spark, tmp_path):
    files = sr.structure_files(spark, write(tmp_path))
    assert files.count() == 2 and sr.indexed(files, [str(tmp_path)]).first().path.endswith(".pdb")
    links = {(r.chain_id, r.resseq, r.icode, r.glycan_resname) for r in sr.file_links(files).collect()}
    assert links == {("A", 37, "", "NAG"), ("A", -4, "B", "NAG"), ("A", 61, "", "NAG"), ("B", 74, "A", "NAG")}
    (chain,) = sr.chains(sr.residues(sr.atoms(files))).collect()
    assert chain.chain_id == "A" and chain.sequence == SEQ and chain.residue_ids[1].resseq == 2


def test_alignment():
    assert sr.align("ABCDEF", "XXBCDEYY") == [(2, 3), (3, 4), (4, 5), (5, 6)]
    long = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"
    assert sr.align(long, long) == [(i, i) for i in range(1, len(long) + 1)]
    gapped = long[:15] + long[18:]
    pairs = sr.align(long * 1, gapped)
    assert pairs[:15] == [(i, i) for i in range(1, 16)] and pairs[15:] == [(i + 3, i) for i in range(16, len(gapped) + 1)]
    assert sr.align("", "A") == [] and sr.align("AAA", "CCC") == []


def test_alignment_is_the_best():
    """Against all cells of the plain recursion, over strings long enough for many kept rows."""
    r = random.Random(1)
    for _ in range(40):
        a = "".join(r.choice("ACDE") for _ in range(r.randrange(1, 90)))
        b = list(a)
        del b[(k := r.randrange(len(b))) : k + r.randrange(0, 9)]
        for _ in range(r.randrange(0, 6)):
            b.insert(r.randrange(len(b) + 1), r.choice("ACDE"))
        b = "".join(b) or "A"
        h, e, f = ({} for _ in range(3))
        get = lambda t, *at: t.get(at, 0 if t is h else -(10**9))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                f[i, j] = max(get(h, i - 1, j) - 10, get(f, i - 1, j) - 1)
                e[i, j] = max(get(h, i, j - 1) - 10, get(e, i, j - 1) - 1)
                h[i, j] = max(0, get(h, i - 1, j - 1) + (2 if a[i - 1] == b[j - 1] else -1), e[i, j], f[i, j])
        pairs = sr.align(a, b)
        gaps = [d for p, q in zip(pairs, pairs[1:]) for d in (q[0] - p[0] - 1, q[1] - p[1] - 1) if d]
        assert sum(2 if a[i - 1] == b[j - 1] else -1 for i, j in pairs) - sum(9 + d for d in gaps) == max(h.values())


def test_assessment_and_mapping(spark, tmp_path):
    files = sr.structure_files(spark, write(tmp_path)).where("kind = 'pdb'")
    path = files.first().path
    chains, links = sr.chains(sr.residues(sr.atoms(files))), sr.file_links(files)
    hosts = spark.createDataFrame([(path, "HOMO SAPIENS")], "path string, host string")
    sites = spark.createDataFrame([("P", 2, SEQ, path, "1ABC"), ("P", 37, SEQ, path, "1ABC"), ("P", 5, SEQ, path, "1ABC"), ("P", 60, SEQ, path, "1ABC"), ("P", 2, SEQ, "nowhere", "2XYZ")], "accession string, position int, sequence string, path string, pdb_id string")
    got = {r.position: r for r in sr.assess(sites, chains, links, hosts).collect()}
    assert got[37].structure_tier == "structure_linked_glycan" and not got[37].structure_internal_control
    assert got[2].structure_tier == "structure_residue_resolved" and got[2].structure_internal_control and got[2].structure_n_available == 2
    assert got[5].structure_detail == "residue_mismatch:A" and not got[5].structure_internal_control
    assert got[60].structure_tier == "structure_residue_unresolved" and got[60].structure_detail == "position_not_in_model"
    rows = sr.map_sequons(spark.createDataFrame([("P", 2, SEQ, path, "A"), ("P", 3, SEQ, path, "A"), ("P", 39, SEQ, path, "A"), ("P", 2, None, path, "A"), ("P", 2, SEQ, path, "Z"), ("P", 2, SEQ, None, "A")], "accession string, position int, sequence string, path string, chain_id string"), chains).collect()
    good = [r for r in rows if r.exclusion_reason is None]
    assert len(rows) == 6 and len(good) == 1 and (good[0].triplet, good[0].subtype, good[0].n_model_index, good[0].plus2_resseq) == ("NKT", "NXT", 1, 4)
    assert sorted(r.exclusion_reason for r in rows if r.exclusion_reason) == ["chain_absent", "no_uniprot_sequence", "plus2_not_mapped", "structure_not_cached", "triplet_not_a_sequon"]


def test_environment(spark, tmp_path):
    rows = sr.residues(sr.atoms(sr.structure_files(spark, write(tmp_path)).where("kind = 'pdb'")))
    got = {r.resseq: r for r in sr.environment(rows).collect()}
    assert got[10].n_neighbours_8a == 4 and got[1].n_neighbours_8a == 2 and got[10].chain_length_resolved == 40 and got[38].distance_to_chain_terminus == 2
    near = [SEQ[i - 1] for i in (8, 9, 11, 12)]
    assert math.isclose(got[10].hydrophobic_fraction_8a, sum(a in "ACFILMVWY" for a in near) / 4)


AREA_ROWS = "path string, chain_id string, resseq int, icode string, resname string, atom string, element string, x double, y double, z double"


def test_accessible_area(spark):
    at = lambda i, x, path="s", atom="CA": (path, "A", i, "", "ALA", atom, "C", x, 0.0, 0.0)
    rows = spark.createDataFrame([at(1, 0.0), at(2, 3.0), at(2, 3.0), at(1, 0.0, "alone"), at(1, None, "void"), at(1, 5.0, "same"), at(2, 5.0, "same")], AREA_ROWS)
    got = {(r.path, r.resseq): r.sasa for r in sr.residue_areas(rows, 2000).collect()}
    whole = 4 * math.pi * 3.1**2
    cap = whole * (1 + 1.5 / 3.1) / 2
    assert math.isclose(got[("alone", 1)], whole) and math.isclose(got[("same", 1)], whole) and math.isclose(got[("same", 2)], whole)
    assert abs(got[("s", 1)] - cap) < 0.01 * cap and abs(got[("s", 2)] - cap) < 0.01 * cap and len(got) == 5
    assert sr.residue_areas(rows.limit(0)).count() == 0


def test_areas_of_a_crowd_against_all_pairs(spark):
    """Random atoms of five elements over many cells, on both sides of zero, in two structures that don't touch."""
    r = random.Random(5)
    kinds = ("C", "N", "O", "S", "X")
    rows = [(f"s{k % 2}", "AB"[k % 3 == 0], k // 4, "", "ALA", f"A{k}", kinds[k % 5], *(round(r.uniform(-14, 14), 3) for _ in range(3))) for k in range(600)]
    got = {(a.path, a.chain_id, a.resseq): a.sasa for a in sr.residue_areas(spark.createDataFrame(rows, AREA_ROWS)).collect()}
    dots, want = sr.sphere(100), {}
    for own in rows:
        reach, centre = sr.RADII.get(own[6], 1.7) + 1.4, np.array(own[7:])
        free = np.ones(100, bool)
        for other in rows:
            if other is not own and other[0] == own[0]:
                free &= ((centre + dots * reach - np.array(other[7:])) ** 2).sum(axis=1) >= (sr.RADII.get(other[6], 1.7) + 1.4) ** 2
        want[own[:3]] = want.get(own[:3], 0.0) + 4 * math.pi * reach**2 * free.mean()
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_pairs_of_sites_are_made_once(spark):
    """Sites of several structures, of none, and repeated rows: the pairs of the plain join, each once."""
    r = random.Random(4)
    rows = [(f"P{r.randrange(4)}", r.randrange(3), r.choice(["s1", "s2", "s3", None]), r.choice([v.OCCUPIED, v.UNMODIFIED])) for _ in range(60)]
    rows += rows[:10]
    a, b = ({x[:3] for x in rows if x[3] == s} for s in (v.OCCUPIED, v.UNMODIFIED))
    same = lambda p, q: None if p is None or q is None else p == q
    want = {(x[0], *x[:2], *y[:2], same(x[2], y[2])) for x in a for y in b if x[0] == y[0]}
    want |= {(f"{x[0]}|{y[0]}", *x[:2], *y[:2], True) for x in a for y in b if x[0] != y[0] and same(x[2], y[2])}
    found = sr.within_structure_pairs(spark.createDataFrame(rows, "accession string, position int, structure_pdb_id string, occupancy_status string"))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({x[5] for x in got}) == 3
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_many_structures_are_made_by_many_tasks(spark):
    """Sites take few bytes and their pairs many, so structures aren't put together by their bytes."""
    rows = [(f"P{i}", 1, f"s{i % 40}", v.OCCUPIED if i // 40 % 2 else v.UNMODIFIED) for i in range(800)]
    found = sr.within_structure_pairs(spark.createDataFrame(rows, "accession string, position int, structure_pdb_id string, occupancy_status string"))
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 40 * 10 * 10 and len(parts) > 1


def test_equal_and_known_pairs_are_aligned_once(monkeypatch):
    calls, real = [], sr.align
    monkeypatch.setattr(sr, "align", lambda s, t: calls.append(1) or real(s, t))
    sr._known_pair.cache_clear()
    r = random.Random(3)
    words = ["".join(r.choice("ACDN") for _ in range(30)) for _ in range(5)]
    a, b = pd.Series([w for w in words for _ in range(20)] + [None, ""]), pd.Series([w for w in words for _ in range(10) for w in (w, w[:7] + "#" + w[8:])] + ["A", None])
    got = sr._aligned(a, b)
    assert len(calls) <= 7
    for s, t, pairs in zip(a, b, got["pairs"]):
        assert pairs == dict(real(s or "", t or ""))


def test_neighbours_and_spheres_are_never_broadcast(spark):
    atoms = spark.createDataFrame([("f", 1, "A", i, "", "ASN", "CA", "C", False, 3.8 * i, 0.0, 0.0) for i in range(5)], sr.ATOM)
    for rows in (sr.environment(sr.residues(atoms)), sr.residue_areas(atoms)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def counted(spark, column, kind="double"):
    """The column through a function that counts its calls, and the count."""
    calls = spark.sparkContext.accumulator(0)

    def same(value):
        calls.add(1)
        return value

    return F.udf(same, kind)(column), calls


def test_environment_reads_its_residues_once_and_misses_none(spark):
    """Points at random and on the borders of cells, on both sides of zero, against all pairs."""
    places = random.Random(3)
    points = [tuple(places.uniform(-20, 20) for _ in "xyz") for _ in range(60)] + [(8.0 * i, 8.0 * j, -16.0) for i in range(-2, 3) for j in (-1, 0, 1)]
    rows = spark.createDataFrame([("f", "A", i, "", "LDG"[i % 3], *p) for i, p in enumerate(points)], "path string, chain_id string, resseq int, icode string, aa string, x double, y double, z double")
    column, calls = counted(spark, "x")
    got = {r.resseq: r for r in sr.environment(rows.withColumn("x", column)).collect()}
    near = [[j for j, q in enumerate(points) if j != i and math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) <= 8.0] for i, p in enumerate(points)]
    assert [got[i].n_neighbours_8a for i in range(len(points))] == [len(js) for js in near]
    assert [got[i].hydrophobic_fraction_8a for i in range(len(points))] == [sum("LDG"[j % 3] in v.HYDROPHOBIC for j in js) / len(js) if js else None for js in near]
    assert calls.value == len(points)


def test_bonds_of_a_loop_with_few_columns():
    """Blank where a column isn't there; the label's name goes before the author's."""
    head = "data_x\nloop_\n_struct_conn.conn_type_id\n_struct_conn.ptnr1_label_comp_id\n_struct_conn.ptnr1_auth_comp_id\n_struct_conn.ptnr1_auth_seq_id\n"
    assert list(sr.cif_bonds(head + "COVALE ASN XXX 5\nmetalc ASN XXX 6\n#\n")) == [(("ASN", "", "5", ""), ("", "", "", ""))]
    assert list(sr.cif_bonds("data_x\n")) == []


def test_pairs_of_a_structure_repeat_their_sites_soon(spark):
    """A site comes again within ROW rows, and a pair of proteins in runs, so that a column's pages stay small however many sites there are."""
    rows = [(f"{s}{i}", n, "1abc", status) for s, status in (("a", v.OCCUPIED), ("b", v.UNMODIFIED)) for i in range(3) for n in range(64)]
    found = sr.within_structure_pairs(spark.createDataFrame(rows, "accession string, position int, structure_pdb_id string, occupancy_status string"))
    placed = found.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).orderBy("at").collect()
    assert len({(x.group_id, x.position_occ, x.position_unm) for x in placed}) == len(placed) == 192 * 192
    last, gaps = {}, []
    for n, x in enumerate(placed):
        site = (x.part, x.accession_unm, x.position_unm)
        gaps.append(n - last[site] if site in last else None)
        last[site] = n
    known = [g for g in gaps if g is not None]
    assert sum(g <= sr.ROW for g in known) > 0.9 * len(known)
    assert sum(x.group_id != y.group_id for x, y in zip(placed, placed[1:])) < len(placed) / 50
