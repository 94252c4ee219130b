import gzip
import json

from test_structures import SEQ, atom, link

from siteloom.cli import main

CONFIG = """[paths]
pairs_master = "pairs.csv"
homology_qc = "homology.csv"
uniprot_tsv = "proteins.tsv.gz"
structure_manifest = "structures.csv"
structure_dir = "structures"
results_dir = "out"
cache_dir = "cache"
[layers]
glygen = true
structure = true
[policy]
qualifying_uniprot_tiers = ["manual_experimental"]
strict_buckets = ["strict"]
plausible_buckets = ["plausible"]
"""


def test_run(spark, tmp_path, capsys):
    (tmp_path / "config.toml").write_text(CONFIG)
    args = ["--config", str(tmp_path / "config.toml")]
    assert main(["validate", *args]) == 1 and main(["run", *args], spark) == 1
    (tmp_path / "pairs.csv").write_text("pair_id,pos_accession,best_loss_positive_position,analysis_ready,cluster_id\na,P1,10,True,c\nb,P1,20,True,c\nc,P2,5,True,d\nd,P3,1,False,d\ne,P4,37,True,d\nf,P4,2,True,d\n")
    (tmp_path / "homology.csv").write_text("pair_id,homology_qc_bucket\na,strict\nb,plausible\n")
    with gzip.open(tmp_path / "proteins.tsv.gz", "wt") as f:
        f.write(f'Entry\tSequence\tGlycosylation\nP1\tM\tCARBOHYD 10; /note=N-linked asparagine /note="N-linked (GlcNAc...) asparagine"; /evidence=ECO:0000269\nP4\t{SEQ}\t\n')
    for folder in ("cache/pdb", "structures"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "cache/glygen_protein_detail.jsonl").write_text(json.dumps({"accession": "P2", "detail": {"glycosylation": [{"type": "N-linked", "start_pos": 5, "end_pos": 5, "site_category": "reported_with_glycan"}]}}) + "\n")
    (tmp_path / "structures.csv").write_text("accession,pdb_id,output_path,status,all_pdb_ids\nP4,1ABC,/gone/1ABC.pdb,ok,1abc;2xyz\nP1,9ZZZ,/gone/9ZZZ.pdb,failed,\n")
    body = ["SOURCE   2 EXPRESSION_SYSTEM: HOMO SAPIENS;"] + [atom(i + 1, a, x=3.8 * i) for i, a in enumerate(SEQ)]
    (tmp_path / "structures/1ABC.pdb").write_text("\n".join([body[0], link(seq=2, other=" CA"), link(seq=2, other="GLY"), *body[1:]]))
    (tmp_path / "cache/pdb/2XYZ.pdb").write_text("\n".join([body[0], link(seq=37), *body[1:]]))
    capsys.readouterr()
    assert main(["run", *args], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["counts"] == {"combined": 5, "all": 3, "strict": 1, "strict_plus_plausible": 1, "excluded": 2, "curator": 0}
    assert report["layer_support"] == {"n_uniprot": 1, "n_glygen": 1, "n_glyconnect": 0, "n_structure": 1} and report["baseline"]["candidate_sites"] == 5
    assert json.loads((tmp_path / "out/provenance.json").read_text())["counts"]["combined"] == 5
    rows = {(r.accession, r.position): r for r in spark.read.option("header", True).csv(f"{tmp_path}/out/combined").collect()}
    assert rows["P4", "37"].structure_pdb_id == "2XYZ" and rows["P4", "37"].occupancy_status == "occupied_supported"
    assert rows["P4", "2"].structure_tier == "structure_residue_resolved" and rows["P4", "2"].structure_internal_control == "false" and rows["P1", "10"].structure_detail == "no_cached_structure"
    (tmp_path / "config.toml").write_text(CONFIG + "observed_unmodified_from_internal_contrl = false\n")
    assert main(["run", *args], spark) == 1 and "observed_unmodified_from_internal_contrl is no key" in capsys.readouterr().out
    assert main(["models"]) == 0 and "proteinmpnn" in capsys.readouterr().out
