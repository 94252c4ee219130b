import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from siteloom import schemas
from siteloom import config
from siteloom.config import variant_path, variant_suffix
from siteloom.operators.sites import MODEL_KEY
from siteloom.sources import readers as rd
from siteloom.sources import sinks as sk
from siteloom.streaming import resume


def test_csv_and_nan(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pair_id,extra,pos_accession,best_loss_positive_position,analysis_ready\na,1,P1,10.0,True\nb,2,P2,NaN,\n")
    rows = rd.read_csv(spark, str(tmp_path / "p.csv"), schemas.PAIRS).orderBy("pair_id").collect()
    assert (rows[0].best_loss_positive_position, rows[0].analysis_ready, rows[0].source) == (10.0, True, None)
    assert rows[1].best_loss_positive_position is None and rows[1].analysis_ready is None


def test_cache_last_line_wins(spark, tmp_path):
    lines = [{"accession": "P", "detail": {"glycosylation": [{"type": "N-linked", "start_pos": 1, "end_pos": 1, "site_category": "reported"}]}}, {"accession": "Q", "detail": None, "error": "x"}, {"accession": "P", "detail": {"glycosylation": [{"type": "N-linked", "start_pos": 2, "end_pos": 2, "site_category_dict": {"predicted": True}, "evidence": [{"database": "PubMed", "id": "7"}]}]}}]
    (tmp_path / "c.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    (r,) = rd.glycan_entries(rd.read_cache(spark, str(tmp_path / "c.jsonl"), schemas.GLYCAN_DETAIL)).collect()
    assert (r.start_pos, r.categories, r.evidence[0].id) == (2, ["predicted"], "7")
    assert rd.read_cache(spark, str(tmp_path / "none.jsonl"), schemas.GLYCAN_DETAIL).count() == 0


def test_structure_manifest(spark):
    files = spark.createDataFrame([("file:/d/x.pdb", 5), ("file:/d/z.pdb", 0)], "path string, length long")
    rows = spark.createDataFrame([("P", "X", "/old/x.pdb", "ok", "X;Y", 1), ("Q", "Z", "/d/z.pdb", "ok", "", 2), ("R", "X", "/d/x.pdb", "failed", "", 3)], schemas.STRUCTURE_MANIFEST + ", line_no int")
    (r,) = rd.structure_manifest(rows, files, "line_no").collect()
    assert (r.accession, r.path) == ("P", "file:/d/x.pdb")
    with pytest.raises(rd.StructureManifestError):
        rd.structure_manifest(rows.where("accession = 'Q'"), files, "line_no")
    assert [x.pdb_id for x in rd.wanted_structures(rows.where("accession = 'P'")).collect()] == ["Y"]


def test_pages_and_fetch():
    bodies = {"u1": ("h\na\nb\n", '<u2>; rel="next"'), "u2": ("h\nc\n", "")}
    assert list(rd.pages("u1", bodies.__getitem__)) == ["h", "a", "b", "c"] and list(rd.pages("u1", bodies.__getitem__, limit=2)) == ["h", "a", "b"]
    calls, out = [], []

    def get(accession):
        calls.append(accession)
        if accession == "gone":
            raise urllib.error.HTTPError("u", 404, "no", None, None)
        if accession == "flaky" and calls.count("flaky") < 3:
            raise urllib.error.URLError("later")
        return {"id": accession}

    assert rd.fetch_details(["gone", "flaky", "known"], {"known"}, get, out.append) == {"requested": 2, "fetched": 1, "failed": 1}
    assert calls.count("gone") == 1 and calls.count("flaky") == 3 and json.loads(out[0])["detail"] == {"id": "flaky"}
    assert rd.two_step(lambda a: {"hits": [{"id": 3}]}, lambda i: {"got": i})("P") == {"got": "3"}
    with pytest.raises(ValueError):
        rd.two_step(lambda a: {"hits": []}, None)("P")


def test_append_resumes_and_stream(spark, tmp_path):
    schema = "accession string, position int, structure_pdb_id string, structure_chain_id string, score double"
    first = spark.createDataFrame([("P", 1, "s", "A", 1.0)], schema)
    both = spark.createDataFrame([("P", 1, "s", "A", 9.0), ("Q", 2, "s", "A", 2.0)], schema)
    out = str(tmp_path / "out")
    sk.append_new(first, out)
    sk.append_new(both, out)
    assert sorted((r.accession, r.score) for r in sk.settled(spark, out).collect()) == [("P", 1.0), ("Q", 2.0)]
    both.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        resume.follow(spark, str(tmp_path / "in"), schema, lambda r: r, str(tmp_path / "s"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).select(*MODEL_KEY).distinct().count() == spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_interleaved_and_killed_appends(spark, tmp_path, monkeypatch):
    """Run B adds its rows between the check and the claim of run A; run C dies before its claim, run D after it."""
    out, keys, real = str(tmp_path / "t"), ("accession",), sk.moved
    rows = lambda run, *keys: spark.createDataFrame([(k, run) for k in keys], "accession string, run string")

    def at_claim(do):
        def move(session, source, target):
            if "/_log/" in target:
                monkeypatch.setattr(sk, "moved", real)
                do()
            return real(session, source, target)

        monkeypatch.setattr(sk, "moved", move)

    def killed(*_):
        raise KeyboardInterrupt

    held = lambda: sorted((r.accession, r.run) for r in spark.read.parquet(out).collect())
    at_claim(lambda: sk.append_new(rows("B", "q", "r"), out, keys))
    sk.append_new(rows("A", "p", "q"), out, keys)
    assert held() == [("p", "A"), ("q", "B"), ("r", "B")]
    at_claim(killed)
    with pytest.raises(KeyboardInterrupt):
        sk.append_new(rows("C", "s", "t"), out, keys)
    assert len(held()) == 3
    published = sk._published
    monkeypatch.setattr(sk, "_published", lambda session, path: killed() if len(sk.names(session, f"{path}/_log")) > 2 else published(session, path))
    with pytest.raises(KeyboardInterrupt):
        sk.append_new(rows("D", "t", "u", "p"), out, keys)
    monkeypatch.setattr(sk, "_published", published)
    assert len(held()) == 3 and sk.names(spark, f"{out}/_log")[-1] == f"{3:012d}"
    for _ in range(2):
        sk.append_new(rows("E", "p", "s", "t", "u", "v"), out, keys)
    want = [("p", "A"), ("q", "B"), ("r", "B"), ("s", "E"), ("t", "D"), ("u", "D"), ("v", "E")]
    assert held() == want == sorted((r.accession, r.run) for r in sk.settled(spark, out, keys).collect())
    sk.append_new(rows("F", "w").limit(0), out, keys)
    assert held() == want


def test_csv_sink_reports_and_config(spark, tmp_path):
    sk.write_csv(spark.createDataFrame([("P2", 1), ("P1", 5), ("P1", 2), (None, 1)], "accession string, position int"), str(tmp_path / "o"))
    (f,) = (tmp_path / "o").glob("part*.csv")
    assert f.read_text().split() == ["accession,position", "P1,2", "P1,5", "P2,1", ",1"] or f.read_text().split()[1:4] == ["P1,2", "P1,5", "P2,1"]
    (tmp_path / "c.toml").write_text('[paths]\npairs_master = "o"\nuniprot_tsv = "nope"\nresults_dir = "later"\nodd = "o"\n[policy]\nglyconnect_qualifes = true\nstrict_buckets = "a"\nqualifying_structure_tiers = ["no_tier"]\n[more]\nx = 1\n')
    c = config.read(tmp_path / "c.toml")
    assert c["paths"]["pairs_master"] == (tmp_path / "o").resolve() and c["policy"]["observed_unmodified_from_internal_control"] is True
    found = config.problems(c)
    assert len(found) == 6 and [p.split(" ")[0] for p in found] == ["[more]", "[paths]", "[paths]", "[policy]", "[policy]", "[policy]"] and "nope" in " ".join(found)
    (tmp_path / "d.toml").write_text('# the same\n[layers]\n\n[more]\nx = 1\n[policy]\nqualifying_structure_tiers = ["no_tier"]\nstrict_buckets = "a"\nglyconnect_qualifes = true\n[paths]\nodd = "o"\nresults_dir = "later"\nuniprot_tsv = "nope"\npairs_master = "o"\n')
    assert config.read(tmp_path / "d.toml")["digest"] == c["digest"] != config.read_text("")["digest"]
    assert variant_suffix("_a_") == "_a" and variant_suffix(" ") == "" and variant_path("r/", "t", "b") == "r/t_b"
    p = sk.provenance({"c": str(tmp_path / "c.toml"), "gone": "x"}, c["digest"], {"n": 1})
    assert list(p["inputs"]) == ["c"] and len(p["inputs"]["c"]["sha256"]) == 64
    assert sk.file_digests(spark, str(tmp_path / "c.toml")).first().sha256 == p["inputs"]["c"]["sha256"]
    assert sk.report(spark.range(3).agg(F.count("*").alias("n"))) == {"n": 3}


def test_ordered_file_of_many_parts(spark, tmp_path):
    """The same bytes whatever the partitions, with ties, nulls and quoted values; several tasks write it; gzip reads as one."""
    import gzip
    import json
    import random

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small as they are, ranges stay apart
    r = random.Random(1)
    rows = [(r.choice(("P1", "P2", 'a,"b', None)), r.choice((None, *range(30))), f"v{i % 17}") for i in range(3000)]
    seen = []
    for n, order in ((1, 1), (7, -1)):
        frame = spark.createDataFrame(rows[::order], "accession string, position int, v string").repartition(n)
        sk.write_csv(frame, str(tmp_path / f"o{n}"))
        sk.write_csv(frame, str(tmp_path / f"z{n}"), "gzip")
        (plain,), (zipped,) = (list((tmp_path / f"{k}{n}").glob("part-*")) for k in "oz")
        seen.append(plain.read_bytes())
        assert gzip.decompress(zipped.read_bytes()) == seen[-1]
        parts = json.loads((tmp_path / f"o{n}" / "_manifest.json").read_text())["parts"]
        assert (len(parts) > 1) == (n > 1) and parts[-1]["start"] + parts[-1]["bytes"] == len(seen[-1]) and not (tmp_path / f"o{n}" / "_parts").exists()
    assert seen[0] == seen[1] and seen[0].startswith(b"accession,position,v\n") and seen[0].count(b"\n") == 3001
    back = spark.read.option("header", True).schema("accession string, position int, v string").option("escape", "\\").csv(str(tmp_path / "o7"))
    key = lambda x: tuple((v is None, v) for v in x)
    assert [tuple(x) for x in back.collect()] == sorted(rows, key=key)
    sk.write_csv(spark.createDataFrame([], "b string"), str(tmp_path / "e"))
    assert (tmp_path / "e" / "part-00000.csv").read_text() == "b\n"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_numbers_of_a_file_read_in_blocks(spark):
    """A written file is read in several blocks, the largest first: lines still count from its start."""
    from siteloom.plans import catalogue

    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = catalogue.queries()["SNK1"](spark, "/root/testdata/sf0.001").collect()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    by_line = sorted((r.line, r.accession, r.position) for r in rows)
    assert [x[0] for x in by_line] == list(range(1, len(rows) + 1)) and len(rows) > 700
    assert [x[1:] for x in by_line] == sorted(x[1:] for x in by_line)
