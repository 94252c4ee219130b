"""Structure files: parsing, alignment, site assessment, residue environment, index mapping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import exprs as x
from siteloom.functions import vocab as v
from siteloom.operators.graph import cut
from siteloom.operators.ranks import seeded

CHAIN = "path string, pdb_id string, chain_id string, sequence string, residue_ids array<struct<resseq:int,icode:string>>"
ATOM = "path string, model int, chain_id string, resseq int, icode string, resname string, atom string, element string, hetero boolean, x double, y double, z double"
MIN_COVERAGE, MIN_ALIGNED, IDENTITY_SLACK = 0.5, 30, 0.02
#: Files whose atoms a task holds at a time; letters of a pair whose alignment it remembers, and of how many pairs.
FILES, SHORT, KNOWN = 100, 400, 1024


def named(listing: DataFrame) -> DataFrame:
    """FLT16: files (path, length, ...) that aren't oversized or empty, with their stem and kind."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing.where((F.col("length") <= v.MAX_STRUCTURE_BYTES) & (F.col("length") > 0)).withColumns({"stem": F.upper(F.regexp_replace(name, r"\.[^.]*$", "")), "kind": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def structure_files(spark, path: str, glob: str = "*.{pdb,cif,mmcif}") -> DataFrame:
    """path, length, content, stem and kind of the files to read; the size is known before any content is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return named(files).select("path", "length", "content", "stem", "kind")


def indexed(files: DataFrame, dirs: list[str]) -> DataFrame:
    """SRC7: one path a stem: earlier folders first, .pdb before the others."""
    rank = F.coalesce(*(F.when(F.col("path").contains(d), F.lit(i)) for i, d in enumerate(dirs)), F.lit(len(dirs)))
    order = F.struct(rank, (F.col("kind") != "pdb").cast("int"), "path")
    return files.groupBy("stem").agg(F.min_by("path", order).alias("path"))


def link_records(lines: DataFrame) -> DataFrame:
    """The bonds (path, a, b) of the LINK lines of (path, value); fields stand in fixed columns."""
    # Where the record's two residues have their name, chain, number and insertion code.
    first, second = ((18, 3), (22, 1), (23, 4), (27, 1)), ((48, 3), (52, 1), (53, 4), (57, 1))
    side = lambda columns: F.struct(*(F.trim(F.substring("value", *at)).alias(c) for c, at in zip(("name", "chain", "seq", "icode"), columns)))
    return lines.where(F.col("value").startswith("LINK")).select("path", side(first).alias("a"), side(second).alias("b"))


def glycan_links(bonds: DataFrame) -> DataFrame:
    """SRC9, SRC10: bonds (path, a, b) -> one row for each whose one side is an asparagine and the other a glycan.

    A bond to a metal, or to another amino acid, says nothing of glycosylation. Where both readings hold,
    the first side is the site.
    """
    read = F.array(F.struct(F.col("a").alias("site"), F.col("b").alias("sugar")), F.struct(F.col("b").alias("site"), F.col("a").alias("sugar")))
    good = F.filter(read, lambda r: (r["site"]["name"] == "ASN") & r["sugar"]["name"].isin(*v.GLYCANS) & r["site"]["seq"].rlike("^-?[0-9]+$"))
    rows = bonds.select("path", F.get(good, F.lit(0)).alias("r")).where("r is not null")
    return rows.select("path", F.col("r.site.chain").alias("chain_id"), F.col("r.site.seq").try_cast("int").alias("resseq"), x.clean_icode(F.col("r.site.icode")).alias("icode"), F.col("r.sugar.name").alias("glycan_resname")).where("resseq is not null")


def cif_loops(text: str) -> Iterator[tuple[list[str], list[list[str]]]]:
    """The loops of an mmCIF text, as (names, rows); single items count as loops of one row."""
    import re

    tokens, block = [], []
    inside = False
    for line in text.splitlines():
        if line.startswith(";"):
            inside = not inside
            if inside:
                block = [line[1:]]
            else:
                tokens.append("\x00" + "\n".join(block))
            continue
        if inside:
            block.append(line)
            continue
        tokens += ["\x00" + (m[1] if m[1] is not None else m[2]) if m[3] is None else m[3] for m in re.finditer(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(#.*|\S+)", line) if not (m[3] or "").startswith("#")]
    i = 0
    while i < len(tokens):
        if tokens[i].lower() == "loop_":
            i += 1
            names = []
            while i < len(tokens) and tokens[i].startswith("_"):
                names.append(tokens[i])
                i += 1
            values = []
            while i < len(tokens) and not tokens[i].startswith("_") and tokens[i].lower() != "loop_" and not tokens[i].lower().startswith("data_"):
                values.append(tokens[i].removeprefix("\x00"))
                i += 1
            if names:
                yield names, [values[k : k + len(names)] for k in range(0, len(values) - len(names) + 1, len(names))]
        elif tokens[i].startswith("_") and i + 1 < len(tokens):
            yield [tokens[i]], [[tokens[i + 1].removeprefix("\x00")]]
            i += 2
        else:
            i += 1


def cif_table(text: str, prefix: str) -> dict[str, list[str]]:
    """Columns of one category; items outside a loop are columns of one row."""
    out: dict[str, list[str]] = {}
    for names, rows in cif_loops(text):
        if names[0].startswith(prefix + "."):
            for k, name in enumerate(names):
                out[name.split(".", 1)[1]] = [r[k] for r in rows]
    return out


def cif_bonds(text: str) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """The covalent bonds of an mmCIF text: both sides as name, chain, number and insertion code, in the author's numbering.

    Names of residues are the label's where it has them, else the author's; a column that isn't there is blank.
    """
    table = cif_table(text, "_struct_conn")

    def side(k: int) -> list[list[str]]:
        names = (f"ptnr{k}_label_comp_id", f"ptnr{k}_auth_comp_id"), (f"ptnr{k}_auth_asym_id",), (f"ptnr{k}_auth_seq_id",), (f"pdbx_ptnr{k}_PDB_ins_code",)
        return [next((table[n] for n in those if n in table), []) for those in names]

    sides = side(1), side(2)
    for i, kind in enumerate(table.get("conn_type_id", ())):
        if kind.lower() == "covale":
            yield tuple(tuple(c[i].strip() if i < len(c) else "" for c in columns) for columns in sides)


def file_bonds(files: DataFrame) -> DataFrame:
    """Bonds of all files, whatever their kind."""
    lines = files.where("kind = 'pdb'").select("path", F.explode(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("value"))

    def run(batches):
        for pdf in (b[i : i + FILES] for b in batches for i in range(0, len(b), FILES)):
            rows = [(path, *a, *b) for path, content in zip(pdf["path"], pdf["content"]) for a, b in cif_bonds(bytes(content).decode("utf-8", "ignore"))]
            yield pd.DataFrame(rows, columns=["path", *columns])

    fields = ("name", "chain", "seq", "icode")
    columns = [f"{s}_{c}" for s in "ab" for c in fields]
    side = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(c) for c in fields)).alias(s)
    bonds = files.where("kind <> 'pdb'").select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{c} string" for c in columns))
    return link_records(lines).unionByName(bonds.select("path", side("a"), side("b")))


def file_links(files: DataFrame) -> DataFrame:
    """SRC9, SRC10: glycan links of all files."""
    return glycan_links(file_bonds(files))


def file_hosts(files: DataFrame) -> DataFrame:
    """SRC12: (path, host), blank where none is stated."""
    return files.select("path", x.expression_system(F.decode("content", "utf-8")).alias("host"))


def atoms(files: DataFrame) -> DataFrame:
    """SRC11: one row an atom, first model only, from fixed columns or the atom loop."""
    every = F.split(F.decode("content", "utf-8"), "\r?\n")
    end = F.array_position(F.transform(every, lambda line: line.startswith("ENDMDL")), True).cast("int")
    lines = files.where("kind = 'pdb'").select("path", F.explode(F.when(end > 0, F.slice(every, F.lit(1), end)).otherwise(every)).alias("value"))
    field = lambda a, n: F.trim(F.substring("value", a, n))
    pdb = lines.where(F.col("value").rlike("^(ATOM  |HETATM)") & field(17, 1).isin("", "A"))
    pdb = pdb.select("path", F.lit(1).alias("model"), F.substring("value", 22, 1).alias("chain_id"), field(23, 4).try_cast("int").alias("resseq"), field(27, 1).alias("icode"), field(18, 3).alias("resname"), field(13, 4).alias("atom"), field(77, 2).alias("element"), F.col("value").startswith("HETATM").alias("hetero"), *(field(c, 8).try_cast("double").alias(n) for c, n in ((31, "x"), (39, "y"), (47, "z"))))

    def run(batches):
        for pdf in (b[i : i + FILES] for b in batches for i in range(0, len(b), FILES)):
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                t = cif_table(bytes(content).decode("utf-8", "ignore"), "_atom_site")
                first = t.get("pdbx_PDB_model_num", ["1"])[:1]
                for i in range(len(t.get("Cartn_x", []))):
                    get = lambda c, d="", i=i, t=t: t[c][i] if c in t else d
                    if get("pdbx_PDB_model_num", "1") == first[0] and get("label_alt_id", ".") in (".", "?", "A"):
                        code = get("pdbx_PDB_ins_code")
                        rows.append((path, 1, get("auth_asym_id"), int(get("auth_seq_id", "0")), "" if code in ("?", ".") else code, get("auth_comp_id"), get("label_atom_id"), get("type_symbol"), get("group_PDB") == "HETATM", float(get("Cartn_x")), float(get("Cartn_y")), float(get("Cartn_z"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ATOM.split(", ")])

    return pdb.unionByName(files.where("kind <> 'pdb'").select("path", "content").mapInPandas(run, ATOM))


def residues(atom_rows: DataFrame) -> DataFrame:
    """Amino acids with an alpha carbon: its place, one-letter code."""
    known = F.col("resname").isin(list(v.THREE_TO_ONE)) | ~F.col("hetero")
    return atom_rows.where((F.col("atom") == "CA") & known & F.col("resseq").isNotNull()).select("path", "chain_id", "resseq", "icode", x.residue_code(F.col("resname")).alias("aa"), "x", "y", "z").groupBy("path", "chain_id", "resseq", "icode").agg(F.min(F.struct("aa", "x", "y", "z")).alias("r")).select("path", "chain_id", "resseq", "icode", "r.*")


def chains(residue_rows: DataFrame) -> DataFrame:
    """SRC11: sequence and residue ids of each chain, in residue order."""
    own = F.array_sort(F.collect_list(F.struct("resseq", "icode", "aa")))
    rows = residue_rows.groupBy("path", "chain_id").agg(own.alias("r"))
    return rows.select("path", "chain_id", F.array_join(F.transform("r", lambda r: r["aa"]), "").alias("sequence"), F.transform("r", lambda r: F.struct(r["resseq"].alias("resseq"), r["icode"].alias("icode"))).alias("residue_ids"))


@dataclass(frozen=True)
class Costs:
    match: int = 2
    mismatch: int = -1
    opening: int = -10
    extend: int = -1

    def row(self, above: tuple[np.ndarray, np.ndarray], same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores that end at each place of a row: any way, with a gap along the row, with one down to it."""
        h, f = above
        down = np.maximum(h + self.opening, f + self.extend)
        pair = h[:-1] + np.where(same, self.match, self.mismatch)
        closed = np.concatenate(([0], np.maximum(np.maximum(0, down[1:]), pair)))
        # gaps along the row: best over earlier starts, as a running maximum
        steps = np.arange(len(closed))
        along = np.full(len(closed), -(10**9))
        along[1:] = np.maximum.accumulate(closed - self.extend * steps)[:-1] + self.opening + self.extend * (steps[1:] - 1)
        return np.maximum(closed, along), along, down


def align(a: str, b: str, costs: Costs = Costs()) -> list[tuple[int, int]]:
    """JN22: 1-based aligned pairs of the best local alignment with affine gaps.

    A gap of length n costs opening + (n - 1) x extend. Among equal scores the end of least a, then least
    b, is taken, and a pair is preferred to a gap on the way back. One row in each square root of their
    number is kept on the way there and the rows between two of them are found again on the way back, so
    memory grows by the power 1.5 of the length and no pair is too long.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    ca, cb = np.array(list(a)), np.array(list(b))
    every = max(16, math.isqrt(n))
    rows = np.zeros(m + 1, np.int64), np.full(m + 1, -(10**9))
    kept, best = [rows], (0, 0, 0)
    for i in range(1, n + 1):
        h, _, f = costs.row(rows, cb == ca[i - 1])
        rows = h, f
        j = int(h.argmax())
        if h[j] > best[0]:
            best = int(h[j]), i, j
        if i % every == 0:
            kept.append(rows)
    _, i, j = best
    out, state, block, low = [], "any", [], n + 1
    while i and (state != "any" or block == [] or block[i - low][0][j] > 0):
        if i <= low:
            low = (i - 1) // every * every
            rows = kept[low // every]
            block = [(rows[0], None, rows[1])]
            for r in range(low, min(low + every, n)):
                h, along, down = costs.row(rows, cb == ca[r])
                rows = h, down
                block.append((h, along, down))
            continue
        (h, along, down), above = block[i - low], block[i - low - 1][0]
        if state == "any":
            if j and h[j] == above[j - 1] + (costs.match if ca[i - 1] == cb[j - 1] else costs.mismatch):
                out.append((i, j))
                i, j = i - 1, j - 1
            else:
                state = "down" if h[j] == down[j] else "along"
        elif state == "down":
            state = "any" if down[j] == above[j] + costs.opening else "down"
            i -= 1
        else:
            state = "any" if along[j] == h[j - 1] + costs.opening else "along"
            j -= 1
    return out[::-1]


ALIGNED = "identity double, coverage_chain double, coverage_uniprot double, n_aligned int, pairs map<int,int>"


def _pair(s: str, t: str) -> tuple:
    if s == t:  # place by place: nothing else matches all letters
        return (1.0, 1.0, 1.0, len(s), {i: i for i in range(1, len(s) + 1)}) if s else (0.0, 0.0, 0.0, 0, {})
    pairs = align(s, t)
    same = sum(s[i - 1] == t[j - 1] for i, j in pairs)
    return (same / len(pairs), len({j for _, j in pairs}) / len(t), len({i for i, _ in pairs}) / len(s), len(pairs), dict(pairs)) if pairs else (0.0, 0.0, 0.0, 0, {})


_known_pair = lru_cache(KNOWN)(_pair)


def _aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for s, t in zip(a, b):
        s, t = s or "", t or ""
        rows.append((_known_pair if len(s) + len(t) <= SHORT else _pair)(s, t))
    return pd.DataFrame(rows, columns=["identity", "coverage_chain", "coverage_uniprot", "n_aligned", "pairs"])


def aligned(a: str, b: str) -> Column:
    """JN22 as a column: identity, coverages, and the map from positions of a to places in b."""
    return F.pandas_udf(_aligned, ALIGNED)(a, b)


def assess(sites: DataFrame, chain_rows: DataFrame, links: DataFrame, hosts: DataFrame) -> DataFrame:
    """JN6, FN23, FN24, SRT5, SRT6, CMP4: the best structure record of each site.

    sites (accession, position, sequence, path, pdb_id); chain_rows from chains(); links from
    file_links(); hosts (path, host). Each protein is aligned to each of its chains once. A chain is
    credible from half of it and 30 residues aligned; of credible chains within 0.02 of the best identity,
    a linked one comes first. Without a credible chain the best is reported, never a glycan.
    """
    key = ["accession", "position"]
    proteins = sites.select("accession", "sequence", "path", "pdb_id").distinct().join(chain_rows.withColumnRenamed("sequence", "chain_sequence"), "path").withColumn("al", aligned("sequence", "chain_sequence")).select("accession", "path", "chain_id", "chain_sequence", "residue_ids", "al.*")
    placed = sites.select(*key, "path", "pdb_id").join(proteins, ["accession", "path"]).withColumn("index", F.try_element_at("pairs", F.col("position").cast("int"))).where("index is not null")
    placed = placed.withColumns({"residue": F.element_at("residue_ids", F.col("index")), "observed": F.substring("chain_sequence", F.col("index"), F.lit(1))}).drop("pairs", "residue_ids")
    marked = links.select("path", "chain_id", F.struct("resseq", "icode").alias("residue"), F.lit(True).alias("link")).distinct()
    scored = placed.join(marked, ["path", "chain_id", "residue"], "left").withColumn("link", F.coalesce("link", F.lit(False)))
    credible = (F.col("coverage_chain") >= MIN_COVERAGE) & (F.col("n_aligned") >= MIN_ALIGNED)
    here = Window.partitionBy(*key, "path")
    scored = scored.withColumn("credible", credible).withColumn("top", F.max(F.when(F.col("credible"), F.col("identity"))).over(here))
    fits = F.col("credible") & (F.col("identity") >= F.col("top") - IDENTITY_SLACK)
    rank = F.struct("identity", "coverage_chain", "coverage_uniprot", "n_aligned")
    order = here.orderBy(F.when(fits, 0).otherwise(1), F.when(fits & F.col("link"), 0).otherwise(1), rank.desc(), "chain_id")
    best = scored.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    found = F.col("credible")
    tier = F.when(found & F.col("link"), "structure_linked_glycan").otherwise("structure_residue_resolved")
    detail = F.when(~found, "low_confidence_chain_match").when(F.col("observed") == "N", "").otherwise(F.concat(F.lit("residue_mismatch:"), "observed"))
    n_links = links.groupBy("path").agg(F.count("*").alias("n_links"))
    own_links = links.groupBy("path", "chain_id", F.struct("resseq", "icode").alias("residue")).agg(F.count("*").alias("own_links"))
    best = best.join(n_links, "path", "left").join(own_links, ["path", "chain_id", "residue"], "left").join(hosts, "path", "left")
    elsewhere = F.coalesce("n_links", F.lit(0)) - F.coalesce("own_links", F.lit(0))
    record = best.select(*key, "path", tier.alias("tier"), "chain_id", F.col("residue.resseq").alias("resseq"), F.col("residue.icode").alias("icode"), F.col("observed").alias("observed_residue"), detail.alias("detail"), elsewhere.alias("elsewhere"), F.coalesce("host", F.lit("")).alias("expression_system"))
    with_chain = chain_rows.select("path", F.lit(True).alias("has_chain")).distinct()
    every = sites.select(*key, "path", "pdb_id", *(c for c in ("turn",) if c in sites.columns)).distinct().join(record, [*key, "path"], "left").join(with_chain, "path", "left")
    every = every.withColumn("tier", F.coalesce("tier", F.when(F.col("has_chain"), "structure_residue_unresolved").otherwise("structure_not_assessed"))).withColumn("detail", F.coalesce("detail", F.when(F.col("has_chain"), "position_not_in_model").otherwise("no_protein_chain")))
    every = every.withColumn("internal_control", F.coalesce(x.internal_control(F.col("tier"), F.col("detail"), F.col("observed_residue"), F.col("elsewhere"), F.col("expression_system")), F.lit(False)))
    ranks = F.create_map(*(F.lit(a) for t, r in v.STRUCTURE_RANK.items() for a in (t, -r)))
    names = ("pdb_id", "chain_id", "resseq", "icode", "observed_residue", "internal_control", "expression_system", "detail")
    row = F.struct("tier", *names, F.col("elsewhere").alias("glycans_elsewhere"))
    turn = F.col("turn") if "turn" in sites.columns else F.lit(0)
    top = every.groupBy(*key).agg(F.min_by(row, F.struct(F.element_at(ranks, F.col("tier")), turn, F.col("path"))).alias("r"), F.count("*").alias("structure_n_available"))
    return top.select(*key, *(F.col(f"r.{c}").alias(f"structure_{c}") for c in ("tier", *names, "glycans_elsewhere")), "structure_n_available")


def structure_layer(sites: DataFrame, sequences: DataFrame, manifest: DataFrame, extras: DataFrame, files: DataFrame) -> DataFrame:
    """CMP4: sites (accession, position) -> one row each: the best record over all their structures, or why there is none.

    sequences (accession, sequence); manifest (accession, pdb_id, path), the recorded structure of each
    protein; extras (accession, pdb_id, path), the other cached ones, which come after it in order of id.
    """
    key = ["accession", "position"]
    own = manifest.select("accession", "pdb_id", "path", F.lit(0).alias("turn"))
    more = extras.select("accession", "pdb_id", "path", F.lit(1).alias("turn")).join(manifest.select("accession"), "accession", "left_semi")
    known = sequences.where("sequence <> ''").select("accession", "sequence")
    rows = sites.select(*key).join(known, "accession").join(own.unionByName(more), "accession")
    wanted = files.join(rows.select("path").distinct(), "path", "left_semi")
    # chains and links are looked at several times: files are read once for each
    found = assess(rows, cut(chains(residues(atoms(wanted)))), cut(file_links(wanted)), file_hosts(wanted))
    rest = sites.select(*key).join(manifest.select("accession", F.col("pdb_id").alias("own_id")), "accession", "left").join(found, key, "left")
    reason = F.when(F.col("own_id").isNull(), "no_cached_structure").otherwise("no_uniprot_sequence")
    none = F.col("structure_tier").isNull()
    rest = rest.withColumns({"structure_detail": F.when(none, reason).otherwise(F.col("structure_detail")), "structure_pdb_id": F.when(none, F.coalesce("own_id", F.lit(""))).otherwise(F.col("structure_pdb_id")), "structure_tier": F.coalesce("structure_tier", F.lit("structure_not_assessed")), "structure_internal_control": F.coalesce("structure_internal_control", F.lit(False))})
    return rest.drop("own_id").na.fill("").na.fill(0, ["structure_glycans_elsewhere", "structure_n_available"])


def first_usable(proteins: DataFrame, index: DataFrame, ids: str = "pdb_ids") -> DataFrame:
    """FLT18: the first of a protein's structures, in the order listed, that is cached; proteins without a sequence have none."""
    listed = proteins.where("sequence <> ''").select("accession", F.posexplode(x.clean_ids(F.col(ids))).alias("at", "id"))
    found = listed.withColumn("stem", F.upper("id")).join(index.select("stem", "path"), "stem")
    return found.groupBy("accession").agg(F.min_by(F.struct(F.col("stem").alias("pdb_id"), "path"), "at").alias("r")).select("accession", "r.*")


def control_targets(proteins: DataFrame, most: dict[str, int] | None = None, seed: int = 0, ids: str = "pdb_ids") -> DataFrame:
    """CMP7: the first listed structure of each control protein; sets with a cap keep a seeded sample of so many proteins.

    The sample is by md5 of seed and accession, whatever sites a protein has.
    """
    first = F.get(x.clean_ids(F.col(ids)), F.lit(0))
    rows = proteins.select("control_set", "accession", first.alias("pdb_id")).where("pdb_id is not null").groupBy("control_set", "accession").agg(F.min("pdb_id").alias("pdb_id"))
    for name, cap in sorted((most or {}).items()):
        mine = F.col("control_set") == name
        rows = rows.where(~mine).unionByName(rows.where(mine).orderBy(seeded(seed, "accession"), "accession").limit(cap))
    return rows


def environment(residue_rows: DataFrame, radius: float = v.NEIGHBOUR_RADIUS) -> DataFrame:
    """FN21: neighbours within the radius over all chains, their make-up, place in the chain.

    Space is cut into cells twice as wide as the radius. A residue stays in its own cell, where its neighbours
    are counted, and is also sent to all cells that its radius reaches, eight at most but for rounding.
    """
    key = ["path", "chain_id", "resseq", "icode"]
    residue_rows = cut(residue_rows)  # looked at three times
    reach = radius * (1 + 1e-9)  # differences are rounded
    cell = lambda c: F.floor(c / (2 * radius))
    a = residue_rows.select(*key, "x", "y", "z", *(cell(F.col(c)).alias(f"c{c}") for c in "xyz"))
    b = residue_rows.select("path", F.struct("chain_id", "resseq", "icode").alias("other"), F.col("aa").alias("other_aa"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    for c in "xyz":
        b = b.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"o{c}") - reach), cell(F.col(f"o{c}") + reach))))
    near = a.hint("merge").join(b, ["path", "cx", "cy", "cz"]).where((F.sqrt(sum((F.pow(F.col(c) - F.col(f"o{c}"), 2) for c in "xyz"), F.lit(0.0))) <= radius) & (F.struct("chain_id", "resseq", "icode") != F.col("other")))
    found = near.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("other_aa").isin(*v.HYDROPHOBIC)).alias("h"), F.count_if(F.col("other_aa").isin(*v.CHARGED)).alias("c"))
    chain = Window.partitionBy("path", "chain_id")
    placed = residue_rows.select(*key, "aa", F.count("*").over(chain).alias("chain_length_resolved"), F.least(F.abs(F.col("resseq") - F.min("resseq").over(chain)), F.abs(F.max("resseq").over(chain) - F.col("resseq"))).alias("distance_to_chain_terminus"))
    return placed.hint("merge").join(found, key, "left").select(*key, F.col("aa").alias("observed_residue"), F.coalesce("n", F.lit(0)).alias("n_neighbours_8a"), (F.col("h") / F.col("n")).alias("hydrophobic_fraction_8a"), (F.col("c") / F.col("n")).alias("charged_fraction_8a"), "chain_length_resolved", "distance_to_chain_terminus")


# Van der Waals radii in angstrom by element, and the probe's.
RADII, PROBE = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "SE": 1.9, "P": 1.8}, 1.4


def sphere(n: int) -> np.ndarray:
    """n points spread evenly over the unit sphere (golden spiral)."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, math.pi * (1 + 5**0.5) * k
    r = np.sqrt(1 - z * z)
    return np.stack((r * np.cos(turn), r * np.sin(turn), z), axis=1)


def _covered(points: int):
    """dx, dy, dz, reach, other -> which points of an atom's sphere lie within the sphere at that offset, a bit a point, 62 a word."""
    dots, starts = sphere(points), range(0, points, 62)
    powers = 1 << np.arange(62, dtype=np.int64)

    @F.pandas_udf(", ".join(f"w{i} long" for i in range(len(starts))))
    def run(dx: pd.Series, dy: pd.Series, dz: pd.Series, reach: pd.Series, other: pd.Series) -> pd.DataFrame:
        d = np.stack((dx, dy, dz), axis=1)
        least = (reach**2 + (d**2).sum(axis=1) - other**2) / (2 * reach)
        hit = d @ dots.T > least.to_numpy()[:, None]
        return pd.DataFrame({f"w{i}": hit[:, s : s + 62] @ powers[: min(62, points - s)] for i, s in enumerate(starts)})

    return run


def residue_areas(atom_rows: DataFrame, points: int = 100) -> DataFrame:
    """FN19, FN20: Shrake-Rupley area, relative area and bin of each residue.

    Space is cut into cells. An atom stays in its own cell and is also sent to all cells that its sphere could
    reach; pairs that meet and overlap say which points of the one sphere the other covers, as bits, and the bits
    of all partners are or-ed. So a huge structure is spread over tasks, and nothing of it is gathered. An atom
    meets itself, which covers nothing. Rows without coordinates have no area, repeated rows count once, and of
    equal spheres at one place neither covers the other.
    """
    farthest = max(RADII.values()) + PROBE
    width = 3 * farthest
    key = ["path", "chain_id", "resseq", "icode", "resname"]
    protein = atom_rows.where(F.col("resname").isin(list(v.THREE_TO_ONE)) & (F.col("element") != "H") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    radius = F.coalesce(F.try_element_at(F.create_map(*(F.lit(c) for pair in RADII.items() for c in pair)), F.upper("element")), F.lit(1.7))
    own = protein.select(*key, "atom", "x", "y", "z", (radius + PROBE).alias("reach"))
    cell = lambda c: F.floor(c / width)
    other = own.select("path", *(F.col(c).alias(f"o{c}") for c in "xyz"), F.col("reach").alias("other"))
    for c in "xyz":
        far = F.col("other") + farthest
        other = other.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"o{c}") - far), cell(F.col(f"o{c}") + far))))
    gap = [F.col(f"o{c}") - F.col(c) for c in "xyz"]
    near = own.withColumns({f"c{c}": cell(F.col(c)) for c in "xyz"}).hint("merge").join(other, ["path", "cx", "cy", "cz"]).where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] < (F.col("reach") + F.col("other")) ** 2)
    words = [f"w{i}" for i in range(-(-points // 62))]
    bits = near.select(*own.columns, _covered(points)(*gap, "reach", "other").alias("w")).select(*own.columns, "w.*")
    free = points - sum((F.bit_count(w) for w in words), F.lit(0))
    each = bits.groupBy(*own.columns).agg(*(F.bit_or(w).alias(w) for w in words)).withColumn("sasa", 4 * math.pi * F.col("reach") ** 2 * free / points)
    relative = x.rsa(F.col("sasa"), x.residue_code(F.col("resname")))
    return each.groupBy(*key).agg(F.sum("sasa").alias("sasa")).withColumn("rsa", relative).withColumn("rsa_bin", x.rsa_bin(F.col("rsa"))).drop("resname")


def site_features(sites: DataFrame, environment_rows: DataFrame, area_rows: DataFrame) -> DataFrame:
    """CMP5: every site once with its residue's features, carried by row and full residue id."""
    key = ["path", "chain_id", "resseq", "icode"]
    both = environment_rows.join(area_rows, key, "left").withColumn("features_available", F.lit(True))
    return sites.join(both, key, "left").withColumn("features_available", F.coalesce("features_available", F.lit(False)))


def map_sequons(sites: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """FN25, JN23, CMP6: sites (accession, position, sequence, path, chain_id) -> model indices or a reason.

    One table holds both outcomes: rows with a null exclusion_reason are the manifest, the others the
    exclusions, so together they are the input.
    """
    c = chain_rows.withColumnRenamed("sequence", "model_sequence")
    found = sites.select("accession", "sequence", "path", "chain_id").where("sequence is not null").distinct().join(c, ["path", "chain_id"]).withColumn("al", aligned("sequence", "model_sequence")).select("accession", "path", "chain_id", "model_sequence", "residue_ids", F.col("al.pairs").alias("pairs"))
    files = c.select("path", F.lit(True).alias("has_file")).distinct()
    rows = sites.join(found, ["accession", "path", "chain_id"], "left").join(files, "path", "left")
    labels = ("n", "plus1", "plus2")
    for k, label in enumerate(labels):
        rows = rows.withColumn(f"{label}_at", F.try_element_at("pairs", (F.col("position") + k).cast("int")))
    aa = {label: F.substring("model_sequence", F.col(f"{label}_at"), F.lit(1)) for label in labels}
    rows = rows.withColumn("triplet", F.concat(*aa.values()))
    reason = F.when(F.col("sequence").isNull(), "no_uniprot_sequence").when(F.col("path").isNull(), "structure_not_cached").when(F.col("has_file").isNull(), "structure_unreadable").when(F.col("model_sequence").isNull(), "chain_absent")
    for label in labels:
        reason = reason.when(F.col(f"{label}_at").isNull(), f"{label}_not_mapped")
    reason = reason.when(~x.is_sequon(F.col("triplet")), "triplet_not_a_sequon")
    rows = rows.withColumns({"exclusion_reason": reason, "subtype": F.concat(F.lit("NX"), F.substring("triplet", 3, 1)), "chain_length_model": F.length("model_sequence")})
    for label in labels:
        residue = F.try_element_at("residue_ids", F.col(f"{label}_at"))
        rows = rows.withColumns({f"{label}_model_index": F.col(f"{label}_at") - 1, f"{label}_resseq": residue["resseq"], f"{label}_icode": residue["icode"], f"{label}_aa": aa[label]})
    return rows.drop("pairs", "residue_ids", "model_sequence", "has_file", *(f"{label}_at" for label in labels))


#: Parts that the occupied sites of a structure or protein are dealt in; unmodified sites that go through a structure together.
SALTS, ROW = 8, 16


def within_structure_pairs(manifest: DataFrame, occupied: str = v.OCCUPIED, bare: str = v.UNMODIFIED) -> DataFrame:
    """JN15, JN16, CMP8: occupied with unmodified sites of the same protein, or of another in the same structure."""
    site = ["accession", "position"]

    def side(status: str, s: str) -> DataFrame:
        pdb = F.col("structure_pdb_id")
        rows = manifest.where(F.col("occupancy_status") == status).groupBy(*site).agg(F.array_sort(F.collect_set(pdb)).alias("ids"), F.max(pdb.isNull()).alias("blank"))
        return rows.select(*(F.col(c).alias(f"{c}_{s}") for c in (*site, "ids", "blank")))

    # a site is one row with all its structures, so that no pair is made twice and none need be kept to find repeats;
    # occupied sites are dealt in SALTS parts and the others are sent to all, so that a structure of many is spread
    a = side(occupied, "occ").withColumn("salt", F.pmod(F.xxhash64("accession_occ", "position_occ"), F.lit(SALTS)).cast("int"))
    b = side(bare, "unm").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = ["group_id", "accession_occ", "position_occ", "accession_unm", "position_unm", "same_structure"]
    shared = F.array_intersect("ids_occ", "ids_unm")
    n, m = F.size("ids_occ"), F.size("ids_unm")
    differ = (n > 0) & (m > 0) & ((n > 1) | (m > 1) | (F.size(shared) == 0))
    unknown = (F.col("blank_occ") & ((m > 0) | F.col("blank_unm"))) | (F.col("blank_unm") & (n > 0))
    ways = F.array(F.struct((F.size(shared) > 0).alias("is"), F.lit(True).alias("same")), F.struct(differ.alias("is"), F.lit(False).alias("same")), F.struct(unknown.alias("is"), F.lit(None).cast("boolean").alias("same")))
    one = a.hint("merge").join(b, (F.col("accession_occ") == F.col("accession_unm")) & (a.salt == b.salt))
    one = one.withColumn("way", F.explode(F.filter(ways, lambda w: w["is"]))).select(F.col("accession_occ").alias("group_id"), *out[1:5], F.col("way.same").alias("same_structure"))
    # a structure's pairs are many more than its bytes say, so tasks are dealt by number, or Spark would put many structures into one;
    # a site of one structure shares no other, so that only pairs of sites with several are looked through for the first they share
    dealt = lambda rows, pdb: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pdb, "salt")
    far_a = dealt(a.withColumn("pdb_occ", F.explode("ids_occ")), "pdb_occ").sortWithinPartitions("pdb_occ", "salt", "accession_occ", "position_occ")
    # pairs are far more than sites, and their order decides what they take on disk: ROW sites of a protein meet all others
    # in order of name, so that a name or a site is repeated, or comes again after ROW rows, where a column is encoded
    at = F.floor((F.row_number().over(Window.partitionBy("pdb_unm", "accession_unm").orderBy("position_unm")) - 1) / ROW)
    unm = ["position_unm", "ids_unm", "blank_unm"]
    rows = side(bare, "unm").withColumn("pdb_unm", F.explode("ids_unm")).withColumn("at", at).groupBy("pdb_unm", "accession_unm", "at").agg(F.array_sort(F.collect_list(F.struct(*unm))).alias("row"))
    far_b = dealt(rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "pdb_unm").sortWithinPartitions("pdb_unm", "salt", "accession_unm", "at")
    met = far_b.hint("merge").join(far_a, (F.col("pdb_occ") == F.col("pdb_unm")) & (far_a.salt == far_b.salt) & (F.col("accession_occ") != F.col("accession_unm")))
    met = met.select("pdb_occ", *(f"{c}_occ" for c in (*site, "ids", "blank")), "accession_unm", F.inline("row"))
    two = met.where((n == 1) | (m == 1) | (F.col("pdb_occ") == F.get(shared, F.lit(0))))
    two = two.select(F.concat_ws("|", "accession_occ", "accession_unm").alias("group_id"), *out[1:5], F.lit(True).alias("same_structure"))
    return one.unionByName(two)
