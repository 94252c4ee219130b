"""Scalar functions as pure Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import vocab as v


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def no_nan(c: Column) -> Column:
    """NaN counts as missing (doubles)."""
    return F.when(~F.isnan(c), c)


# -- annotation text ------------------------------------------------------------------------------

# How the annotation format writes an evidence code, a feature, its exact place, any place, and its note.
CODE, FEATURE, EXACT, PLACED, NOTE = r"ECO:\d{7}", r"CARBOHYD\s", r"^CARBOHYD\s+(\d+)\s*;", r"^CARBOHYD\s+\S+", r'/note="([^"]*)"'


def eco_codes(text: Column) -> Column:
    """FN1: the distinct evidence codes in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0))))


def feature_pieces(text: Column) -> Column:
    """FN2: one string for each glycosylation feature of a column."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"(?={FEATURE})"), lambda p: p.rlike("^" + FEATURE))


def glyco_type(note: Column) -> Column:
    """FN5."""
    t = F.lower(note)
    n_linked = F.when(t.contains("glycation"), "glycation").when(t.contains("asparagine"), "N-linked").otherwise("N-linked-other")
    return F.when(t.contains("n-linked"), n_linked).when(t.contains("o-linked"), "O-linked").when(t.contains("c-linked"), "C-linked").when(t.contains("s-linked"), "S-linked").otherwise("unknown")


def parse_status(piece: Column) -> Column:
    """FN3: ok for one exact position, else why not."""
    return F.when(piece.rlike(EXACT), "ok").when(piece.rlike(PLACED), "uncertain_or_range_position").otherwise("malformed_feature")


def parsed_feature(piece: Column) -> Column:
    """FN3-FN5 of one piece as a struct."""
    note = F.regexp_extract(piece, NOTE, 1)  # FN4
    at = F.regexp_extract(piece, EXACT, 1)
    return F.struct(F.when(at != "", at.try_cast("int")).alias("position"), glyco_type(note).alias("glyco_type"), eco_codes(piece).alias("evidence_codes"), note.alias("raw_note"), parse_status(piece).alias("parse_status"))


def parse_features(rows: DataFrame, text: str = "Glycosylation", key: str = "accession") -> DataFrame:
    """FN6: one row for each feature in the text column."""
    return rows.select(key, F.explode(F.transform(feature_pieces(F.col(text)), parsed_feature)).alias("f")).select(key, "f.*")


# -- tiers ----------------------------------------------------------------------------------------


def best_of(tiers: Column, order: tuple[str, ...]) -> Column:
    """The array's strongest member in the given order; null if it has none."""
    ranks = _map({t: i for i, t in enumerate(order)})
    return F.element_at(F.array(*map(F.lit, order)), (F.array_min(F.transform(tiers, lambda t: F.element_at(ranks, t))) + 1).cast("int"))


def annotation_tier(codes: Column) -> Column:
    """FN7: strongest tier of the codes."""
    tiers = F.transform(codes, lambda c: F.element_at(_map(v.ECO_TIER), c))
    return F.coalesce(best_of(F.array_compact(tiers), v.ANNOTATION_TIERS), F.lit(v.ANNOTATION_TIERS[-1]))


def exclusion_reason(tier: Column, selected: list[str]) -> Column:
    """FN8: empty if the policy selects the tier."""
    return F.when(tier.isin(selected), "").otherwise(F.element_at(_map(v.TIER_EXCLUSION), tier))


def glycan_entry_tier(categories: Column, databases: Column) -> Column:
    """FN9: categories are the keys of the category map, or else the single category."""
    independent = F.size(F.array_except(databases, F.array(*map(F.lit, v.CIRCULAR_DATABASES)))) > 0
    has = lambda c: F.array_contains(categories, c)
    return (
        F.when(has("reported_with_glycan"), v.GLYCAN_TIERS[0])
        .when(has("reported"), F.when(independent, v.GLYCAN_TIERS[1]).otherwise(v.GLYCAN_TIERS[2]))
        .when(has("predicted") | has("predicted_with_glycan"), v.GLYCAN_TIERS[3])
        .otherwise(v.GLYCAN_TIERS[4])
    )


def glycan_entry_usable(kind: Column, start: Column, end: Column) -> Column:
    """FN10: an N-linked entry at one position."""
    return F.coalesce((F.lower(kind) == "n-linked") & start.isNotNull() & (start == end), F.lit(False))


def ids_by_database(evidence: Column, database: str) -> Column:
    """FN11."""
    return F.transform(F.filter(evidence, lambda e: (e["database"] == database) & (F.coalesce(e["id"], F.lit("")) != "")), lambda e: e["id"])


def site_label_position(label: Column) -> Column:
    """FN12: 80 for "Asn-80", in any case; null for another residue or form."""
    parts = F.split(F.lower(F.trim(label)), "-")
    return F.when((F.size(parts) == 2) & (parts[0] == "asn") & ~parts[1].rlike("[^0-9]"), F.get(parts, F.lit(1)).try_cast("int"))


def support(flags: dict[str, Column]) -> tuple[Column, Column, Column]:
    """FN13: (names joined by |, count, any) of the flags that hold, in layer order."""
    flags = {n: F.coalesce(flags[n], F.lit(False)) for n in v.LAYERS if n in flags}
    count = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return F.concat_ws("|", *(F.when(f, F.lit(n)) for n, f in flags.items())), count, count > 0


def occupancy(positive: Column, bare_control: Column) -> Column:
    """FN14: support outranks a bare residue under internal control, which outranks silence."""
    return F.when(positive, v.OCCUPIED).when(F.coalesce(bare_control, F.lit(False)), v.UNMODIFIED).otherwise(v.UNKNOWN)


# -- sequences ------------------------------------------------------------------------------------

# Fixed value: the motif, looked ahead at so that overlapping ones are found.
SEQUON = "(?=N[^P][ST])"


def sequon_count(sequence: Column) -> Column:
    """FN15: how many motifs there are; one regular expression, no array."""
    return F.regexp_count(sequence, F.lit(SEQUON))


def sequons(sequence: Column) -> Column:
    """FN15: (position, sequon) of every motif, N, not P, S or T; positions from 1, overlaps count.

    The sequence is cut into letters once, so that a long one costs its length, and only if it has a motif.
    """
    letters = F.array(F.split(sequence, ""))  # an array of one, so that the letters are bound once, not once a place
    hit = lambda s, i: (s[i - 1] == "N") & (F.get(s, i) != "P") & F.get(s, i + 1).isin("S", "T")
    found = lambda s: F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 2, F.lit(1))), lambda i: hit(s, i))
    three = lambda s: F.transform(found(s), lambda i: F.struct(i.alias("position"), F.concat(s[i - 1], s[i], s[i + 1]).alias("sequon")))
    return F.when(sequence.rlike(SEQUON), F.transform(letters, three)[0]).otherwise(F.array().cast("array<struct<position:int,sequon:string>>"))


def sequon_positions(sequence: Column) -> Column:
    """FN15: the positions alone."""
    return F.transform(sequons(sequence), lambda m: m["position"])


def clean_ids(text: Column) -> Column:
    """FN17: the non-blank parts between semicolons, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def sequon_sites(proteins: DataFrame, id_limit: int = 20) -> DataFrame:
    """FN16: proteins (accession, sequence, pdb_ids, ...) -> a row for each sequon."""
    ids = clean_ids(F.col("pdb_ids"))
    # what is said of the protein is said before its motifs become rows, and its sequence stays behind
    rows = proteins.withColumns({"motifs": sequons(F.col("sequence")), "protein_length": F.length("sequence"), "n_pdb_entries": F.size(ids), "pdb_ids": F.array_join(F.slice(ids, 1, id_limit), ";")}).drop("sequence")
    # explode() would have the motifs found twice, once for a filter that the optimizer adds before it
    return rows.withColumn("m", F.explode_outer("motifs")).where("m is not null").select(*(c for c in rows.columns if c != "motifs"), "m.position", "m.sequon")


def residue_code(three: Column) -> Column:
    """FN36: X where unknown."""
    return F.coalesce(F.try_element_at(_map(v.THREE_TO_ONE), F.upper(F.trim(three))), F.lit("X"))


def is_sequon(triplet: Column) -> Column:
    return triplet.rlike("^N[^P][ST]$")


# -- structures -----------------------------------------------------------------------------------


# How a structure's head names its host, and how far the head goes.
HOST, HEAD = r"EXPRESSION_SYSTEM:\s*([^;]+);", 40_000


def expression_system(head: Column) -> Column:
    """SRC12: the host named in the head of a structure."""
    return F.trim(F.regexp_extract(F.substring(head, 1, HEAD), HOST, 1))


def competent_host(host: Column) -> Column:
    """FN18."""
    return F.upper(host).rlike("|".join(v.COMPETENT_HOSTS))


def rsa(sasa: Column, residue: Column) -> Column:
    """FN19: share of the residue's greatest exposure, at most 1.5."""
    return F.least(sasa / F.try_element_at(_map(v.MAX_ASA), residue), F.lit(1.5))


def rsa_bin(value: Column) -> Column:
    return F.when(value.isNull(), "").when(value < 0.09, "buried").when(value < 0.36, "intermediate").otherwise("exposed")


def clean_icode(code: Column) -> Column:
    """FN22."""
    t = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "?", "."), "").otherwise(t)


def internal_control(tier: Column, detail: Column, observed: Column, links_elsewhere: Column, host: Column) -> Column:
    """FN24: a bare, credibly mapped asparagine in a structure that carries a glycan elsewhere, from a competent host."""
    credible = (observed == "N") & ~detail.startswith("residue_mismatch") & (detail != "low_confidence_chain_match")
    return (tier == "structure_residue_resolved") & credible & (links_elsewhere > 0) & competent_host(host)


# -- scores ---------------------------------------------------------------------------------------


def half_even(value: Column, places: int) -> Column:
    """FN35: a double rounded to decimal places as its exact binary value demands, ties to even.

    The product with a power of ten is taken with its error (Veltkamp split, Dekker product), so that 2.675,
    which lies below the tie, goes down, and 0.125, which lies on it, to 0.12. For products up to 2^52;
    greater ones have no decimals to round and come back as they are.
    """
    k, split = float(10**places), 134217729.0
    k_high = split * k - (split * k - k)
    product = value * k
    high = value * split - (value * split - value)
    error = ((high * k_high - product) + high * (k - k_high) + (value - high) * k_high) + (value - high) * (k - k_high)
    low = F.floor(product).cast("double")
    over = product - low
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    return F.when(F.abs(product) < 2.0**52, (low + F.when(up, 1.0).otherwise(0.0)) / k).otherwise(value)


def logit(p: Column) -> Column:
    """FN26: log-odds of p held within 1e-6 of 0 and 1."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def is_distribution(values: Column, slack: float = 1e-3) -> Column:
    """FN27/FN15: sums to one, nothing negative, nothing over one."""
    return F.coalesce((F.abs(total(values) - 1) <= slack) & (F.array_min(values) >= 0) & (F.array_max(values) <= 1 + slack), F.lit(False))


def letter(values: Column, aa: str) -> Column:
    return F.element_at(values, v.ALPHABET.index(aa) + 1)


def sequon_score(at_n: Column, at_plus2: Column) -> Column:
    """FN28: mean log-odds of N at the first place and of S or T at the third."""
    return (logit(letter(at_n, "N")) + logit(letter(at_plus2, "S") + letter(at_plus2, "T"))) / 2


def scoreable(mask: Column, places: Column) -> Column:
    """FN29: every place lies in the mask and is true there (places from 0)."""
    return F.forall(places, lambda i: F.coalesce((i >= 0) & F.get(mask, i), F.lit(False)))


def normal_reason(reason: Column) -> Column:
    """FN30."""
    return F.substring(F.regexp_replace(reason, r"_\[.*", ""), 1, 70)


def gene_tokens(text: Column) -> Column:
    """FN31."""
    return F.array_distinct(F.filter(F.split(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"[\s;]+"), lambda g: g != ""))


def suspect_family(name: Column) -> Column:
    """FN32."""
    return F.coalesce(name.rlike(v.FAMILIES), F.lit(False))


def batch_size(length: Column, designs: Column, most: Column | None = None) -> Column:
    """FN33: designs decoded at once within the slot budget, or as many as asked for."""
    own = F.greatest(F.lit(1), F.least(designs, F.floor(F.lit(v.DESIGN_SLOTS) / F.greatest(length, F.lit(1)))))
    return own if most is None else F.when(F.coalesce(most, F.lit(0)) > 0, F.greatest(F.lit(1), F.least(most, designs))).otherwise(own)


def verdict(low: Column, high: Column, margin: Column) -> Column:
    """STAT5: an interval that touches the margin still counts as equivalent."""
    return F.when((low >= -margin) & (high <= margin), "equivalent").when((low > margin) | (high < -margin), "beyond_margin").when((low > 0) | (high < 0), "directional").otherwise("inconclusive")


def retention(designs: Column, n: Column, x: Column, st: Column) -> Column:
    """AGG26: counts and shares of the outcomes of a motif over designs; places from 0.

    Designs too short for all places don't count; without any, shares are null. Only full and complete
    loss exclude each other.
    """
    at = lambda d, i: F.substring(d, i + 1, F.lit(1))
    long = F.filter(designs, lambda d: F.length(d) > F.greatest(n, x, st))
    count = F.size(long)
    keeps = lambda d: at(d, n) == "N"
    tail = lambda d: at(d, st).isin("S", "T")
    pro = lambda d: at(d, x) == "P"
    full = lambda d: keeps(d) & tail(d) & ~pro(d)
    tests = (full, lambda d: keeps(d) & ~full(d), lambda d: tail(d) & ~full(d), pro, lambda d: ~keeps(d) & ~tail(d))
    out = [count.alias("n_designs_scored")]
    for name, test in zip(v.RETENTION, tests):
        hits = F.size(F.filter(long, test))
        out += [hits.alias(f"n_{name}"), F.when(count > 0, hits / count).alias(f"frac_{name}")]
    return F.struct(*out)
