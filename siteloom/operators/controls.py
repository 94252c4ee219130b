"""What is said of each set of control proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import exprs as x

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_counts(sequence: Column) -> Column:
    """How often each of the 26 letters stands in a sequence, an array in order of the alphabet; 0 for a null."""
    return F.array(*(F.coalesce(F.length(sequence) - F.length(F.replace(sequence, F.lit(c))), F.lit(0)).cast("long") for c in LETTERS))


def composition(proteins: DataFrame, *by: str) -> DataFrame:
    """AGG9: (by, letter, share) of the letters that occur, over all sequences of a set; tasks add up their own first."""
    each = proteins.select(*by, F.posexplode(letter_counts(F.col("sequence"))).alias("at", "k"))
    sums = each.groupBy(*by, "at").agg(F.sum("k").alias("k")).where("k > 0")  # at most 26 rows a set
    return sums.select(*by, F.substring(F.lit(LETTERS), F.col("at") + 1, F.lit(1)).alias("letter"), (F.col("k") / F.sum("k").over(Window.partitionBy(*by))).alias("share"))


def control_summary(proteins: DataFrame, by: str = "control_set") -> DataFrame:
    """AGG10: proteins, motifs, motifs a protein and a thousand residues, proteins with a motif, those of them with a structure, letters.

    One pass: what is counted is found protein by protein, so only a row a set and task is shuffled. A set
    without residues has no rate; a null sequence has no residues and no motif.
    """
    motifs = F.coalesce(x.sequon_count(F.col("sequence")), F.lit(0)).cast("long")
    rows = proteins.select(by, motifs.alias("k"), F.coalesce(F.length("sequence"), F.lit(0)).cast("long").alias("residues"), (F.size(x.clean_ids(F.col("pdb_ids"))) > 0).alias("solved"), letter_counts(F.col("sequence")).alias("l"))
    letters = [F.sum(F.col("l")[i]).cast("string") for i in range(len(LETTERS))]
    out = rows.groupBy(by).agg(F.count("*").alias("proteins"), F.sum("k").alias("sequons"), F.sum("residues").alias("residues"), F.count_if(F.col("k") > 0).alias("proteins_with_motif"), F.count_if((F.col("k") > 0) & F.col("solved")).alias("proteins_with_structure"), F.concat_ws(",", *letters).alias("letters"))
    rate = F.when(F.col("residues") > 0, F.round(1000 * F.col("sequons") / F.col("residues"), 3))
    return out.select(by, "proteins", "sequons", F.round(F.col("sequons") / F.col("proteins"), 3).alias("per_protein"), rate.alias("per_1000_residues"), "proteins_with_motif", "proteins_with_structure", "letters")
