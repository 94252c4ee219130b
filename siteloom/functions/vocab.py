"""Closed vocabularies and constants of the evidence model."""

# Evidence codes and the tier each stands for.
ECO_TIER = {
    "ECO:0000250": "sequence_similarity",
    "ECO:0000255": "manual_sequence_model",
    "ECO:0000256": "automatic_sequence_model",
    "ECO:0000259": "automatic_sequence_model",
    "ECO:0000269": "manual_experimental",
    "ECO:0000305": "manual_curator_inference",
    "ECO:0007744": "manual_combinatorial",
}

# Annotation tiers, strongest first.
ANNOTATION_TIERS = ("manual_experimental", "manual_combinatorial", "manual_curator_inference", "manual_sequence_model", "sequence_similarity", "automatic_sequence_model", "annotation_without_qualifying_evidence")

# Why a tier that the policy doesn't select excludes a site.
TIER_EXCLUSION = {
    "manual_experimental": "experimental_tier_not_selected",
    "manual_combinatorial": "combinatorial_tier_not_selected",
    "manual_curator_inference": "curator_inference_only",
    "manual_sequence_model": "sequence_model_only",
    "automatic_sequence_model": "sequence_model_only",
    "sequence_similarity": "sequence_similarity_only",
    "annotation_without_qualifying_evidence": "annotation_without_qualifying_evidence",
}
ABSENT_ACCESSION, ABSENT_FEATURE = "accession_absent_from_snapshot", "exact_feature_absent"

# Glycan database tiers, strongest first, and the databases that re-export the annotation layer.
GLYCAN_TIERS = ("glygen_reported_with_glycan", "glygen_reported_independent", "glygen_reported_uniprot_derived", "glygen_predicted", "glygen_unclassified")
CIRCULAR_DATABASES = ("UniProtKB", "UniProtKB/Swiss-Prot", "UniProtKB/TrEMBL")

# Structure tiers and their rank.
STRUCTURE_RANK = {"structure_linked_glycan": 3, "structure_residue_resolved": 2, "structure_residue_unresolved": 1, "structure_not_assessed": 0}
# Words that mark hosts able to glycosylate.
COMPETENT_HOSTS = ("HOMO SAPIENS", "HEK", "CRICETULUS", "CHO", "MUS MUSCULUS", "SPODOPTERA", "TRICHOPLUSIA", "DROSOPHILA", "INSECT", "PICHIA", "KOMAGATAELLA", "SACCHAROMYCES", "YEAST")
# Greatest accessible area of a residue in square angstrom (Tien et al. 2013).
MAX_ASA = {"A": 121.0, "C": 148.0, "D": 187.0, "E": 214.0, "F": 228.0, "G": 97.0, "H": 216.0, "I": 195.0, "K": 230.0, "L": 191.0, "M": 203.0, "N": 187.0, "P": 154.0, "Q": 214.0, "R": 265.0, "S": 143.0, "T": 163.0, "V": 165.0, "W": 264.0, "Y": 255.0}
# Residue classes, and the radius of a residue's neighbourhood in angstrom.
HYDROPHOBIC, CHARGED = "ACFILMVWY", "DEKR"
NEIGHBOUR_RADIUS = 8.0
# One-letter codes of residue names.
THREE_TO_ONE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "MSE": "M", "PHE": "F", "PRO": "P", "PYL": "O", "SEC": "U", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
# Fixed value: files above this size aren't read.
MAX_STRUCTURE_BYTES = 20_000_000
# Residue names that count as a glycan bound to an asparagine.
GLYCANS = ("NAG", "NDG", "BGC", "GLC", "MAN", "BMA", "FUC", "GAL", "XYS")

# Support layers in order, occupancy states.
LAYERS = ("uniprot", "glygen", "glyconnect", "structure")
OCCUPIED, UNKNOWN, UNMODIFIED = "occupied_supported", "unknown", "observed_unmodified"

# Model alphabet, retention categories, slots of a design batch.
ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"
RETENTION = ("full_sequon_retained", "asn_retained_motif_lost", "ser_thr_retained_motif_lost", "proline_introduced_at_x", "complete_motif_loss")
DESIGN_SLOTS = 6000

# Families whose members are normally glycosylated.
FAMILIES = r"(?i)\b(immunoglobulin|antibody|Fc receptor|mucin|collagen|integrin|cadherin|complement C[0-9]|coagulation factor|fibrinogen|von Willebrand|histocompatibility|growth factor receptor)\b"

# Taxa with known transfer machinery, left out of the bacterial control set.
TRANSFER_TAXA = (194, 209, 629, 713, 724, 2157, 32257)
