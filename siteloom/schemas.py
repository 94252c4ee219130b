"""Declared schemas of the input tables."""

PAIRS = "pair_id string, pos_accession string, best_loss_positive_position double, analysis_ready boolean, cluster_id string, neg_accession string, source string"
HOMOLOGY = "pair_id string, homology_qc_bucket string"
ANNOTATION = "Entry string, Sequence string, Glycosylation string, GlyGen string, GlyConnect string"
STRUCTURE_MANIFEST = "accession string, pdb_id string, output_path string, status string, all_pdb_ids string"
GLYCAN_DETAIL = "struct<glycosylation:array<struct<type:string,start_pos:int,end_pos:int,site_category:string,site_category_dict:map<string,boolean>,evidence:array<struct<database:string,id:string>>,glytoucan_ac:string>>>"
COMPOSITION_DETAIL = "struct<id:bigint,structures:array<struct<type:string,composition_string:string,sites:array<struct<site:string,reviewed:boolean>>>>>"
CONTROL_PROTEINS = "Entry string, Organism string, organism_id string, Sequence string, PDB string, control_set string"
