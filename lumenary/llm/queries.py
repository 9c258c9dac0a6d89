"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenary.llm import decontamination, exact, jaccard_join, manifest, periodic_runs
from lumenary.llm.decontamination import op1_decontamination
from lumenary.llm.jaccard_join import op3_ngram_jaccard_join
from lumenary.llm.language import op6_language_id
from lumenary.llm.manifest import op13_merkle_manifest
from lumenary.llm.packing import op9_tree_packing
from lumenary.llm.periodic_runs import op12_periodic_runs
from lumenary.llm.pii import op8_pii
from lumenary.llm.quality_classifier import op5_quality_classifier
from lumenary.llm.quality_rules import op7_quality_rules
from lumenary.llm.secrets import op10_secret_scan
from lumenary.llm.sharding import op4_ring_sharding
from lumenary.llm.simhash import op11_simhash
from lumenary.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_ring_sharding": op4_ring_sharding,
    "op2_toxicity": op2_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_tree_packing": op9_tree_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
    **exact.QUERIES,
}
ORACLE_SQL = {
    "op1_decontamination": decontamination.SQL,
    "op3_ngram_jaccard_join": jaccard_join.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
    "op13_merkle_manifest": manifest.SQL,
    **exact.ORACLE_SQL,
}
