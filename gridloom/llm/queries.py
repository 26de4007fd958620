"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from gridloom.llm import exact, langid, licenses, linededup, media, mixing, packing, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash_groups": simhash.op1_simhash_groups,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_prefix_shards": sharding.op3_prefix_shards,
    "op4_media_columns": media.op4_media_columns,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": langid.op9_language_id,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLE_SQL = {"op2_line_dedup": linededup.OP2_SQL, "op10_exact_dedup": exact.OP10_SQL}
