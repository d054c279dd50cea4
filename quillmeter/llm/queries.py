"""The queries of this folder, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard, licenses, mixing, neighbours, pii, quality, sharding, token_counts, warc

QUERIES = {
    "op1_warc_normaliser": warc.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_pii": pii.op3,
    "op4_license_scan": licenses.op4,
    "op5_source_mixing": mixing.op5,
    "op6_token_counts": token_counts.op6,
    "op7_sharding": sharding.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_nearest_neighbours": neighbours.op9,
    "op10_quality_classifier": quality.op10,
    "pii_base_spans": pii.base_spans,
}
SQL = {"pii_base_spans": pii.base_sql(), "op1_warc_normaliser": warc.OP1_SQL, "op7_sharding": sharding.op7_sql(), "op2_decontamination": decontaminate.OP2_SQL, "op4_license_scan": licenses.op4_sql(), "op5_source_mixing": mixing.OP5_SQL, "op8_jaccard_join": jaccard.OP8_SQL}
