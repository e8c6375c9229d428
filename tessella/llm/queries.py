"""The registered queries of this subpackage and their SQL for an independent engine."""

from . import chat, conversation_repair, decontamination, jaccard_join, licenses, line_dedup, mixing, nearest, secrets, sharding, token_alignment, toxicity, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_nearest": nearest.op9_nearest,
    "op10_mixing": mixing.op10_mixing,
    "mixing_blocks": mixing.mixing_blocks,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLE_SQL = {
    "op2_secret_scans": secrets.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
