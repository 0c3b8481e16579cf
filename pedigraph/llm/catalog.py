"""Registered queries of the pipeline operators and their SQL."""

from pedigraph.llm import licenses, mixing, negatives, outliers, repair
from pedigraph.llm.chat import op5_chat_format
from pedigraph.llm.hashing import op7_multi_index
from pedigraph.llm.langid import op3_ppm_language
from pedigraph.llm.pairs import op6_pca_tiles
from pedigraph.llm.pieces import op1_pieces
from pedigraph.llm.secrets import op2_secret_scan
from pedigraph.llm.sharding import op10_sampled_splitters
from pedigraph.llm.simhash import op8_simhash_near_dup

QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_secret_scan": op2_secret_scan,
    "op3_ppm_language": op3_ppm_language,
    "op4_temperature_mix": mixing.op4_temperature_mix,
    "op5_chat_format": op5_chat_format,
    "op6_pca_tiles": op6_pca_tiles,
    "op7_multi_index": op7_multi_index,
    "op8_simhash_near_dup": op8_simhash_near_dup,
    "op9_license_diagonals": licenses.op9_license_diagonals,
    "op10_sampled_splitters": op10_sampled_splitters,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_quality_outliers": outliers.op13_quality_outliers,
}

ORACLE = {
    "op4_temperature_mix": mixing.ORACLE,
    "op9_license_diagonals": licenses.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
    "op13_quality_outliers": outliers.ORACLE,
}
