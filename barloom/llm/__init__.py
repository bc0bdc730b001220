"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from barloom.llm.decontaminate import op7_decontaminate
from barloom.llm.html_extract import op10_html_extract
from barloom.llm.language_id import op3_language_id
from barloom.llm.lattice_lm import op8_lattice_lm
from barloom.llm.line_dedup import OP5_SQL, op5_line_dedup
from barloom.llm.near_dedup import OP1_SQL, op1_minhash_near_dedup
from barloom.llm.packing import op9_packing
from barloom.llm.pii import op4_pii
from barloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from barloom.llm.quality_rules import op6_quality_rules
from barloom.llm.sharding import op2_sharding
from barloom.llm.spelling import OP13_SQL, op13_spelling_variants
from barloom.llm.url_filters import op12_url_filters

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_packing": op9_packing,
    "op10_html_extract": op10_html_extract,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filters": op12_url_filters,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {"op1_minhash_near_dedup": OP1_SQL, "op5_line_dedup": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_spelling_variants": OP13_SQL}
