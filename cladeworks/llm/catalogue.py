"""The operators' queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from cladeworks.llm.decontamination import op10_decontamination
from cladeworks.llm.fingerprints import op2_fingerprints
from cladeworks.llm.kneser_ney import op9_kneser_ney
from cladeworks.llm.language_id import op4_language_id
from cladeworks.llm.line_dedup import OP6_SQL, op6_line_dedup
from cladeworks.llm.packing import op7_packing
from cladeworks.llm.personal_data import op1_personal_data
from cladeworks.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from cladeworks.llm.repair import OP12_SQL, op12_structure_repair
from cladeworks.llm.revisits import OP5_SQL, op5_revisits
from cladeworks.llm.simhash_dedup import op8_simhash_dedup
from cladeworks.llm.token_files import op3_token_files
from cladeworks.llm.token_groups import OP13_SQL, op13_token_groups

QUERIES = {f.__name__: f for f in (op1_personal_data, op2_fingerprints, op3_token_files, op4_language_id, op5_revisits, op6_line_dedup, op7_packing, op8_simhash_dedup, op9_kneser_ney, op10_decontamination, op11_prefix_trie, op12_structure_repair, op13_token_groups)}
ORACLE_SQL = {"op5_revisits": OP5_SQL, "op6_line_dedup": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL, "op13_token_groups": OP13_SQL}
