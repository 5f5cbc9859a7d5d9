"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import op1_packing, op2_quality, op3_chat, op4_substring, op5_simhash, op6_language, op7_bitpack, op8_permutation, op9_toxicity, op10_bpe

QUERIES = {
    "op1_packing": op1_packing.op1_packing,
    "op2_quality": op2_quality.op2_quality,
    "op3_chat": op3_chat.op3_chat,
    "op4_substring": op4_substring.op4_substring,
    "op5_simhash": op5_simhash.op5_simhash,
    "op6_language": op6_language.op6_language,
    "op7_bitpack": op7_bitpack.op7_bitpack,
    "op8_permutation": op8_permutation.op8_permutation,
    "op9_toxicity": op9_toxicity.op9_toxicity,
    "op10_byte_bpe": op10_bpe.op10_byte_bpe,
}
#: Operators whose result SQL expresses in full.
ORACLE_SQL = {"op2_quality": op2_quality.SQL, "op3_chat": op3_chat.SQL, "op4_substring": op4_substring.SQL}
