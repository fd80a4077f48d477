"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tallyloom.llm.conversations import OP12_SQL, op12_prefix_trie
from tallyloom.llm.decontaminate import OP9_SQL, op9_decontaminate
from tallyloom.llm.hamming import OP8_SQL, op8_exact_top_k
from tallyloom.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from tallyloom.llm.langid import op2_language_id
from tallyloom.llm.lines import OP10_SQL, PASSAGE_SQL, op10_line_dedup, op10_passage_dedup
from tallyloom.llm.negatives import OP13_SQL, op13_hard_negatives
from tallyloom.llm.pieces import op5_sentencepiece
from tallyloom.llm.quality import op3_quality
from tallyloom.llm.sharding import op6_sharding
from tallyloom.llm.substrings import OP1_SQL, op1_substring_dedup
from tallyloom.llm.toxicity import op11_toxicity
from tallyloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op8_exact_top_k": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op10_passage_dedup": PASSAGE_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
