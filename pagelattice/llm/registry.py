"""The queries of this subpackage, and SQL for those that SQL can express.

Operators of tokenizers, learned models and packing have no SQL; tests/llm holds them against the libraries, brute force or held-out rows.
"""

from __future__ import annotations

from pagelattice.llm.embedding_dedup import OP10_SQL, op10_projection_dedup
from pagelattice.llm.lm_scoring import op8_lm_scoring
from pagelattice.llm.minhash_dedup import OP4_SQL, op4_minhash_near_dedup
from pagelattice.llm.packing import op3_best_fit_packing
from pagelattice.llm.sstable import op6_token_shards
from pagelattice.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from pagelattice.llm.token_counts import op5_token_counts
from pagelattice.llm.topk import OP9_SQL, op9_topk_search
from pagelattice.llm.toxicity import op2_toxicity
from pagelattice.llm.tree_bpe import op7_tree_bpe

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_best_fit_packing, op4_minhash_near_dedup, op5_token_counts, op6_token_shards, op7_tree_bpe, op8_lm_scoring, op9_topk_search, op10_projection_dedup)}
ORACLE: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op4_minhash_near_dedup": OP4_SQL, "op9_topk_search": OP9_SQL, "op10_projection_dedup": OP10_SQL}
