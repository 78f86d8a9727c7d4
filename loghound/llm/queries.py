"""The registered queries of this package."""

from __future__ import annotations

from loghound.llm.chat import op6_incremental_chat
from loghound.llm.jaccard import op9_token_group_join
from loghound.llm.language import op12_ftrl_language
from loghound.llm.mixing import op1_pareto_mix
from loghound.llm.negatives import OP11_SQL, op11_strassen_negatives
from loghound.llm.packing import op10_best_fit
from loghound.llm.pii import op3_deobfuscated_pii
from loghound.llm.quality import op7_byte_conv_quality
from loghound.llm.repeats import op4_prefix_doubling
from loghound.llm.runs import op13_suffix_tree_runs
from loghound.llm.syncmers import op5_closed_syncmers
from loghound.llm.topk import op2_norm_topk
from loghound.llm.toxicity import op8_crf_toxicity

QUERIES = {f.__name__: f for f in (
    op1_pareto_mix, op2_norm_topk, op3_deobfuscated_pii, op4_prefix_doubling, op5_closed_syncmers, op6_incremental_chat, op7_byte_conv_quality,
    op8_crf_toxicity, op9_token_group_join, op10_best_fit, op11_strassen_negatives, op12_ftrl_language,
    op13_suffix_tree_runs)}
OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
ORACLE_SQL: dict[str, str] = {"op2_norm_topk": OP2_SQL, "op11_strassen_negatives": OP11_SQL}
