"""Queries over the test tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

import corpus_pipeline
from lumenlake.llm.alignment import op11_alignment
from lumenlake.llm.chat import OP6_SQL, op6_chat
from lumenlake.llm.exact import OP8_SQL, op8_exact_dedup
from lumenlake.llm.licences import op5_licences
from lumenlake.llm.packing import op2_packing
from lumenlake.llm.pieces import op1_sentencepiece
from lumenlake.llm.pii import op10_pii
from lumenlake.llm.quality import op4_quality
from lumenlake.llm.sharding import op13_sharding
from lumenlake.llm.simhash import op3_simhash
from lumenlake.llm.topk import OP7_SQL, op7_topk
from lumenlake.llm.toxicity import op9_toxicity
from lumenlake.llm.variants import OP12_SQL, op12_variants

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_licences": op5_licences,
    "op6_chat": op6_chat,
    "op7_topk": op7_topk,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_variants": op12_variants,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op6_chat": OP6_SQL, "op7_topk": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op12_variants": OP12_SQL}
