"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from strataquery.llm import bestfit, bpe, chat, divergence, embed, jaccard, langid, packing, pii, sharding, topk, trie, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_bpe": bpe.op3_bpe,
    "op4_pii": pii.op4_pii,
    "op5_chat": chat.op5_chat,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_packing": packing.op8_packing,
    "op9_embed": embed.op9_embed,
    "op10_topk": topk.op10_topk,
    "op11_divergence": divergence.op11_divergence,
    "op12_bestfit": bestfit.op12_bestfit,
    "op13_trie": trie.op13_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op2_jaccard": jaccard.OP2_SQL, "op5_chat": chat.OP5_SQL, "op6_warc": warc.OP6_SQL, "op9_embed": embed.OP9_SQL, "op10_topk": topk.OP10_SQL, "op11_divergence": divergence.OP11_SQL, "op13_trie": trie.OP13_SQL}
