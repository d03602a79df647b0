"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gristmill.llm import ann, bytebpe, centroids, chat, jaccard, langid, lexical, lmscore, media, packing, pii, shards, tokenbin


def queries():
    return {
        "op1_lm_score": lmscore.op1_lm_score,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_language_id": langid.op3_language_id,
        "op4_token_files": tokenbin.op4_token_files,
        "op5_byte_bpe": bytebpe.op5_byte_bpe,
        "op6_shards": shards.op6_shards,
        "op7_pii": pii.op7_pii,
        "op8_nearest": ann.op8_nearest,
        "op9_packing": packing.op9_packing,
        "op10_media_copies": media.op10_media_copies,
        "op11_centroids": centroids.op11_centroids,
        "op12_chat_format": chat.op12_chat_format,
        "op13_ranked_search": lexical.op13_ranked_search,
    }


def oracle_sql():
    return {
        "op2_jaccard_join": jaccard.OP2_SQL,
        "op6_shards": shards.OP6_SQL,
        "op7_pii": pii.oracle_sql(),
        "op8_nearest": ann.OP8_SQL,
        "op11_centroids": centroids.oracle_sql(),
        "op12_chat_format": chat.OP12_SQL,
        "op13_ranked_search": lexical.OP13_SQL,
    }
