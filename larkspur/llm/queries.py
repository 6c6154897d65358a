"""The queries of this subpackage and the SQL for those that SQL can express."""

from larkspur.llm import (
    bpe, conversation_repair, conversation_trie, decontamination, exact_dedup, ngram_join, page_templates, perspectives,
    secrets, sharding, token_files, toxicity, warc,
)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_perspectives": perspectives.op2_perspectives,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_warc": warc.op5_warc,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_files": token_files.op10_token_files,
    "op11_main_text": page_templates.op11_main_text,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

SQL = {
    "op1_secret_scan": secrets.SQL,
    "op2_perspectives": perspectives.SQL,
    "op4_decontamination": decontamination.SQL,
    "op5_warc": warc.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
