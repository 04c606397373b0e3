"""The registered ``opN_<name>`` queries and their DuckDB text."""

from __future__ import annotations

from quantloom.llm import byte_bpe, conversation_repair, conversation_trie, decontamination, exact_dedup, fixity, language, license_scan, mixing, near_dedup, tokens, toxicity, url_filter
from quantloom.llm.common import stored, table  # noqa: F401


def _over(name, build):
    return lambda spark, folder: build(table(spark, folder, name))


QUERIES = {
    "op1_exact_dedup": _over("documents", exact_dedup.op1),
    "op2_license_scan": _over("documents", license_scan.op2),
    "op3_decontamination": lambda spark, folder: decontamination.op3(table(spark, folder, "documents"), table(spark, folder, "benchmark")),
    "op4_language_id": _over("documents", language.op4),
    "op5_fixity_audit": _over("pages", fixity.op5),
    "op6_near_dedup": _over("documents", near_dedup.op6),
    "op7_url_filter": _over("pages", url_filter.op7),
    "op8_toxicity": lambda spark, folder: toxicity.op8(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op9_mixing": _over("documents", mixing.op9),
    "op10_token_counts": _over("documents", tokens.op10),
    "op11_byte_bpe": _over("documents", byte_bpe.op11),
    "op12_conversation_repair": _over("conversations", conversation_repair.op12),
    "op13_conversation_trie": _over("conversations", conversation_trie.op13),
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_fixity_audit": fixity.OP5_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
