"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from tessera.llm import alignment, bpe, conversations, decontaminate, html_text, langid, licenses, neardup, packing, secrets, substrings, token_counts, topk

QUERIES = {
    "op1_langid": langid.query,
    "op2_token_counts": token_counts.query,
    "op3_substrings": substrings.query,
    "op4_secrets": secrets.query,
    "op5_neardup": neardup.query,
    "op6_bpe": bpe.query,
    "op7_topk": topk.query,
    "op8_licenses": licenses.query,
    "op9_decontaminate": decontaminate.query,
    "op10_html_text": html_text.query,
    "op11_packing": packing.query,
    "op12_conversations": conversations.query,
    "op13_alignment": alignment.query,
}

ORACLES: dict[str, str] = {
    "op7_topk": topk.SQL,
}
