"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from codequarry.llm import decontaminate, langid, licenses, line_dedup, pieces, sharding, simhash, topk, toxicity, url_filter

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_simhash_dedup": simhash.query,
    "op3_sentencepiece": pieces.query,
    "op4_language_id": langid.query,
    "op5_sharding": sharding.query,
    "op6_toxicity": toxicity.query,
    "op7_decontamination": decontaminate.query,
    "op8_topk_search": topk.query,
    "op9_line_dedup": line_dedup.query,
    "op10_url_filter": url_filter.query,
}

#: Operators over a second table.
MORE = {"op4_language_id_pages": langid.pages_query}


def oracles() -> dict[str, str]:
    return {
        "op7_decontamination": decontaminate.ORACLE,
        "op8_topk_search": topk.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_url_filter": url_filter.oracle(),
    }
