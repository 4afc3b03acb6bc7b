"""One query per corpus operator, over the whole of its table.

``QUERIES`` and ``ORACLES`` have the shape of the main registry; the entry
module adds them when this package is present.
"""

from __future__ import annotations

from panelcast.llm import (
    language_id, license_scan, metric_tree, mixing, near_dedup, packing, prefix_trie, quality_model, quality_rules,
    secret_scan, token_align, url_filter, warc,
)
from panelcast.llm.common import table

QUERIES = {
    "op1_exact_topk": lambda spark, sf: metric_tree.query(spark, table(spark, sf, "embeddings")),
    "op2_license_scans": lambda spark, sf: license_scan.query(spark, table(spark, sf, "documents")),
    "op3_quality_classifier": lambda spark, sf: quality_model.query(
        spark, table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op4_minhash_near_dedup": lambda spark, sf: near_dedup.query(spark, table(spark, sf, "documents")),
    "op5_warc": lambda spark, sf: warc.query(spark, table(spark, sf, "pages")),
    "op6_language_id": lambda spark, sf: language_id.query(spark, table(spark, sf, "documents")),
    "op7_quality_rules": lambda spark, sf: quality_rules.query(table(spark, sf, "documents")),
    "op8_secret_scans": lambda spark, sf: secret_scan.query(spark, table(spark, sf, "documents")),
    "op9_mixing": lambda spark, sf: mixing.query(spark, table(spark, sf, "documents")),
    "op10_packing": lambda spark, sf: packing.query(spark, table(spark, sf, "documents")),
    "op11_token_alignment": lambda spark, sf: token_align.query(spark, table(spark, sf, "documents")),
    "op12_prefix_trie": lambda spark, sf: prefix_trie.query(spark, table(spark, sf, "conversations")),
    "op13_url_filters": lambda spark, sf: url_filter.query(spark, table(spark, sf, "pages")),
}

ORACLES = {
    "op1_exact_topk": metric_tree.ORACLE_SQL,
    "op2_license_scans": license_scan.oracle_sql(),
    "op5_warc": warc.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_url_filters": url_filter.oracle_sql(),
}
