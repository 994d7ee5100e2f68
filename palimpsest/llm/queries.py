"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .. import ship
from . import decontaminate, jaccard, licences, passages, pieces, quality, sharding, topk, toxicity, urls


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _shipped(q)
    for name, q in {
        "op1_toxicity": toxicity.query,
        "op2_topk": topk.query,
        "op3_passages": passages.query,
        "op4_jaccard": jaccard.query,
        "op5_sharding": sharding.query,
        "op6_urls": urls.query,
        "op7_pieces": pieces.query,
        "op8_quality": quality.query,
        "op9_licences": licences.query,
        "op10_decontaminate": decontaminate.query,
    }.items()
}

SQL = {"op2_topk": topk.SQL, "op9_licences": licences.SQL, "op10_decontaminate": decontaminate.SQL}
