"""The ten operators' queries and their SQL."""

from __future__ import annotations

from linkrain.llm import licenses, quality, topk, toxicity, urls
from linkrain.llm.bpe import op3_bpe
from linkrain.llm.decontaminate import op1_decontaminate
from linkrain.llm.langid import op9_langid
from linkrain.llm.simhash import op5_simhash
from linkrain.llm.suffixes import op7_suffixes

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_urls": urls.op2_urls,
    "op3_bpe": op3_bpe,
    "op4_topk": topk.op4_topk,
    "op5_simhash": op5_simhash,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffixes": op7_suffixes,
    "op8_quality": quality.op8_quality,
    "op9_langid": op9_langid,
    "op10_licenses": licenses.op10_licenses,
}

ORACLES = {"op2_urls": urls.ORACLE_SQL, "op4_topk": topk.ORACLE_SQL, "op10_licenses": licenses.ORACLE_SQL}
