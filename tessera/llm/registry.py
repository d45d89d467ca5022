"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tessera.llm import ann, chat, collocations, cotrain, dac, dualtree, imatch, jaccard, langid, linededup, mixing, transducer, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_langid": langid.op2_langid,
    "op3_chat": chat.op3_chat,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_imatch": imatch.op5_imatch,
    "op6_quality": cotrain.op6_quality,
    "op7_bpe": transducer.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_ann": ann.op9_ann,
    "op10_tokens": dac.op10_tokens,
    "op11_phrases": collocations.op11_phrases,
    "op12_codes": dualtree.op12_codes,
    "op13_lines": linededup.op13_lines,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op3_chat": chat.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_phrases": collocations.ORACLE,
    "op12_codes": dualtree.ORACLE,
    "op13_lines": linededup.ORACLE,
}
