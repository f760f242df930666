"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import ann, chat, ctw, embdedup, langid, linededup, minhash, mixing, packing, urlfilter


def queries():
    return {
        "op1_minhash": minhash.query,
        "op2_chat": chat.query,
        "op3_mixing": mixing.query,
        "op4_linededup": linededup.query,
        "op5_urlfilter": urlfilter.query,
        "op6_packing": packing.query,
        "op7_langid": langid.query,
        "op8_lm": ctw.query,
        "op9_ann": ann.query,
        "op10_embdedup": embdedup.query,
    }


def oracle_sql():
    return {
        "op1_minhash": minhash.SQL,
        "op2_chat": chat.SQL,
        "op3_mixing": mixing.SQL,
        "op4_linededup": linededup.SQL,
        "op5_urlfilter": urlfilter.SQL,
        "op9_ann": ann.SQL,
        "op10_embdedup": embdedup.SQL,
    }
