"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontam, hardneg, langid, linededup, matroska, mixing, pieces, pii, quality, setjoin, suffixdedup, tiered, tokenfiles

QUERIES = {
    "op1_matroska_packets": matroska.op1,
    "op2_token_files": tokenfiles.op2,
    "op3_decision_list": quality.op3,
    "op4_site_boilerplate": linededup.op4,
    "op5_sampled_pieces": pieces.op5,
    "op6_cross_parsing": langid.op6,
    "op7_merged_transforms": suffixdedup.op7,
    "op8_personal_data": pii.op8,
    "op9_set_relations": setjoin.op9,
    "op10_systematic_mix": mixing.op10,
    "op11_fm_index": decontam.op11,
    "op12_ball_tree": hardneg.op12,
    "op13_tiered_search": tiered.op13,
}

SQL = {
    "op4_site_boilerplate": linededup.SQL,
    "op9_set_relations": setjoin.SQL,
    "op10_systematic_mix": mixing.SQL,
    "op11_fm_index": decontam.SQL,
    "op12_ball_tree": hardneg.SQL,
    "op13_tiered_search": tiered.SQL,
}
