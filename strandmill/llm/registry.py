"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from strandmill.llm import alignment, bpe, chat, decontam, langid, linededup, media, neardup, packing, quality, repair, substrings, tokencounts


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_token_counts": tokencounts.op3_token_counts,
        "op4_quality": quality.op4_quality,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_language_id": langid.op6_language_id,
        "op7_media": media.op7_media,
        "op8_chat": chat.op8_chat,
        "op9_near_dedup": neardup.op9_near_dedup,
        "op10_substring_dedup": substrings.op10_substring_dedup,
        "op11_bpe": bpe.op11_bpe,
        "op12_alignment": alignment.op12_alignment,
        "op13_repair": repair.op13_repair,
        "page_line_dedup": linededup.page_line_dedup,
        "reply_branches": chat.reply_branches,
    }


def oracle_sql() -> dict[str, str]:
    known = {
        "op2_line_dedup": linededup.ORACLE_SQL,
        "op5_decontamination": decontam.ORACLE_SQL,
        "op13_repair": repair.ORACLE_SQL,
        "page_line_dedup": linededup.PAGES_SQL,
        "reply_branches": chat.BRANCHES_SQL,
    }
    return {name: sql for name, sql in known.items() if sql}
