"""The letters of the language operator are those of str.isalpha, over all code points."""

import sys

from strandmill.llm import langid


def test_letters_cover_all_code_points():
    table = langid._letters()
    assert len(table) == sys.maxunicode + 1
    assert [c for c in range(len(table)) if (table[c] != langid._BREAK) != chr(c).isalpha()] == []


def test_text_of_rare_letters_has_grams():
    codes, counts = langid.grams("\U00030000\U00031350")
    assert {0x30000, 0x31350} <= set(codes.tolist()) and counts.sum() > 0
