import re
import unicodedata

from leafmesh.llm import chunks, forms


def test_composed_and_decomposed_forms_fold_alike():
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if parts != ch:
            assert forms.fold(ch) == forms.fold(parts), hex(code)


def test_folding_twice_changes_nothing():
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        once = forms.fold("a" + chr(code) + "̣x")
        assert forms.fold(once) == once, hex(code)


def test_marks_of_other_planes_stand_between_a_letter_and_its_mark():
    for mark in ("\U0001d165", "\U00010a01", "\U000110ba", "̈"):
        text = "a" + mark + "̣b"
        assert forms.fold(text) == forms.fold(unicodedata.normalize("NFD", text)) == forms.fold(unicodedata.normalize("NFC", text))


def test_what_may_change_never_stays_in_the_jvm():
    may_change = re.compile(forms.MAY_CHANGE.replace(r"\u", "\\u"))
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        if forms._is_unstable(code):
            assert may_change.search(chr(code)), hex(code)


def test_what_looks_the_same_and_what_does_not():
    for a, b in (("ｆｕｌｌ", "full"), ("café", "café"), ("zero​width", "zerowidth"), ("a b", "a b"), ("sсope", "scope"), ("ﬁne", "fine"), ("co‐op", "co-op"), ("", "")):
        assert forms.canonical(a) == forms.canonical(b)
    for a, b in (("Case", "case"), ("naive", "naïve"), ("n²", "n2"), ("①", "1"), ("№ 4", "No 4"), ("x", "x̲"), ("٣", "3")):
        assert forms.canonical(a) != forms.canonical(b)


def test_letters_beyond_the_basic_plane_count():
    one, other = "\U00020000" * 30, "\U00020000" * 29 + "\U00020001"
    found = chunks.long_lines([one, other, one])
    assert len(found["wording"]) == 3 and found["wording"][0] == found["wording"][2] != found["wording"][1]
    greek = chunks.long_lines(["ΔΣΦΩΛΣ" * 5, "δσφωλς" * 5])
    assert greek["wording"][0] == greek["wording"][1]


def test_wordings_without_chunks_are_the_same():
    texts = ["Short\nThis line has more than twenty-eight letters in it, 12\n\nand this one, too, has more than twenty-eight", "", "ÄÖÜ äöü ﬁ " * 5 + "\n" + "x" * 28, "y" * 27]
    all_of = chunks.long_lines(texts)
    text, line, wording = chunks.line_wordings(texts)
    assert (all_of["text"] == text).all() and (all_of["line"] == line).all() and (all_of["wording"] == wording).all() and len(text) == 4
