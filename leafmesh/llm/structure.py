"""What a block of text is: prose, heading, caption, statement, formula, list, table, junk and so on.

The rules look at one block alone and at nothing that a corpus would have to be counted for. They are weak labels:
the models of problems 3 to 5 are trained on them or use them as features.
"""

from __future__ import annotations

import re

KINDS = ("empty", "prose", "heading", "caption", "statement", "formula", "names", "cell", "list", "table", "junk")

# Function words of English, German, French and Spanish; fixed values.
FUNCTION_WORDS = frozenset(
    "a about after all although an and are as at be been before between both but by can could did do does each every first for from had has have how if in "
    "into is it its itself many may more most must neither no nor not of on once one only or other our over same second several some such than that the "
    "their them then there they this those to under unlike until up us was we were what when whenever where whether which while who will with without would "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat haben im ist jede jedes jeder kann mit mehr nach "
    "nicht nur ob oder ohne sich sie sind über um und von vor war wenn wie wird wir zu zum zur "
    "au aux avec ce ces cette dans des du elle en est et il je la le les leur mais nous ou par pas plus pour qui que sa se son sur un une "
    "como con del el ella este esta los las lo no para pero por se sin su sus una y".split()
)

#: A caption names what it stands at, numbers it and closes the number with a stop or colon.
CAPTION = re.compile(r"(?:figure|fig\.?|table|tab\.?|abbildung|abb\.?|tabelle|图|表)\s?\d+\s?[.:。：]", re.IGNORECASE)
STATEMENT = re.compile(r"(?:claim|lemma|theorem|proposition|corollary|definition|remark|example|satz|korollar|behauptung) ?\d+ ?[.:]", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?。！？](?=[\s”\"')\]）」]|$)")
_NUMERIC = re.compile(r"[-+±(\[]*[\w.,/-]*\d[\d.,%)\]]*$|^[-–|]$")
_VOWEL = re.compile(r"[aeiouyäöüàáâãåæèéêëìíîïòóôõøùúûýœ]", re.IGNORECASE)
_BULLET = re.compile(r"\s*(?:[-•*·‣▪◦–—]|\(?[a-z0-9]{1,2}[.)])\s+\S")
_REFERENCE = re.compile(r"\s*\[\w{1,12}\]\s+\S|\s*\d{1,3}\.\s+[A-Z][.]?\s?[A-Z]?[^ ]*, ")
_INDEX = re.compile(r"[^\d\s],\s*\d+(?:[-–]\d+)?(?:,\s*\d+(?:[-–]\d+)?)*,?\s*$")
_LEADER = re.compile(r"(?:(?:\.\s?){3}|…)\s*\w{1,6}\s*$")
_NAME_WORD = re.compile(r"(?:[^\W\d_]\.)+|[^\W\d_]+(?:-[^\W\d_]+)?")
_FORMULA = re.compile(r"[=≤≥<>∑∏∫√∧∨¬∀∃∈∉⊂⊆∪∩±×÷·λαβγδεθμπσφω²³ᵢ₀-₉]")
_ASCII_DIGIT = re.compile(r"[0-9]")
_CJK = re.compile(r"[㐀-鿿぀-ヿ가-힯]")


def _is_name(line: str) -> bool:
    """Two to four words of letters or initials, each with a capital."""
    words = line.replace(",", " ").split()
    return 2 <= len(words) <= 4 and all(_NAME_WORD.fullmatch(w) and w[0].isupper() for w in words)


def kind(text: str | None, lexicon: frozenset[str] = frozenset()) -> str:
    """The kind of a block; its text should have canonical characters, line breaks kept. None and blank texts are 'empty'.

    lexicon: words of running text in lower case; with it, headings of two words are told from names of persons. The time
    taken is in proportion to the length of the text.
    """
    tokens = (text or "").split()
    if not tokens:
        return "empty"
    if len(tokens) >= 12 and tokens[0][0].isalpha() and 5 * sum(map(FUNCTION_WORDS.__contains__, tokens)) >= len(tokens):
        # so many function words stand in sentences only
        return "caption" if CAPTION.match(text.lstrip()) else "statement" if STATEMENT.match(text.lstrip()) else "prose"
    lines = [x for x in text.split("\n") if x.strip()]
    one = " ".join(tokens)
    if CAPTION.match(one):
        return "caption"
    if STATEMENT.match(one):
        return "statement"
    words = WORD.findall(one)
    solid = len(one) - len(tokens) + 1
    letters = sum(map(len, words))
    plain = one.isascii()
    digits = len(_ASCII_DIGIT.findall(one)) if plain else sum(map(str.isdigit, one))
    symbols = solid - letters - digits
    if not plain and len(_CJK.findall(one)) > 0.3 * solid:
        return "prose" if SENTENCE_END.search(one) or solid > 40 else "heading"
    small = [w.lower() for w in words]
    function = sum(map(FUNCTION_WORDS.__contains__, small)) / max(1, len(small))
    ended = len(SENTENCE_END.findall(one))
    n = len(lines)
    if n > 1 or solid > 40:
        if _REFERENCE.match(lines[0]) and sum(map(bool, map(_REFERENCE.match, lines))) * 6 >= n:
            return "list"
        if (".." in one or ". ." in one or "…" in one) and 10 * sum(bool(_LEADER.search(x[-40:])) for x in lines) >= 6 * n:
            return "list"
        if n > 1 and function < 0.3 and 10 * sum(map(bool, map(_BULLET.match, lines))) >= 6 * n:
            return "list"
        if n > 1 and digits and "," in one and 10 * sum(bool(_INDEX.search(x[-80:])) for x in lines) >= 6 * n:
            return "list"
        latin1 = 0 if plain else sum("\x80" <= c <= "\xff" or c in "€™œ" for c in one)
        if solid >= 20 and (symbols > 0.3 * solid or latin1 > 0.3 * solid):
            return "junk"
        if letters + digits > 60 and solid > 28 * len(tokens):
            return "junk"
        numeric = sum(1 for t in tokens if len(t) < 40 and _NUMERIC.match(t)) if digits or symbols else 0
        if numeric * 10 >= 4 * len(tokens) or digits > 0.3 * solid or sum("\t" in x or x.count("|") > 1 for x in lines) * 2 > n:
            return "table"
        if function < 0.2:
            longer = [w for w in small if len(w) > 2]
            if len(longer) > 4 and sum(not _VOWEL.search(w) for w in longer) > 0.35 * len(longer):
                return "junk"
    if letters == 0 or (len(tokens) == 1 and digits):
        return "cell" if digits or solid < 3 else "formula"
    if solid <= 40 and _FORMULA.search(one) and (symbols + digits) * 3 > solid and function < 0.25:
        return "formula"
    if letters <= 3 and len(tokens) <= 3 or (letters <= 4 and symbols + digits):
        return "cell"
    if n > 3 and 10 * sum("," in x and _is_name(x) for x in lines) >= 7 * n and not any(w in lexicon for w in small[: len(small) // 2]):
        return "list"
    if all(map(_is_name, lines)) and not any(w in lexicon for w in small):
        if n > 1 and any("," in x for x in lines):
            return "list"
        return "names" if n <= 8 else "list"
    if function >= 0.08 and (ended or len(words) >= 14):
        return "prose"
    if len(words) >= 8 and not ended and function < 0.05 and one[0].islower():
        return "junk"
    if len(words) <= 16 and not one.endswith((".", "!", "?", ";", ",")) and n <= 4:
        return "heading" if not one[0].islower() or function else ("cell" if len(words) < 3 else "heading")
    if ended and len(words) >= 3:
        return "prose"
    return "prose" if function >= 0.08 else "junk" if len(words) >= 8 else "cell"
