"""Functions and predicates on the text of blocks, as columns.

Patterns use ASCII classes and explicit ranges, so that they mean the same in every engine. White space is space, tab, line
feed, carriage return, form feed and the no-break and ideographic spaces. A null text is null in functions and no match in
predicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x{00A0}\x{3000}]"
CJK = r"[\x{4E00}-\x{9FFF}]"
#: Words that English sentences are held together by.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "we", "when", "which", "with")


def yes(condition: Column) -> Column:
    """A predicate that is false where it is null."""
    return F.coalesce(condition, F.lit(False))


# ---------------------------------------------------------------------------------------------- functions


def stripped(t: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def flat(t: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def without_space(t: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(t, f"{SPACE}+", "")


def normalized(t: Column) -> Column:
    """Soft hyphens dropped, blanks around line feeds dropped, runs of blanks as one, stripped."""
    t = F.regexp_replace(F.regexp_replace(t, r"\x{00AD}", ""), r"[ \t]*\n[ \t]*", "\n")
    return stripped(F.regexp_replace(t, r"[ \t]+", " "))


def normalized_translation(t: Column) -> Column:
    """Stripped, with at most one empty line in a row."""
    return F.regexp_replace(stripped(t), r"\n{3,}", "\n\n")


def normalized_english(t: Column) -> Column:
    """Lower case with straight quotes, single spaces and none before punctuation."""
    t = F.translate(F.lower(t), "‘’“”", "''\"\"")
    return F.regexp_replace(flat(t), r" ([,.;:!?)])", "$1")


def compact(t: Column) -> Column:
    """Letters and digits of ASCII in lower case, and nothing else."""
    return F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "")


def compact_with_cjk(t: Column) -> Column:
    """Letters and digits of ASCII in lower case, and ideographs."""
    return F.regexp_replace(F.lower(t), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "")


def cjk_only(t: Column) -> Column:
    """The ideographs of a text."""
    return F.regexp_replace(t, r"[^\x{4E00}-\x{9FFF}]+", "")


def cjk_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(CJK))


def latin_words(t: Column) -> Column:
    """The words of three ASCII letters or more."""
    return F.regexp_extract_all(t, F.lit(r"[A-Za-z]{3,}"), 0)


def tokens(t: Column) -> Column:
    """Runs of ASCII letters, in lower case."""
    return F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z]+"), 0), F.lower)


def stop_word_count(t: Column) -> Column:
    return F.size(F.filter(tokens(t), lambda w: w.isin(*STOP_WORDS)))


def line_count(t: Column) -> Column:
    """Lines, one more than the line feeds."""
    return F.regexp_count(t, F.lit("\n")) + 1


def lines(t: Column) -> Column:
    """The lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(t, "\n"), stripped), lambda x: x != "")


def first_line(t: Column) -> Column:
    """The first line that is not blank, null if there is none."""
    return F.get(lines(t), F.lit(0))


def slug(t: Column, default: str = "document") -> Column:
    """Lower case with runs of anything but letters and digits as hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def output_name(stem: Column, suffix: str) -> Column:
    return F.concat(stem, F.lit(suffix))


def page_file(page: Column, kind: str = "png") -> Column:
    """The file name of a page."""
    return F.concat(F.lit("page-"), F.lpad(page.cast("string"), 3, "0"), F.lit(f".{kind}"))


def component_id(page: Column, index: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(page.cast("string"), 3, "0"), F.lit("c"), F.lpad(index.cast("string"), 4, "0"))


def pair_key(a: Column, b: Column) -> Column:
    """The key of two neighbouring blocks."""
    return F.concat(a, F.lit("->"), b)


def joined_hyphens(t: Column) -> Column:
    """Words cut by a hyphen at a line end joined, the rest on one line."""
    return flat(F.regexp_replace(t, r"([a-z])-\n([a-z])", "$1$2"))


def first_sentence(t: Column) -> Column:
    """The text up to its first end of a sentence, all of it if there is none."""
    found = F.regexp_extract(t, r"^([^.!?。！？]*[.!?。！？])", 1)
    return F.when(found == "", t).otherwise(found)


def terminal_mark(t: Column) -> Column:
    """The mark that a Chinese line should end with."""
    return F.when(t.rlike(r"(如下|以下|例如)$"), "：").otherwise("。")


def needs_terminal_mark(t: Column) -> Column:
    """Whether a Chinese line is long and ends without a mark."""
    return yes((F.length(stripped(t)) >= 12) & (cjk_count(t) > 0) & ~stripped(t).rlike(r"[。！？；：.!?;:…”）)\]》]$"))


def with_terminal_marks(t: Column) -> Column:
    """Each line that lacks its mark with one."""
    return F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(needs_terminal_mark(x), F.concat(stripped(x), terminal_mark(stripped(x)))).otherwise(x)), "\n")


def joined(left: Column, right: Column) -> Column:
    """Two lines as one, with a space only where letters or digits of ASCII meet."""
    gap = F.when(left.rlike(r"[A-Za-z0-9,.;:)]$") & right.rlike(r"^[A-Za-z0-9(]"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(left, gap, right)


def reflowed(t: Column) -> Column:
    """Paragraphs of the lines of a text: a blank line, or a line that starts with a number and a stop, begins a new one."""
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        line = stripped(x)
        fresh = (s.now == "") | line.rlike(r"^\(?[0-9]+[.)]")
        closed = F.when(s.now == "", s.done).when(s.done == "", s.now).otherwise(F.concat(s.done, F.lit("\n"), s.now))
        return F.when(line == "", F.struct(closed.alias("done"), F.lit("").alias("now"))).when(fresh, F.struct(closed.alias("done"), line.alias("now"))).otherwise(F.struct(s.done.alias("done"), joined(s.now, line).alias("now")))

    return F.aggregate(F.split(t, "\n"), state, step, lambda s: F.when(s.now == "", s.done).when(s.done == "", s.now).otherwise(F.concat(s.done, F.lit("\n"), s.now)))


def heading_level(t: Column) -> Column:
    """The depth of a numbered heading, at most 4; 1 without number."""
    number = F.coalesce(F.regexp_extract(stripped(t), r"^([0-9]+(\.[0-9]+)*)\.?[ \t]", 1), F.lit(""))
    return F.when(number == "", 1).otherwise(F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(4)))


def heading_number(t: Column) -> Column:
    """The number of a block that is a section number only, empty otherwise."""
    return F.regexp_extract(stripped(t), r"^([1-9][0-9]?(\.[1-9][0-9]?)*)\.?$", 1)


def enumeration_start(t: Column) -> Column:
    """The number in brackets that a text starts with, null if none."""
    return F.nullif(F.regexp_extract(t, r"^[ \t\n]*\(([0-9]{1,3})\)", 1), F.lit("")).cast("int")


def reference_marker(t: Column) -> Column:
    """The marker of a bibliography entry, [n] or n., without its brackets; empty if none."""
    return F.regexp_extract(stripped(t), r"^\[?([0-9]{1,3})[\].][ \t]", 1)


def reference_parts(t: Column) -> Column:
    """A bibliography entry's marker, authors, title, venue, year, volume, issue and pages; parts that aren't there are empty."""
    s = joined_hyphens(t)
    body = F.regexp_replace(s, r"^\[?[0-9]{1,3}[\].][ ]", "")
    return F.struct(
        F.regexp_extract(s, r"^\[?([0-9]{1,3})[\].][ ]", 1).alias("marker"),
        F.regexp_extract(body, r"^((?:[A-Z]\. [^.,]+(?:, )?)+)\. ", 1).alias("authors"),
        F.regexp_extract(body, r"^(?:[A-Z]\. [^.,]+(?:, )?)+\. ([^.]+)\. ", 1).alias("title"),
        F.regexp_extract(body, r"\. ([A-Z][A-Za-z ]+) [0-9]+\([0-9]+\), [0-9]{4}", 1).alias("venue"),
        F.regexp_extract(body, r"\), ([0-9]{4})", 1).alias("year"),
        F.regexp_extract(body, r" ([0-9]+)\([0-9]+\), [0-9]{4}", 1).alias("volume"),
        F.regexp_extract(body, r" [0-9]+\(([0-9]+)\), [0-9]{4}", 1).alias("issue"),
        F.regexp_extract(body, r"pp\. ([0-9]+-[0-9]+)", 1).alias("pages"),
    )


# ---------------------------------------------------------------------------------------------- predicates


def is_blank(t: Column) -> Column:
    return yes(without_space(t) == "")


def is_page_number(t: Column) -> Column:
    """One to three digits, with a bullet or stop at most."""
    return yes(stripped(t).rlike(r"^[•·]?[ ]?[0-9]{1,3}[ ]?[•·.]?$"))


def is_decorated_page_number(t: Column) -> Column:
    """A short text of digits with dashes, bars, dots or bullets around them."""
    return yes((F.length(stripped(t)) <= 7) & stripped(t).rlike(r"^[-–—|•·. ]*[0-9]{1,4}[-–—|•·. ]*$"))


def is_url(t: Column) -> Column:
    return yes(stripped(t).rlike(r"^https?://[^ \n\t]+$"))


def is_trivial(t: Column) -> Column:
    """Blank, a page number or a lone address: there is nothing to translate."""
    return is_blank(t) | is_page_number(t) | is_url(t)


def is_caption(t: Column) -> Column:
    """The first line names a figure or table by number, closed by a stop or colon."""
    return yes(flat(first_line(t)).rlike(r"^(?i)(figure|fig\.|table|tab\.|abb\.) ?[0-9]+[.:]"))


def is_table_caption(t: Column) -> Column:
    return yes(flat(first_line(t)).rlike(r"^(?i)(table|tab\.) ?[0-9]+[.:]"))


def is_equation_label(t: Column) -> Column:
    return yes(stripped(t).rlike(r"^\([0-9]{1,3}[a-z]?\)$"))


def is_formula(t: Column) -> Column:
    """Short, few words, and with signs of mathematics."""
    s = flat(t)
    return yes((F.length(s) >= 3) & (F.length(s) <= 60) & (F.size(latin_words(s)) <= 3) & s.rlike(r"[=≤≥∑∏√∧∨¬∈⊂∪∩±×÷→]"))


def is_metric_cell(t: Column) -> Column:
    """A short cell with digits and a unit, sign or fraction, without words."""
    s = flat(t)
    return yes((F.length(s) <= 20) & s.rlike(r"[0-9]") & s.rlike(r"[%~×±.]") & ~s.rlike(r"[A-Za-z]{3}"))


def is_numeric_column(t: Column) -> Column:
    """Two or more lines of numbers only."""
    return yes((F.size(lines(t)) >= 2) & F.forall(lines(t), lambda x: x.rlike(r"^[-+±]?[0-9.,]+ ?%?$")))


def is_reference_heading(t: Column) -> Column:
    return yes(flat(t).rlike(r"^(?i)([0-9]+(\.[0-9]+)*\.? )?(references|bibliography|literatur)$"))


def is_reference_item(t: Column) -> Column:
    """Some line starts with a marker and the names of authors."""
    return yes(F.exists(lines(t), lambda x: x.rlike(r"^\[[0-9]{1,3}\] [A-Z]\. [A-Z]")))


def is_heading(t: Column) -> Column:
    """One or two lines in title shape: numbered, or capitals at the start of long words, without an end of a sentence."""
    s = flat(t)
    shape = s.rlike(r"^[0-9]+(\.[0-9]+)*\.? [A-Z]") | s.rlike(r"^[A-Z][A-Za-z-]*( (of|the|for|a|an|and|in|on|under|to|[A-Z][A-Za-z-]*))*$")
    return yes((line_count(stripped(t)) <= 2) & (F.length(s).between(3, 120)) & shape & ~s.rlike(r"[.!?;:,]$"))


def is_running_header_text(t: Column) -> Column:
    """A page number, or one to eight words with capitals."""
    s = flat(t)
    return is_page_number(t) | yes(s.rlike(r"^[A-Z][A-Za-z-]*( (of|the|for|a|an|and|in|on|under|[A-Z][A-Za-z-]*)){0,7}$"))


def is_code_line(t: Column) -> Column:
    """A line in the shape of program text."""
    s = stripped(t)
    return yes(s.rlike(r"^(def|class|import|from|return|for|while|if|else|elif|try|except|with|var|let|const|public|private|static|void|int)\b.*[:;({]$") | s.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\(.*\);?$") | s.rlike(r"^(//|/\*|\*/|#!)") | s.rlike(r"[{};]$"))


def is_code(t: Column) -> Column:
    """At least two lines, and a third of all, are program text."""
    n = F.size(F.filter(lines(t), is_code_line))
    return yes((n >= 2) & (n * 20 >= F.size(lines(t)) * 7))


def is_line_numbers(t: Column) -> Column:
    return yes((F.size(lines(t)).between(2, 20)) & F.forall(lines(t), lambda x: x.rlike(r"^[0-9]{1,3}$")))


def is_key_values(t: Column) -> Column:
    """More than half of the lines are a key, a colon and a value."""
    n = F.size(F.filter(lines(t), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:( .*)?$")))
    return yes((F.size(lines(t)) >= 2) & (n * 20 >= F.size(lines(t)) * 11))


def is_prose(t: Column) -> Column:
    """Four ideographs or more, or five words with a word that holds sentences together."""
    return yes((cjk_count(t) >= 4) | ((F.size(tokens(t)) >= 5) & (stop_word_count(t) >= 1)))


def is_sentence(t: Column) -> Column:
    """Three words or more, one of them a stop word, and an end of a sentence."""
    return yes((F.size(tokens(t)) >= 3) & (stop_word_count(t) >= 1) & stripped(t).rlike(r"[.!?]$"))


def is_enumeration(t: Column) -> Column:
    return yes(stripped(t).rlike(r"^\([0-9]{1,3}\) "))


def is_statement(t: Column) -> Column:
    return yes(stripped(t).rlike(r"^(?i)(theorem|lemma|claim|definition|remark|proposition|corollary) [0-9]+[.:]"))


def is_identifier(t: Column) -> Column:
    """An address, a copyright note or a label: text, but none to translate."""
    return is_url(t) | yes(stripped(t).rlike(r"^(?i)(\(c\)|copyright|doi:)")) | yes(stripped(t).rlike(r"^[A-Za-z]{1,3}[0-9]{0,4}$"))


def is_symbol(t: Column) -> Column:
    """One to eight signs without a word."""
    return yes((F.length(stripped(t)).between(1, 8)) & ~stripped(t).rlike(r"[A-Za-z]{3}"))


def needs_translation(t: Column) -> Column:
    """Enough words for a sentence or title: four, or two in title shape, and no formula, code or list of references."""
    return yes((F.size(latin_words(t)) >= 4) | ((F.size(latin_words(t)) >= 2) & is_heading(t))) & ~is_formula(t) & ~is_code(t) & ~is_reference_item(t) & ~is_identifier(t)


def is_untranslated(source: Column, answer: Column) -> Column:
    """An answer that is the source again, or English: no ideograph and three words, or more stop words than ideographs."""
    same = (compact(source) != "") & (compact(source) == compact(answer))
    english = (cjk_count(answer) == 0) & (F.size(latin_words(answer)) >= 3)
    return yes(same | english | ((stop_word_count(answer) >= 3) & (stop_word_count(answer) > cjk_count(answer))))


def goes_on(t: Column) -> Column:
    """Whether a text breaks off: a hyphen, comma or stop word at its end, or no end of a sentence."""
    s = stripped(t)
    return yes((s != "") & (s.rlike(r"[-,;]$") | s.rlike(r"(?i)\b(and|or|of|the|a|an|to|in|for|with|whereas)$") | ~s.rlike(r"[.!?:)\"”]$")))


def starts_inside(t: Column) -> Column:
    """Whether a text starts in mid-sentence: with a small letter or a mark."""
    return yes(stripped(t).rlike(r"^[a-z,;)]"))


def is_garbled(t: Column) -> Column:
    """Eight letters or more, hardly any vowel among them, or mostly signs."""
    letters = F.regexp_count(t, F.lit(r"[A-Za-z]"))
    vowels = F.regexp_count(t, F.lit(r"[AEIOUYaeiouy]"))
    signs = F.length(without_space(t)) - F.regexp_count(t, F.lit(r"[A-Za-z0-9\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}]"))
    return yes(((letters >= 8) & (vowels * 5 < letters)) | ((F.length(without_space(t)) >= 8) & (signs * 2 > F.length(without_space(t)))))


def without_garbled_lines(t: Column) -> Column:
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: ~is_garbled(x)), "\n")
