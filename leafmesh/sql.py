"""Pieces of SQL from which the DuckDB forms of the queries are put together."""

from __future__ import annotations

from leafmesh.operators.text import STOP_WORDS

SPACE = "[ \\t\\n\\r\\f\\x{00A0}\\x{3000}]"


def gone(t: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({t}, '{pattern}', '{by}', 'g')"


def like(t: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({t}, '{pattern}'), false)"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def stripped(t: str) -> str:
    return gone(t, f"^{SPACE}+|{SPACE}+$")


def flat(t: str) -> str:
    return f"trim({gone(t, SPACE + '+', ' ')})"


def without_space(t: str) -> str:
    return gone(t, SPACE + "+")


def normalized(t: str) -> str:
    inner = gone(gone(t, "\\x{00AD}"), "[ \\t]*\\n[ \\t]*", "\n")
    return stripped(gone(inner, "[ \\t]+", " "))


def compact(t: str) -> str:
    return gone(f"lower({t})", "[^a-z0-9]+")


def compact_with_cjk(t: str) -> str:
    return gone(f"lower({t})", "[^a-z0-9\\x{4E00}-\\x{9FFF}]+")


def cjk_count(t: str) -> str:
    return count(t, "[\\x{4E00}-\\x{9FFF}]")


def latin_words(t: str) -> str:
    return f"regexp_extract_all({t}, '[A-Za-z]{{3,}}')"


def tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '[A-Za-z]+'), lambda w: lower(w))"


def stop_words(t: str) -> str:
    return f"len(list_filter({tokens(t)}, lambda w: w in ({', '.join(repr(w) for w in STOP_WORDS)})))"


def lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {stripped('x')}), lambda x: x <> '')"


def first_line(t: str) -> str:
    return f"({lines(t)})[1]"


def yes(c: str) -> str:
    return f"coalesce({c}, false)"


def every(t: str, condition: str) -> str:
    """Whether a condition on x holds for all lines."""
    return f"len(list_filter({lines(t)}, lambda x: not ({condition}))) = 0"


def some(t: str, condition: str) -> str:
    return f"len(list_filter({lines(t)}, lambda x: {condition})) > 0"


def is_blank(t: str) -> str:
    return yes(f"{without_space(t)} = ''")


def is_page_number(t: str) -> str:
    return like(stripped(t), "^[•·]?[ ]?[0-9]{1,3}[ ]?[•·.]?$")


def is_decorated(t: str) -> str:
    return yes(f"length({stripped(t)}) <= 7 and {like(stripped(t), '^[-–—|•·. ]*[0-9]{1,4}[-–—|•·. ]*$')}")


def is_url(t: str) -> str:
    return like(stripped(t), "^https?://[^ \\n\\t]+$")


def is_trivial(t: str) -> str:
    return f"({is_blank(t)} or {is_page_number(t)} or {is_url(t)})"


def is_caption(t: str) -> str:
    return like(flat(first_line(t)), "^(?i)(figure|fig\\.|table|tab\\.|abb\\.) ?[0-9]+[.:]")


def is_equation_label(t: str) -> str:
    return like(stripped(t), "^\\([0-9]{1,3}[a-z]?\\)$")


def is_formula(t: str) -> str:
    return yes(f"length({flat(t)}) >= 3 and length({flat(t)}) <= 60 and len({latin_words(flat(t))}) <= 3 and {like(flat(t), '[=≤≥∑∏√∧∨¬∈⊂∪∩±×÷→]')}")


def is_metric(t: str) -> str:
    return yes(f"length({flat(t)}) <= 20 and {like(flat(t), '[0-9]')} and {like(flat(t), '[%~×±.]')} and not {like(flat(t), '[A-Za-z]{3}')}")


def is_numeric_column(t: str) -> str:
    return yes(f"len({lines(t)}) >= 2 and {every(t, like('x', '^[-+±]?[0-9.,]+ ?%?$'))}")


def is_reference_heading(t: str) -> str:
    return like(flat(t), "^(?i)([0-9]+(\\.[0-9]+)*\\.? )?(references|bibliography|literatur)$")


def is_reference_item(t: str) -> str:
    return yes(some(t, like("x", "^\\[[0-9]{1,3}\\] [A-Z]\\. [A-Z]")))


def line_count(t: str) -> str:
    return f"(length({t}) - length(replace({t}, chr(10), '')) + 1)"


def is_heading(t: str) -> str:
    shape = f"({like(flat(t), '^[0-9]+(\\.[0-9]+)*\\.? [A-Z]')} or {like(flat(t), '^[A-Z][A-Za-z-]*( (of|the|for|a|an|and|in|on|under|to|[A-Z][A-Za-z-]*))*$')})"
    return yes(f"{line_count(stripped(t))} <= 2 and length({flat(t)}) between 3 and 120 and {shape} and not {like(flat(t), '[.!?;:,]$')}")


def is_prose(t: str) -> str:
    return yes(f"({cjk_count(t)} >= 4 or (len({tokens(t)}) >= 5 and {stop_words(t)} >= 1))")


def is_statement(t: str) -> str:
    return like(stripped(t), "^(?i)(theorem|lemma|claim|definition|remark|proposition|corollary) [0-9]+[.:]")


def is_code_line(x: str) -> str:
    s = stripped(x)
    a = like(s, "^(def|class|import|from|return|for|while|if|else|elif|try|except|with|var|let|const|public|private|static|void|int)\\b.*[:;({]$")
    return f"({a} or {like(s, '^[A-Za-z_][A-Za-z0-9_.]*\\(.*\\);?$')} or {like(s, '^(//|/\\*|\\*/|#!)')} or {like(s, '[{};]$')})"


def is_code(t: str) -> str:
    n = f"len(list_filter({lines(t)}, lambda x: {is_code_line('x')}))"
    return yes(f"{n} >= 2 and {n} * 20 >= len({lines(t)}) * 7")


def is_identifier(t: str) -> str:
    return f"({is_url(t)} or {like(stripped(t), '^(?i)(\\(c\\)|copyright|doi:)')} or {like(stripped(t), '^[A-Za-z]{1,3}[0-9]{0,4}$')})"


def needs_translation(t: str) -> str:
    return f"({yes(f'(len({latin_words(t)}) >= 4 or (len({latin_words(t)}) >= 2 and {is_heading(t)}))')} and not {is_formula(t)} and not {is_code(t)} and not {is_reference_item(t)} and not {is_identifier(t)})"


def is_untranslated(s: str, a: str) -> str:
    return yes(
        f"(({compact(s)} <> '' and {compact(s)} = {compact(a)}) or ({cjk_count(a)} = 0 and len({latin_words(a)}) >= 3) or ({stop_words(a)} >= 3 and {stop_words(a)} > {cjk_count(a)}))"
    )


def goes_on(t: str) -> str:
    s = stripped(t)
    return yes(f"({s} <> '' and ({like(s, '[-,;]$')} or {like(s, '(?i)\\b(and|or|of|the|a|an|to|in|for|with|whereas)$')} or not {like(s, '[.!?:)\"”]$')}))")


def starts_inside(t: str) -> str:
    return like(stripped(t), "^[a-z,;)]")


def is_garbled(t: str) -> str:
    letters, vowels = count(t, "[A-Za-z]"), count(t, "[AEIOUYaeiouy]")
    solid = f"length({without_space(t)})"
    signs = f"({solid} - {count(t, '[A-Za-z0-9\\x{00C0}-\\x{024F}\\x{4E00}-\\x{9FFF}]')})"
    return yes(f"(({letters} >= 8 and {vowels} * 5 < {letters}) or ({solid} >= 8 and {signs} * 2 > {solid}))")


def class_of(t: str = "text", y: str = "y_min") -> str:
    margin = f"coalesce({y} < 62 or {y} > 745, false)"
    return (
        f"case when {t} is null or {is_blank(t)} then 'empty' when {margin} and {is_decorated(t)} then 'page_number' when {margin} then 'furniture' when {is_caption(t)} then 'caption' "
        f"when {is_reference_heading(t)} then 'reference_heading' when {is_reference_item(t)} then 'reference' when {is_formula(t)} or {is_equation_label(t)} then 'formula' "
        f"when {is_numeric_column(t)} or {is_metric(t)} then 'cell' when {is_statement(t)} then 'statement' when {is_heading(t)} then 'heading' when {is_prose(t)} then 'prose' else 'other' end"
    )


MARGIN = "coalesce(y_min < 62 or y_min > 745, false)"


def x_overlap(a: str = "a", b: str = "b") -> str:
    return f"greatest(0.0, least({a}.x_max, {b}.x_max) - greatest({a}.x_min, {b}.x_min))"


def y_overlap(a: str = "a", b: str = "b") -> str:
    return f"greatest(0.0, least({a}.y_max, {b}.y_max) - greatest({a}.y_min, {b}.y_min))"


def overlap_area(a: str = "a", b: str = "b") -> str:
    return f"({x_overlap(a, b)} * {y_overlap(a, b)})"


def width(a: str) -> str:
    return f"greatest(0.0, {a}.x_max - {a}.x_min)"


def height(a: str) -> str:
    return f"greatest(0.0, {a}.y_max - {a}.y_min)"


def area(a: str) -> str:
    return f"({width(a)} * {height(a)})"


def part(shared: str, whole: str) -> str:
    return f"case when {whole} > 0 then {shared} / {whole} else 0.0 end"


def x_ratio(a: str = "a", b: str = "b") -> str:
    return f"({part(x_overlap(a, b), f'least({width(a)}, {width(b)})')})"


def overlap_ratio(a: str = "a", b: str = "b") -> str:
    return f"({part(overlap_area(a, b), f'least({area(a)}, {area(b)})')})"
