import pytest
from pyspark.sql import functions as F

from leafmesh.operators import text as T


def one(spark, f, *values):
    d = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return d.select(f(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("normalized", " a \t b \n  c­d ", "a b\ncd"), ("normalized_translation", "\na\n\n\n\nb ", "a\n\nb"), ("normalized_english", "It’s  “A” , b .", "it's \"a\", b."), ("compact", "A-b 1é", "ab1"),
        ("compact_with_cjk", "A 汉-1", "a汉1"), ("cjk_only", "a汉b字", "汉字"), ("slug", " A  b-C! ", "a-b-c"), ("slug", "!!", "document"), ("joined_hyphens", "con-\ntroller\nx", "controller x"), ("first_sentence", "a b. c", "a b."),
        ("first_sentence", "a b", "a b"), ("with_terminal_marks", "这是一个很长的句子没有结尾标点", "这是一个很长的句子没有结尾标点。"), ("with_terminal_marks", "short", "short"), ("reflowed", "a\nb\n\n1. c\nd", "a b\n1. c d"), ("reflowed", "汉\n字", "汉字"),
        ("heading_level", "2.3.1 Title", 3), ("heading_level", "Title", 1), ("heading_number", "2.3", "2.3"), ("heading_number", "2.3 x", ""), ("enumeration_start", "(12) x", 12), ("enumeration_start", "x", None),
        ("reference_marker", "[12] A. B", "12"), ("without_garbled_lines", "good words here\nxkcdqrtzbnm", "good words here"), ("first_line", "\n  a \nb", "a"), ("first_line", " \n", None),
    ],
)
def test_functions(spark, name, value, want):
    assert one(spark, getattr(T, name), value) == want
    assert one(spark, getattr(T, name), None) in (None, 1, "document", "")


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("is_blank", [" \n　", ""], ["a"]), ("is_page_number", ["12", "• 3"], ["1234", "a"]), ("is_decorated_page_number", ["- 12 -", "| 7"], ["- a -"]), ("is_url", ["https://a.b/c"], ["see https://a.b"]), ("is_caption", ["Fig. 3. The", "Table 1: x"], ["Figure of", "The Table 1."]),
        ("is_equation_label", ["(12)"], ["12"]), ("is_formula", ["f(x) = x² + 1"], ["words are long and many = here"]), ("is_metric_cell", ["75.3%", "±0.13"], ["about 3 percent"]), ("is_numeric_column", ["1\n2.5\n3"], ["1"]),
        ("is_reference_heading", ["References", "7. Bibliography"], ["The references"]), ("is_reference_item", ["x\n[1] S. Ammira, H. Wildane."], ["[1] see"]), ("is_heading", ["2.1 The Cache", "Related Work"], ["a b", "It ends.", "A\nB\nC"]), ("is_code", ["def f(x):\nreturn g(x);"], ["a b"]),
        ("is_line_numbers", ["1\n2\n3"], ["1"]), ("is_key_values", ["a: 1\nb: 2"], ["a b\nc d"]), ("is_prose", ["we see that the cache is full", "汉字汉字"], ["Cache"]), ("is_statement", ["Lemma 3. It"], ["The lemma"]), ("goes_on", ["the cache, and the", "a-"], ["It ends."]), ("starts_inside", ["and so"], ["And"]),
        ("is_garbled", ["xkcdqrtzbnm", "€€€€€€€€€"], ["plain words"]), ("needs_translation", ["These four words matter"], ["x8", "12", ""]), ("needs_terminal_mark", ["这是一个很长的句子没有结尾标点"], ["短句", "这是一个很长的句子有结尾标点。"]), ("is_identifier", ["https://a.b", "(c) 2001", "C3"], ["Cache full"]),
    ],
)
def test_predicates(spark, name, good, bad):
    f = getattr(T, name)
    assert [one(spark, f, g) for g in good] == [True] * len(good)
    assert [one(spark, f, b) for b in bad] == [False] * len(bad)
    assert one(spark, f, None) is False


def test_untranslated(spark):
    for source, answer, want in (("The cache is full", "The cache is full", True), ("The cache is full", "缓存已满", False), ("The cache", "It is all in English", True), ("x", None, False)):
        assert one(spark, T.is_untranslated, source, answer) is want
