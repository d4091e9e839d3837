import __spark_entry__ as entry
import pytest

BLOCK = "array<struct<id string, page int, block_index int, xMin double, yMin double, xMax double, yMax double, text string, preserve_image boolean>>"
PAGES = f"document string, page int, source string, blocks {BLOCK}"


def block(name, text, y=100.0, page=1):
    return (name, page, 0, 60.0, y, 500.0, y + 10, text, None)


@pytest.fixture()
def sf_dir(spark, tmp_path):
    def write(rows, name="source_pages", ddl=PAGES):
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_p1_found(spark, sf_dir):
    rows = [("d", 1, None, [block("b1", "efficient code"), block("b2", "eﬃcient  code"), block("b3", "Efficient code"), block("b4", "efficient\ncode")])]
    got = {tuple(r) for r in entry.queries()["p1_found"](spark, sf_dir(rows + rows)).collect()}
    assert got == {("d", "b1", "b2"), ("d", "b2", "b4")}


def test_p2_found(spark, sf_dir):
    line = "This copy was served by the archive of the society"
    rows = [(f"d{k}", 1, "s", [block("b1", f"own text number {k} of nothing repeated here {chr(97 + k) * 5}\n{k}. {line.upper() if k % 2 else line}")]) for k in range(4)]
    rows += [(f"e{k}", 1, None, [block("b1", line)]) for k in range(4)]
    out = entry.queries()["p2_found"](spark, sf_dir(rows + rows[:1]))
    assert out.columns == ["document", "block_id", "line_no"]
    assert sorted(tuple(r) for r in out.collect()) == [(f"d{k}", "b1", 2) for k in range(4)]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def brute(entries, item, length):
    runs = {tuple(item[k : k + length]) for k in range(len(item) - length + 1)}
    return any(tuple(entries[k : k + length]) in runs for k in range(len(entries) - length + 1))


def test_p6_found(spark, sf_dir):
    item = "If Zavrin walks from Sivaneby at nine well-known miles and rests beside the compact asynchronous gate."
    chinese = "一艘名为尼叶凯的渡轮载着不变式假设以及属于假说计数器的箱子驶过湾"
    docs = [
        (1, "So: " + item.upper() + " And more."),
        (2, "x if zavrin walks from sivaneby at nine well known miles and rests"),  # twelve words
        (3, "x if zavrin walks from sivaneby at nine well-known miles, and"),  # eleven
        (4, "at nine well-\nknown miles and rests beside the com-\npact asyn-\nchronous gate at"),
        (5, "at ｎｉｎｅ well‑known mi​les and rests beside the соmpact asynchronous gate"),
        (6, chinese[:12] + " 12 ab,\n" + chinese[12:24]),
        (7, chinese[:23]),
        (8, None), (9, ""), (10, "at nine well known miles 一 and rests beside the compact asynchronous"),
        (11, "at nine well known miles and rests"), (12, "beside the compact asynchronous gate"),
    ]
    sf_dir(docs, "documents", "doc_id bigint, text string")
    d = sf_dir([(70, item), (71, chinese), (72, item)], "eval_items", "item_id bigint, text string")
    got = {tuple(r) for r in entry.queries()["p6_found"](spark, d).collect()}
    assert got == {(k, i) for k in (1, 2, 4, 5) for i in (70, 72)} | {(6, 71)}


def test_p6_matches_are_those_of_brute_force():
    import random

    from leafmesh.llm import leaks

    draw = random.Random(3)
    for length in (leaks.WORDS, leaks.IDEOGRAPHS):
        items = [(k, draw.choices("ab", k=length + 3)) for k in range(8)]
        docs = [draw.choices("abc" if k % 2 else "ab", k=draw.randint(1, 3000)) for k in range(20)]
        pairs = leaks._pairs(list(range(20)), docs, leaks.Items(items, length))
        assert {tuple(map(int, p)) for p in pairs} == {(d, i) for d, s in enumerate(docs) for i, x in items if brute(s, x, length)}


def test_p7_shares_are_met(spark, sf_dir):
    docs = [(k, "x" * (20 + k % 50), "a" if k % 3 else "b") for k in range(3000)] + [(4000, None, "a"), (4001, "other", "z"), (4002, "", "b")]
    sf_dir(docs, "documents", "doc_id bigint, text string, source string")
    d = sf_dir([("a", 0.3, 2), ("b", 0.7, 3), ("none", 0.0, 1)], "mix_targets", "source string, target_share double, max_repeats int")
    rows = entry.queries()["p7_copies"](spark, d).collect()
    assert sorted(r.doc_id for r in rows) == [*range(3000), 4000, 4002]
    used = {s: sum(r.tokens * r.copies for r in rows if r.source == s) for s in "ab"}
    assert {r.copies for r in rows if r.source == "b" and r.tokens} == {3}  # the shortest source gives all it may
    assert {r.copies for r in rows if r.source == "a" and r.tokens} == {0, 1}
    assert abs(used["a"] - used["b"] * 0.3 / 0.7) <= 71 / 2
    assert {r.doc_id: r.tokens for r in rows}[0] == len(__import__("leafmesh.llm.mixing", fromlist=["x"]).encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary("x" * 20))
    assert all(r.copies == 0 for r in rows if not r.tokens)
    out = {r.source: r for r in entry.queries()["p7_shares"](spark, d).collect()}
    assert set(out) == {"a", "b", "none"} and abs(out["a"].actual_share - 0.3) < 1e-3 and out["b"].tokens == used["b"] and out["none"].tokens == 0


def test_p2_texts_without_repeats_of_a_null_page(spark):
    from leafmesh.llm.chunks import texts_without_repeats

    line = "This copy was served by the archive of the society"
    rows = [(f"d{k}", None if k < 2 else 1, "s", [block("b1", f"own\n{line}"), block("b2", None)]) for k in range(4)]
    out = {(r.document, r.page, r.block_id): (r.text, r.cut) for r in texts_without_repeats(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {(f"d{k}", None if k < 2 else 1, b): v for k in range(4) for b, v in (("b1", ("own", 1)), ("b2", (None, 0)))}
