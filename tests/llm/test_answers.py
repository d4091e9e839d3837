import itertools
import random
import re

import numpy as np

from leafmesh.llm import answers
from leafmesh.llm.crf import Chain, _groups
from tests.llm.test_found import PAGES, block

SENTENCES = [
    ("The parser reads the sequence of the operator number {}.", "解析器读取第{}号算子的序列。"), ("However, the cache keeps a list of each of the {} entries.", "然而，缓存保存{}个条目中每一个的列表。"),
    ("In most cases the result is bounded by the vector {}.", "在大多数情况下，结果受第{}号向量限制。"), ("We leave the analysis of the {} graphs to future work.", "我们将{}个图的分析留作未来工作。"),
]


def pair(k):
    part = [SENTENCES[(k + j) % 4] for j in range(1 + k % 4)]
    return " ".join(a.format(k) for a, _ in part), "".join(z.format(k) for _, z in part)


def test_chain_agrees_with_enumeration():
    draw = np.random.default_rng(1)
    chain = Chain(3)
    chain.first, chain.last, chain.step = draw.normal(size=3), draw.normal(size=3), draw.normal(size=(3, 3))
    lengths = np.array([4, 1, 3, 0, 2])
    emit, gold = draw.normal(size=(10, 3)), draw.integers(0, 3, size=10)

    def score(e, y):
        return chain.first[y[0]] + chain.last[y[-1]] + sum(e[t, y[t]] for t in range(len(y))) + sum(chain.step[y[t - 1], y[t]] for t in range(1, len(y)))

    got, loss, a = chain.tag(emit, lengths), 0.0, 0
    for n in lengths:
        if n:
            e = emit[a : a + n]
            paths = list(itertools.product(range(3), repeat=int(n)))
            best = max(paths, key=lambda y: score(e, y))
            assert tuple(got[a : a + n]) == best
            loss += np.log(sum(np.exp(score(e, y)) for y in paths)) - score(e, gold[a : a + n])
        a += n
    value, de, g = chain.gradients(emit, lengths, gold)
    assert abs(value - loss / 5) < 1e-9
    emit2 = emit.copy()
    emit2[2, 1] += 1e-6
    assert abs((chain.gradients(emit2, lengths, gold)[0] - value) / 1e-6 - de[2, 1]) < 1e-4
    chain.step[0, 2] += 1e-6
    assert abs((chain.gradients(emit, lengths, gold)[0] - value) / 1e-6 - g["step"][0, 2]) < 1e-4


def test_held_out_defects():
    model = answers.train([pair(k) for k in range(400)])
    asked, given, want = [], [], []
    for k in range(1000, 1100):
        text, good = pair(k)
        for answer, defect in (
            (good, None), ("", "empty"), (None, "empty"), ("N/A", "empty"), ("（空）", "empty"), ("​", "empty"), ("非常抱歉，我无法翻译这段文字。", "refusal"), ("I cannot translate this text.", "refusal"),
            (text, "copied"), ("译文：" + text.upper(), "copied"), ("Ce résultat montre que parser reste stable. Sans cache, l'erreur peut augmenter.", "wrong_language"),
            (good[: len(good) // 2] + "……", "truncated"), (good[: len(good) * 2 // 3].rstrip("，。"), "truncated"),
        ):
            asked.append(answers.Block(text)), given.append(answer), want.append(defect)
    got = model.defects(given, asked)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_defects_of_dirty_tables(spark):
    pages, rows = [], []
    for k in range(300):
        text, good = pair(k)
        pages.append((f"d{k}", 1, None, [block("b1", text), block("b2", None), block("b3", "x8")]))
        rows.append((f"d{k}", 1, {"b1": good, "b3": "x8", "gone": "无此块。"}, 1))
    rows[0] = ("d0", 1, {"b1": "抱歉，我无法翻译这段文字。"}, 1)
    rows += [("d1", 1, {"b1": None}, 2), ("d2", 1, None, 2), ("d3", None, {"b1": ""}, 2), (None, 1, {"b1": ""}, 2), ("d4", 1, {}, 0)]
    p = spark.createDataFrame(pages + pages[:2], PAGES)
    t = spark.createDataFrame(rows, "document string, page int, translations map<string,string>, returned_at int")
    got = {tuple(r) for r in answers.defects(p, t).collect()}
    assert {x for x in got if x[0] in ("d0", "d1")} == {("d0", "b1", "refusal"), ("d1", "b1", "empty")}
    assert len(got) <= 6 and all(b == "b1" for _, b, _ in got)
    assert answers.defects(p.where("false"), t.where("false")).count() == 0


def test_a_pass_over_all_pairs_goes_on_from_the_sample(spark):
    start = answers.train([pair(k) for k in range(12)], frozenset(("parser",)))
    assert start.lexicon == {"parser"}
    made = answers.training_set([pair(k) for k in range(5000, 5200)], 8)

    def loss(model):
        return model.gradients(*model.marked(*made))[0]

    before, rows = loss(start), [pair(k) for k in range(12, 4000)]
    model = answers.refined(start, spark.createDataFrame([*rows, ("The parser reads it.", None), ("x", "")], "text string, answer string").repartition(2))
    assert loss(start) == before and loss(model) < before and model.lexicon == start.lexicon
    assert answers.refined(start, spark.createDataFrame([("x", None)], "text string, answer string")) is start
    # every sound pair takes part, not only those of the sample
    met = answers.refined(answers.Model(), spark.createDataFrame([("Ꝏ reads the cache of it.", "读取它的缓存。")] * 3, "text string, answer string"))
    assert any(w.any() for w in met.weights())


def test_words_are_counted_over_all_pages(spark, monkeypatch):
    pages, rows = [], []
    for k in range(60):
        text, good = pair(k)
        pages.append((f"d{k}", 1, None, [block("b1", text), block("b2", "The ambit.")]))
        rows.append((f"d{k}", 1, {"b1": good}, 1))
    seen = []
    monkeypatch.setattr(answers, "training_pairs", lambda *_: [pair(k) for k in range(40)])
    monkeypatch.setattr(answers, "tagger", lambda model, real=answers.tagger: seen.append(model) or real(model))
    answers.defects(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, "document string, page int, translations map<string,string>, returned_at int")).count()
    assert "ambit" in seen[0].lexicon


def test_the_pass_reads_each_block_once(monkeypatch):
    made = []

    class Counted(answers.Block):
        def __init__(self, text):
            made.append(text)
            super().__init__(text)

    monkeypatch.setattr(answers, "Block", Counted)
    rows = [pair(k) for k in range(200)]
    got = answers.training_set(answers.sound_of(rows, frozenset()), 8)
    answers.Model().marked(*got)
    assert made == [text for text, _ in rows]
    assert all(b.known() is b.known() and b.canonical() is b.canonical() for b in got[1])


def test_a_block_counts_as_the_plain_patterns_do():
    stop = re.compile(r"(?<![.…])[.!?。！？](?!\.)[\"'”’)）\]」]*(?=\s|$)|[。！？]")
    abbreviation, words = re.compile(r"\b[^\W\d_]{1,4}\.(?=\s+\d)"), re.compile(r"[^\W\d_]{2,}")
    draw = random.Random(4)
    texts = ["", "See Fig. 3. It ends... so? Yes! 好。」", "a b c dé x²y ½ Ωμ ok", "one two-\nthree\xad \n four ¬\nfive -\nsix", "Ｆｕｌｌ w\u200bidth – “a” Жук \ud800 end.\u3000", "".join(map(chr, range(0x3100)))]
    texts += ["".join(draw.choice("aBé ßЖ字1²_.…!?。！”)」-\xad¬\n\u3000 \x1f’:–") for _ in range(draw.randrange(60))) for _ in range(3000)]
    for text in texts:
        b, body = answers.Block(text), text.strip()
        assert b.sentences == len(stop.findall(abbreviation.sub(lambda m: m.group()[:-1], body)))
        assert b.open == (not re.search(r"[.!?。！？:：][\s\"'”’)）\]」]*$", body))
        assert (b.letters, b.han) == (sum(map(len, words.findall(body))), sum("㐀" <= c <= "鿿" for c in body))
        assert min(b.words, 17) == min(len(body.split()), 17)
        own = answers.fold(text).casefold()
        assert {w for w in b.known() if len(w) > 1} == {*words.findall(own), *words.findall(re.sub(r"(?<=\w)[-­¬]\s*\n\s*", "", own))}


def test_draws_are_those_of_numpy():
    for seed in range(3):
        got, want = answers.Draws(seed), np.random.default_rng(seed)
        for end in [*range(1, 40), 2**31 + 5, 3 * 2**30] * 150:
            assert got.below(end) == want.integers(end)
            assert end % 3 or got.random() == want.random()


def test_groups_hold_sequences_of_like_length():
    lengths = np.random.default_rng(2).geometric(0.1, size=3000) - 1
    groups = _groups(lengths, 200)
    assert np.array_equal(np.concatenate(groups), np.argsort(lengths, kind="stable"))
    for g, after in zip(groups, [*groups[1:], None], strict=True):
        least = max(1, lengths[g[0]])
        assert len(g) <= 200 and lengths[g[-1]] <= least + least // 4
        assert after is None or len(g) == 200 or lengths[after[0]] > least + least // 4
