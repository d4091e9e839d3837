"""Defects of answers to blocks of text (problem 3), by tags on the answer's clauses.

An answer is split into clauses, and a conditional random field tags each as answer, refusal, echo, foreign or unfinished.
The characters under each tag, and how much of the block the answering clauses cover, make the defect of the pair. The
field is trained on sound pairs and on defects made from them: answers cut short, refusals and texts in other languages put
in their place, and the block itself given back. It begins with a sample; a pass over all pairs goes on from there.
"""

from __future__ import annotations

import copy
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmesh.llm.answers_seeds import COURTESIES, FOREIGN, REFUSALS
from leafmesh.llm.chunks import repeated_lines
from leafmesh.llm.crf import Chain
from leafmesh.llm.forms import column, few, fold
from leafmesh.llm.quality import running_words
from leafmesh.llm.structure import kind
from leafmesh.pages import blocks, in_margin, latest_pages
from leafmesh.session import written

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN_TAG, UNFINISHED = range(5)
#: Pages of answers, chosen by a hash of their key, with whose pairs training begins; pages for each of which a word of running text is counted thrice.
TRAINING_PAGES = 700
#: Length of a step in the pass over all pairs.
RATE = 0.05
#: Steps of training; buckets of pairs of characters.
STEPS, BUCKETS = 140, 1 << 12
# Pairs of characters are hashed by it; twice it is under 2^31.
PRIME = 1_000_000_007
#: Words that a title may have.
TITLE_WORDS = 16
#: Kinds of block whose answers are judged.
JUDGED = frozenset(("prose", "caption", "statement", "heading"))
# Words that stand where an answer was not filled in; fixed values.
PLACEHOLDERS = frozenset("na n/a null none nil nan undefined tbd todo empty blank 空 无 略 暂无 空白 待译 待翻译 未翻译 译文 翻译 无内容 无译文 此处为空".split())

_SPACE, _MARK, _HAN, _LATIN, _DIGIT, _OTHER = range(6)
_ENDS = frozenset("。！？!?；;\n…｡")
# these begin with the mark itself, which is found much faster than what may stand before it
_STOP = re.compile(r"[.!?。！？](?:(?<=[。！？])|(?<![.…].)(?!\.)[\"'”’)）\]」]*(?=\s|$))")
_NUMBERED = re.compile(r"\.\s+\d")
_ABBREVIATION = re.compile(r"\b[^\W\d_]{1,4}\.(?=\s+\d)")
_TERMINAL = re.compile(r"[.!?。！？:：][\s\"'”’)）\]」]*$")
_COMMAS = frozenset("，,、；;（(")
_TERMINALS = frozenset(".!?。！？:：")
_CLOSERS = "\"'”’)）]」" + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ELLIPSIS = re.compile(r"(?:…|\.{3}|。{2,}|⋯)[\s\"'”’)）\]」]*$")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_IDEOGRAPHS = re.compile("[㐀-鿿]+")
_FULL_STOPS = re.compile("[。！？]+")
_PIECES = re.compile(r"(?<=[。！？；，])")
_DIVIDED = re.compile(r"[-­¬](?<=\w.)\s*\n\s*")
_WIDE_LETTER = re.compile(r"[^\W\d_\x00-\xff]")
# Latin-1 with a space for all that is no letter
_LETTERS = bytes(c if chr(c).isalnum() and not chr(c).isdecimal() else 32 for c in range(256))
_AS_MARK = bytes(32 if c == 32 else 97 for c in range(256))
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: its class, its end mark (1; of a sentence 2), and what its lower-case form adds to the hash of a pair as first and as second.

    Digits are all one digit there. Ideographs beyond the plane are told by their code.
    """
    if not _TABLES:
        mark = np.array([2 if chr(c) in "。！？!?" else chr(c) in _ENDS for c in range(0x10000)], dtype=np.int8)
        cls, low = np.full(0x10000, _MARK, dtype=np.int8), np.arange(0x10000, dtype=np.int64)
        for code in range(0x10000):
            ch = chr(code)
            cat = unicodedata.category(ch)
            if cat[0] == "Z" or cat in ("Cc", "Cf", "Mn"):
                cls[code] = _SPACE
            elif 0x3400 <= code <= 0x9FFF or 0xF900 <= code <= 0xFAFF:
                cls[code] = _HAN
            elif cat[0] == "L":
                cls[code] = _LATIN if code < 0x250 or 0x1E00 <= code < 0x1F00 else _OTHER
            elif cat[0] == "N":
                cls[code] = _DIGIT
            if len(small := ch.lower()) == 1:
                low[code] = ord(small)
        low[cls == _DIGIT] = 48
        _TABLES.extend((cls, mark, (low * 31_337 % PRIME).astype(np.int32), (low * 1_000_003 % PRIME).astype(np.int32)))
    return _TABLES[0], _TABLES[1], _TABLES[2], _TABLES[3]


class Block:
    """What is asked of the answer to a block: its sentences, its letters, whether it breaks off itself, and its words, counted as far as a title may have."""

    __slots__ = ("_canonical", "_known", "han", "letters", "open", "sentences", "text", "words")

    def __init__(self, text: str) -> None:
        self.text = text
        body = text.strip()
        plain = _ABBREVIATION.sub(lambda m: m.group()[:-1], body) if _NUMBERED.search(body) else body
        self.sentences = len(_STOP.findall(plain))
        self.open = body.rstrip(_CLOSERS)[-1:] not in _TERMINALS
        self.letters = _letters(body)
        self.words = len(body.split(None, TITLE_WORDS))
        self.han = _ideographs(body) if not body.isascii() else 0
        self._canonical: str | None = None
        self._known: frozenset[str] | None = None

    def canonical(self) -> str:
        """The text in canonical characters; made once."""
        if self._canonical is None:
            self._canonical = fold(self.text)
        return self._canonical

    def known(self) -> frozenset[str]:
        """The block's words in canonical lower case, those divided at a line end also as one; made once."""
        if self._known is None:
            own = self.canonical().casefold()
            words = _words(own)
            if "\n" in own and (joined := _DIVIDED.sub("", own)) != own:
                words += _words(joined)
            self._known = frozenset(words)
        return self._known


def _spaced(text: str) -> bytes | None:
    """The text in Latin-1 with a space for each character that is no letter; None if it holds letters beyond Latin-1."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        if _WIDE_LETTER.search(text):
            return None
        raw = text.encode("latin-1", "replace")
    return raw.translate(_LETTERS)


def _letters(text: str) -> int:
    """Letters of a text that stand in words of two letters or more."""
    spaced = _spaced(text)
    if spaced is None:
        return sum(map(len, _WORDS.findall(text)))
    marks = b" " + spaced.translate(_AS_MARK) + b" "
    single = marks.replace(b" ", b"  ") if b" a a " in marks else marks
    return len(marks) - marks.count(b" ") - single.count(b" a ")


def _words(text: str) -> list[str]:
    """The words that _WORDS finds, and such of one letter."""
    spaced = _spaced(text)
    return _WORDS.findall(text) if spaced is None else spaced.decode("latin-1").split()


def _ideographs(text: str) -> int:
    return sum(map(len, _IDEOGRAPHS.findall(text)))


DENSE = 40


class Clauses:
    """The clauses of many answers with their features: arrays over clauses, and over the pairs of their characters."""

    def __init__(self, answers: list[str], asked: list[Block]) -> None:
        cls, mark, as_first, as_second = _tables()
        n = len(answers)
        lengths = np.fromiter(map(len, answers), dtype=np.int64, count=n)
        codes = np.frombuffer("".join(answers).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = np.minimum(codes, 0xFFFF)
        kinds = cls[small]
        if (codes > 0xFFFF).any():
            kinds = np.where(codes > 0xFFFF, np.where(codes >= 0x20000, _HAN, _MARK), kinds).astype(np.int8)
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        marks = mark[small]
        ends = marks > 0
        following = np.append(kinds[1:], np.int8(_SPACE))
        ends |= (codes == ord(".")) & (following == _SPACE)
        stops = (marks > 1) | (codes == ord(".")) & ends
        cut = np.zeros(len(codes), dtype=bool)
        if len(codes):
            cut[1:] = (ends[:-1] & (following[:-1] != _MARK)) | (owner[1:] != owner[:-1])
            cut[0] = True
        number = np.cumsum(cut, dtype=np.int32) - 1
        total = int(number[-1]) + 1 if len(codes) else 0
        counts = np.bincount(number * 6 + kinds, minlength=total * 6).reshape(-1, 6) if total else np.zeros((0, 6), dtype=np.int64)
        solid = counts[:, _HAN] + counts[:, _LATIN] + counts[:, _DIGIT] + counts[:, _OTHER]
        of = owner[np.flatnonzero(cut)] if total else np.zeros(0, dtype=np.int64)
        kept = np.flatnonzero(solid > 0)
        begins = np.flatnonzero(cut)
        finish = np.append(begins[1:], len(codes)) if total else begins
        self.of, self.solid = of[kept], solid[kept]
        self.lengths = np.bincount(self.of, minlength=n)
        self.han = np.bincount(self.of, weights=counts[kept, _HAN], minlength=n)
        self.solids = np.bincount(self.of, weights=self.solid, minlength=n).astype(np.int64)
        # an end mark counts once where several stand together
        single = stops & ~np.append(np.zeros(1, dtype=bool), (stops & (following >= 0))[:-1])[: len(stops)]
        sentences = np.bincount(owner[single], minlength=n) if len(codes) else np.zeros(n, dtype=np.int64)
        self._dense(answers, asked, counts[kept], sentences, begins[kept] if total else kept, finish[kept] if total else kept, np.cumsum(lengths) - lengths)
        # pairs of neighbouring characters, white space left out, each within one clause
        there = np.flatnonzero(kinds != _SPACE)
        letters = small[there]
        new = np.full(total + 1, -1, dtype=np.int32)
        new[kept] = np.arange(len(kept))
        clause = new[number[there]] if len(there) else there
        both = np.flatnonzero((clause[1:] == clause[:-1]) & (clause[1:] >= 0))
        hashed = as_first[letters[both]] + as_second[letters[both + 1]] if len(both) else np.zeros(0, dtype=np.int32)
        self.bucket = (np.where(hashed >= PRIME, hashed - PRIME, hashed) % BUCKETS).astype(np.int64)
        self.pair_of = clause[both].astype(np.int64)
        per = np.bincount(self.pair_of, minlength=len(kept))
        self.scale = 1.0 / np.sqrt(np.maximum(per, 1))

    def _dense(self, answers: list[str], asked: list[Block], counts: np.ndarray, sentences: np.ndarray, begins: np.ndarray, finish: np.ndarray, offset: np.ndarray) -> None:
        n = len(self.of)
        x = np.zeros((n, DENSE))
        solid = np.maximum(1, self.solid)
        han, latin, other = counts[:, _HAN] / solid, counts[:, _LATIN] / solid, counts[:, _OTHER] / solid
        b_letters = np.array([b.letters for b in asked], dtype=float)
        b_open = np.array([b.open for b in asked], dtype=bool)
        b_sentences = np.array([b.sentences for b in asked], dtype=np.int64)
        heading = b_open & np.array([b.words <= TITLE_WORDS and b.sentences == 0 for b in asked], dtype=bool)
        tails = [a.rstrip()[-8:] for a in answers]
        closed = np.array([bool(_TERMINAL.search(t)) for t in tails], dtype=bool)
        dots = np.array([bool(_ELLIPSIS.search(t)) for t in tails], dtype=bool)
        comma = np.array([t[-1:] in _COMMAS for t in tails], dtype=bool)
        lacking = b_sentences - sentences
        ratio = self.han / np.maximum(1.0, b_letters)
        first = np.append(True, self.of[1:] != self.of[:-1]) if n else np.zeros(0, dtype=bool)
        last = np.append(self.of[1:] != self.of[:-1], True) if n else np.zeros(0, dtype=bool)
        p = self.of
        for k, v in enumerate((
            np.ones(n), han >= 0.5, han >= 0.8, latin >= 0.3, latin >= 0.6, other >= 0.1, other >= 0.3, solid < 4, solid < 8, solid < 16, first, last, first & last,
            last & closed[p] & ~dots[p], last & dots[p], last & ~closed[p] & ~dots[p] & ~b_open[p], last & ~closed[p] & b_open[p] & ~heading[p], last & comma[p],
            last & (lacking[p] >= 1), last & (lacking[p] >= 2), last & (lacking[p] == 0), last & (lacking[p] < 0),
            last & (lacking[p] >= 1) & ~heading[p] & (ratio[p] < 0.24), last & (lacking[p] >= 1) & b_open[p],
            *((last & ~heading[p] & (ratio[p] < r)) for r in (0.08, 0.14, 0.19, 0.23, 0.27)),
            *((last & heading[p] & (ratio[p] < r)) for r in (0.08, 0.12, 0.16, 0.2)),
        )):
            x[:, k] = v
        # words that the clause shares with the block; only clauses with letters other than ideographs can
        rows = np.flatnonzero((latin + other >= 0.3) & (self.solid >= 2))
        share = np.full(len(rows), np.nan)
        for k, (row, a, z) in enumerate(zip(p[rows].tolist(), (begins[rows] - offset[p[rows]]).tolist(), (finish[rows] - offset[p[rows]]).tolist(), strict=True)):
            b = asked[row]
            if b.han * 2 < max(1, b.letters):
                words = [w for w in _words(fold(answers[row][a:z]).casefold()) if len(w) > 1]
                if words:
                    share[k] = sum(map(b.known().__contains__, words)) / len(words)
        x[rows, 33], x[rows, 34], x[rows, 35], x[rows, 36] = share >= 0.3, share >= 0.6, share >= 0.85, share < 0.3
        self.dense = x

    def emissions(self, dense: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        out = self.dense @ dense
        if len(self.bucket):
            at = np.flatnonzero(np.append(True, self.pair_of[1:] != self.pair_of[:-1]))
            sums = np.stack([np.add.reduceat(own[self.bucket], at) for own in np.ascontiguousarray(hashed.T)], axis=1)
            out[self.pair_of[at]] += sums * self.scale[self.pair_of[at], None]
        return out


class Model:
    """The field: weights of clause features, of pairs of characters, and of transitions; with the words of running text."""

    def __init__(self, lexicon: frozenset[str] = frozenset()) -> None:
        self.dense, self.hashed, self.chain, self.lexicon = np.zeros((DENSE, 5)), np.zeros((BUCKETS, 5)), Chain(5), lexicon

    def fit(self, answers: list[str], asked: list[Block], tags: list[int], cut: list[bool], steps: int = STEPS) -> None:
        """tags: the tag of all clauses of an answer; cut: whether its last clause is unfinished."""
        c, y = self.marked(answers, asked, tags, cut)
        params = self.weights()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            for k, (p, d) in enumerate(zip(params, self.gradients(c, y)[1], strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p -= 0.08 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def marked(self, answers: list[str], asked: list[Block], tags: list[int], cut: list[bool]) -> tuple[Clauses, np.ndarray]:
        """The clauses of answers with their tags."""
        c = Clauses(answers, asked)
        y = np.array(tags, dtype=np.int64)[c.of]
        last = np.append(c.of[1:] != c.of[:-1], True)
        y[last & np.array(cut, dtype=bool)[c.of]] = UNFINISHED
        return c, y

    def weights(self) -> list[np.ndarray]:
        return [self.dense, self.hashed, self.chain.first, self.chain.last, self.chain.step]

    def gradients(self, c: Clauses, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss of an answer, and the gradients of the weights."""
        loss, de, g = self.chain.gradients(c.emissions(self.dense, self.hashed), c.lengths, y)
        scaled = np.ascontiguousarray((de * c.scale[:, None]).T)
        gh = np.stack([np.bincount(c.bucket, weights=scaled[k][c.pair_of], minlength=BUCKETS) for k in range(5)], axis=1)
        return loss, [c.dense.T @ de + 1e-4 * self.dense, gh + 2e-4 * self.hashed, g["first"], g["last"], g["step"]]

    def defects(self, answers: list[str | None], asked: list[Block]) -> list[str | None]:
        """The defect of each pair, or None."""
        plain = [a or "" for a in answers]
        c = Clauses(plain, asked)
        tags = self.chain.tag(c.emissions(self.dense, self.hashed), c.lengths) if len(c.of) else np.zeros(0, dtype=np.int64)
        n = len(plain)
        share = np.bincount(c.of * 5 + tags, weights=c.solid, minlength=5 * n).reshape(n, 5)
        out: list[str | None] = []
        for a, solid, (answered, refused, echoed, foreign, unfinished) in zip(plain, c.solids.tolist(), share.tolist(), strict=True):
            total = max(1.0, answered + refused + echoed + foreign + unfinished)
            if solid == 0 or (solid <= 12 and _is_placeholder(a)):
                out.append("empty")
            elif refused >= 0.5 * total:
                out.append("refusal")
            elif echoed >= 0.5 * total:
                out.append("copied")
            elif foreign >= 0.5 * total or echoed + foreign >= 0.6 * total:
                out.append("copied" if echoed > foreign else "wrong_language")
            elif unfinished > 0:
                out.append("truncated")
            else:
                out.append(None)
        return out


def _bare(line: str) -> str:
    return re.sub(r"\W+", "", fold(line)).casefold()


def _is_placeholder(answer: str) -> bool:
    return re.sub(r"[^\w/]+", "", fold(answer)).strip("/_").casefold() in PLACEHOLDERS


class Draws:
    """The numbers of numpy's default generator one at a time, from blocks of its raw output: a call of its own costs ten times as much."""

    def __init__(self, seed: int) -> None:
        self.raw = np.random.default_rng(seed).bit_generator.random_raw
        self.block: list[int] = []
        self.half: int | None = None

    def _next(self) -> int:
        if not self.block:
            self.block = self.raw(4096)[::-1].tolist()
        return self.block.pop()

    def random(self) -> float:
        return (self._next() >> 11) * 2.0**-53

    def below(self, end: int) -> int:
        """One of 0 to end - 1, each as likely (Lemire's method); end is under 2^32."""
        if end == 1:
            return 0
        while True:
            if self.half is None:
                whole = self._next()
                self.half, part = whole >> 32, whole & 0xFFFFFFFF
            else:
                self.half, part = None, self.half
            wide = part * end
            if (low := wide & 0xFFFFFFFF) >= end or low >= (0x100000000 - end) % end:
                return wide >> 32


def training_set(pairs: list[tuple[str | Block, str]], seed: int = 3) -> tuple[list[str], list[Block], list[int], list[bool]]:
    """Sound pairs of (block, answer) and the defects made from them, with their tags."""
    pairs = [(text if isinstance(text, Block) else Block(text), answer) for text, answer in pairs]
    draws = Draws(seed)
    draw, below = draws.random, draws.below
    answers: list[str] = []
    asked: list[Block] = []
    tags: list[int] = []
    cut: list[bool] = []

    def add(answer: str, block: Block, tag: int, unfinished: bool = False) -> None:
        if answer.strip():
            answers.append(answer)
            asked.append(block)
            tags.append(tag)
            cut.append(unfinished)

    def pick(options: tuple | list) -> str:  # noqa: ANN401
        return options[below(len(options))]

    for k, (b, answer) in enumerate([p for p in pairs for _ in range(2)]):
        text = b.text
        if k % 2 == 0:
            add(answer, b, ANSWER)
        long = len(answer) >= 4
        turn = below(10)
        pieces = [p for p in _PIECES.split(answer) if p.strip()] if turn in (2, 3) else []
        heading = b.open and b.sentences == 0 and b.words <= TITLE_WORDS
        if turn in (0, 1) and long and heading:
            # a short title says little by its length: only one that is broken off visibly is taken for unfinished
            add(answer[: max(1, len(answer) // 2)] + pick(("……", "...", "…")), b, ANSWER, True)
        elif turn in (0, 1) and long:
            least = max(1, len(answer) // 8)
            at = least + below(max(2, (3 * len(answer)) // 4) - least)
            stem = answer[:at].rstrip("。！？；，、")
            add(stem + pick(("", "……", "...", "…", "，")), b, ANSWER, True)
        elif turn in (2, 3) and len(pieces) > 1:
            stem = "".join(pieces[: 1 + below(len(pieces) - 1)])
            add(stem if draw() < 0.6 else stem.rstrip("。！？；，、") + pick(("……", "...", "。")), b, ANSWER, True)
        elif turn in (4, 8, 9):
            add(pick(("", "", "您好，", "非常抱歉，")) + pick(REFUSALS) + pick(("", "", pick(COURTESIES), pick(REFUSALS) + pick(COURTESIES))), b, REFUSAL)
        elif turn == 5:
            same = " ".join(text.split())
            add(pick(("", "", "译文：", "翻译：", "Translation: ", "“")) + (same.upper() if draw() < 0.25 else same if draw() < 0.7 else text).rstrip(". ") + pick((".", "。", "", "”")), b, ECHO)
        elif turn == 6:
            words = _WORDS.findall(text) or ["x"]
            start = 4 * below(len(FOREIGN) // 4)
            add("".join(pick(FOREIGN[start : start + 4]).format(pick(words)) + pick(("", " ")) for _ in range(1 + below(5))), b, FOREIGN_TAG)
        elif turn == 7 and k >= 8:
            strange = " ".join(pairs[below(k // 2)][0].text.split())
            if strange[:40] != " ".join(text.split())[:40]:
                add(strange, b, FOREIGN_TAG)
    return answers, asked, tags, cut


def is_sound(block: Block, answer: str) -> bool:
    """Whether a pair may stand for a good one in training: mostly ideographs, as many sentences, ended as the block is."""
    han = _ideographs(answer)
    ends = len(_FULL_STOPS.findall(answer))
    solid = sum(map(len, answer.split()))
    if han < 2 or han < 0.5 * solid or not 0.1 <= han / max(1, block.letters) <= 0.8 or _ELLIPSIS.search(answer.rstrip()[-8:]):
        return False
    return ends >= block.sentences and (block.open or bool(_TERMINAL.search(answer.rstrip()[-4:])))


def _paired(pages: DataFrame, translations: DataFrame) -> DataFrame:
    """(document, block_id, text, margin, answer) of the entries that have a block; the text is without repeated lines."""
    lines = repeated_lines(pages).groupBy("document", "block_id").agg(F.collect_set("line_no").alias("_cut"))
    b = blocks(pages.select("document", "page", "source", "blocks")).where("document is not null and block_id is not null and text is not null")
    b = b.select("document", "block_id", "text", in_margin().alias("margin"))
    t = latest_pages(translations.select("document", "page", "translations", "returned_at"), "returned_at")
    t = t.select("document", F.explode("translations").alias("block_id", "answer"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_cut", (i + 1).cast("int"))), "\n")
    joined = b.join(lines, ["document", "block_id"], "left").join(t, ["document", "block_id"])
    return joined.select("document", "block_id", "margin", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept).alias("text"), "answer")


def training_pairs(pages: DataFrame, translations: DataFrame, most: int = TRAINING_PAGES) -> list[tuple[str, str | None]]:
    """(text, answer) of the entries of at most `most` pages of answers, chosen by a hash of their key."""
    chosen = few(translations.where("size(translations) > 0").select("document", "page", "translations"), ["document", "page"], most).dropDuplicates(["document", "page"])
    b = pages.select("document", "page", "blocks").join(F.broadcast(chosen), ["document", "page"]).select("translations", F.explode("blocks").alias("b"), "document")
    b = b.select("document", "b.id", "b.text", F.col("translations")[F.col("b.id")].alias("answer")).where("id is not null and text is not null")
    return [(r.text, r.answer) for r in sorted(b.dropDuplicates(["document", "id"]).collect(), key=lambda r: (r.document, r.id))]


def sound_of(pairs: list[tuple[str, str | None]], lexicon: frozenset[str]) -> list[tuple[Block, str]]:
    """The pairs that may stand for good ones in training."""
    return [(b, answer) for text, answer in pairs if answer and is_sound(b := Block(text), answer) and kind(b.canonical(), lexicon) in JUDGED]


def refined(model: Model, pairs: DataFrame) -> Model:
    """The field after a pass over all pairs of (text, answer).

    Each task goes on from the model by a gradient step for each batch of its sound pairs and the defects made from them; the
    weights of the tasks are averaged by the answers that they saw. Only sums of weights are sent to the driver.
    """
    schema = pa.schema([("slot", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = copy.deepcopy(model), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sound = sound_of(list(zip(column(part, "text"), column(part, "answer"), strict=True)), model.lexicon)
                if sound:
                    made = training_set(sound, zlib.crc32(sound[0][0].text.encode("utf-8", "surrogatepass")))
                    c, y = own.marked(*made)
                    if len(y):
                        for p, d in zip(own.weights(), own.gradients(c, y)[1], strict=True):
                            p -= RATE * d
                        seen += len(made[0])
        if seen:
            flat = np.concatenate([*(w.ravel() for w in own.weights()), np.ones(1)]) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], schema=schema)

    sums = pairs.select("text", "answer").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return model
    flat = np.zeros(len(sums))
    for r in sums:
        flat[r.slot] = r.value
    out, at = copy.deepcopy(model), 0
    for w in out.weights():
        w[...] = flat[at : at + w.size].reshape(w.shape) / flat[-1]
        at += w.size
    return out


def train(sample: list[tuple[str, str | None]], lexicon: frozenset[str] | None = None) -> Model:
    """The field fitted on a sample of (block, answer); answers may be None. Without a lexicon the words of the sample are it."""
    if lexicon is None:
        words: Counter[str] = Counter()
        for text, _ in sample:
            words.update(re.findall(r"\b[a-zäöüßéèàçñ]{2,}\b", fold(text)))
        lexicon = frozenset(w for w, n in words.items() if n >= 3)
    sound = sound_of(sample, lexicon)
    model = Model(lexicon)
    if sound:
        model.fit(*training_set(sound))
    return model


SCHEMA = pa.schema([("document", pa.string()), ("block_id", pa.string()), ("defect", pa.string())])


def tagger(model: Model):  # noqa: ANN201
    """A function from batches of (document, block_id, margin, text, answer) to the defective pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                texts, answers, margins = column(part, "text"), column(part, "answer"), column(part, "margin")
                # a running header above the text in one block need not be answered, and may be given back
                bodies = list(texts)
                for k, (t, m) in enumerate(zip(texts, margins, strict=True)):
                    if m and "\n" in t:
                        header, bodies[k] = t.split("\n", 1)
                        top, _, rest = (answers[k] or "").partition("\n")
                        if rest.strip() and _bare(top) == _bare(header):
                            answers[k] = rest
                found = model.defects(answers, [Block(t) for t in bodies])
                keep = [k for k, d in enumerate(found) if d and not (margins[k] and "\n" not in texts[k].strip()) and kind(fold(bodies[k]), model.lexicon) in JUDGED]
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).take(pa.array(keep)) for c in ("document", "block_id")] + [pa.array([found[k] for k in keep])], schema=SCHEMA)

    return run


def defects(pages: DataFrame, translations: DataFrame) -> DataFrame:
    """(document, block_id, defect): the entries whose answer is empty, truncated, a refusal, copied or in another language.

    Entries without a block, and blocks that are no prose, caption, statement or heading, are left out; a null answer is
    empty; of several deliveries of a page of answers the last counts; null maps, ids and texts take no part. Extra columns
    are ignored; empty tables give no rows. Words are counted over all pages. The driver begins the training of the field with
    the pairs of at most TRAINING_PAGES pages; the tasks go on with all pairs, which are written once and read twice.
    """
    pairs = written(_paired(pages, translations), "pairs")
    model = refined(train(training_pairs(pages, translations), running_words(pages, TRAINING_PAGES)), pairs)
    return pairs.mapInArrow(tagger(model), "document string, block_id string, defect string").distinct()


__all__ = ["Block", "Clauses", "Model", "defects", "refined", "train", "training_set"]
