"""Statistics of the text of each document, and the documents that are not prose (problem 5).

The statistics of a page are sums over its blocks; margins, headings, captions and the lines of problem 2 are set aside.
Pages are summed where they are read, and only rows of sums are shuffled. Boosted trees tell prose from lists, tables and
junk by the statistics of a document. They are fitted on weak labels, which rules on single blocks give, and their
probabilities are calibrated on a holdout that was checked by hand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmesh.llm.chunks import Repeats, repeats
from leafmesh.llm.forms import column, few, fold, nested
from leafmesh.llm.quality_holdout import CHECKED
from leafmesh.llm.structure import FUNCTION_WORDS, kind
from leafmesh.llm.trees import Boosted
from leafmesh.pages import BOTTOM_MARGIN, TOP_MARGIN
from leafmesh.session import written

#: Documents, chosen by a hash of their name, that the trees are fitted on at most; pages for each of which a word of running text is counted thrice.
TRAINING_DOCUMENTS, LEXICON_PAGES = 4000, 300
#: Documents of at least this probability are no prose.
THRESHOLD = 0.5

#: What is summed over the blocks of a page.
SUMS = (
    "blocks", "lines", "chars", "letters", "digits", "symbols", "words", "word_chars", "common", "long_words", "capitals", "numeric", "vowelless",
    "ended_lines", "short_lines", "bullet_lines", "comma_lines", "tab_lines", "sentences", "latin1", "prose_chars", "list_chars", "table_chars", "junk_chars",
)
#: Statistics of a document, in the order of the features of the trees.
STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "ended_line_share", "common_word_share", "short_line_share", "mean_line_length",
    "numeric_share", "vowelless_share", "bullet_line_share", "comma_line_share", "tab_line_share", "capital_share", "long_word_share", "words_per_sentence", "latin1_ratio",
    "list_share", "table_share", "junk_share",
)
_RUNNING_WORD = re.compile(r"\b[a-zäöüßéèàçñ]{2,}\b")
_VOWELS = frozenset("aeiouyäöüáàâéèêëíìîïóòôúùû")
_LIST, _TABLE = frozenset(("list", "names")), frozenset(("table", "cell", "formula"))


_TABLES: list[np.ndarray] = []
_LETTER, _DIGIT, _SPACE, _UPPER, _VOWEL, _END, _BULLET, _LATIN1, _STOP = (1 << k for k in range(9))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags and lower-case form of each code point of the basic plane, and the sorted hashes of the function words."""
    if not _TABLES:
        flags, low = np.zeros(0x10000, dtype=np.uint16), np.arange(0x10000, dtype=np.uint64)
        for code in range(0x10000):
            ch = chr(code)
            f = _LETTER * ch.isalpha() | _DIGIT * ch.isdigit() | _SPACE * ch.isspace() | _UPPER * ch.isupper()
            f |= _VOWEL * (ch.lower() in _VOWELS) | _END * (ch in ".!?。！？:;") | _BULLET * (ch in "-•*·‣[") | _LATIN1 * (0x80 <= code <= 0xFF or ch in "€™œ") | _STOP * (ch in "。！？")
            flags[code] = f
            if len(small := ch.lower()) == 1:
                low[code] = ord(small)
        hashes = []
        for w in FUNCTION_WORDS:
            h = 0
            for k, ch in enumerate(w):
                h = (h + ord(ch) * pow(int(_BASE), k, 1 << 64)) % (1 << 64)
            hashes.append(h)
        _TABLES.extend((flags, low, np.sort(np.array(hashes, dtype=np.uint64))))
    return _TABLES[0], _TABLES[1], _TABLES[2]


def text_sums(texts: list[str], groups: list[str], of: list[int], n: int) -> np.ndarray:
    """The sums of n pages over their texts; of gives the page of each text, groups its part among prose, list, table and junk.

    Texts are joined and counted as one array of characters; lines, words and tokens are runs in it.
    """
    out = np.zeros((n, len(SUMS)))
    if not texts:
        return out
    flags, low, common = _tables()
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(codes, 0xFFFF)
    f = flags[small]
    page = np.repeat(np.array(of), np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))

    def count(where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(page[where], weights=weights, minlength=n)

    letter, digit, space = (f & _LETTER) > 0, (f & _DIGIT) > 0, (f & _SPACE) > 0
    previous = np.append(True, space[:-1])
    following = np.append(space[1:], True)
    ends = np.flatnonzero(codes == 10)
    begins = np.append(0, ends[:-1] + 1)
    at = np.arange(len(codes))
    last = np.maximum.reduceat(np.where(space, -1, at), begins)
    first = np.minimum.reduceat(np.where(space, len(codes), at), begins)
    solid = np.add.reduceat((~space).astype(np.int64), begins)
    real = solid > 0
    first, last, begins, solid = first[real], last[real], begins[real], solid[real]
    marks = np.append(0, np.cumsum((codes == 9) | (codes == 124)))
    commas = np.append(0, np.cumsum(codes == 44))
    ended = (f[last] & _END) > 0
    dotted = np.zeros(len(first), dtype=bool)
    for k in (1, 2, 3):
        here = np.minimum(first + k, len(codes) - 1)
        dotted |= digit[first] & (here < last) & ((codes[here] == 46) | (codes[here] == 41)) & following[here]
    head = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    tail = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
    size = tail - head
    vowels = np.append(0, np.cumsum((f & _VOWEL) > 0))
    power = np.full(len(codes), _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(codes), _INVERSE, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    prefix = np.append(np.uint64(0), np.cumsum(low[small] * power))
    hashed = (prefix[tail] - prefix[head]) * back[head]
    known = common[np.minimum(np.searchsorted(common, hashed), len(common) - 1)] == hashed
    token, token_end = np.flatnonzero(~space & previous), np.flatnonzero(~space & following)
    stop = ((f & _STOP) > 0) | (((codes == 46) | (codes == 33) | (codes == 63)) & following)
    chars, letters, digits = count(~space), count(letter), count(digit)
    columns = [
        np.bincount(of, minlength=n), count(first), chars, letters, digits, chars - letters - digits, count(head), letters, count(head[known]), count(head[size > 14]), count(head[(f[head] & _UPPER) > 0]),
        count(token[digit[token] | digit[token_end]]), count(head[(size > 2) & (vowels[tail] == vowels[head])]), count(last[ended]), count(last[solid < 22]), count(first[((f[first] & _BULLET) > 0) | dotted]),
        count(last[(commas[last] > commas[first]) & ~np.isin(codes[last], (46, 33, 63))]), count(last[marks[last + 1] > marks[begins]]), count(stop), count((f & _LATIN1) > 0),
    ]
    whole = np.add.reduceat((~space).astype(np.int64), np.append(0, np.cumsum([len(t) + 1 for t in texts])[:-1]))
    for g in ("prose", "list", "table", "junk"):
        columns.append(np.bincount(of, weights=whole * np.array([x == g for x in groups]), minlength=n))
    return np.stack(columns, axis=1).astype(float)


def group_of(form: str, lexicon: frozenset[str] = frozenset()) -> str | None:
    """The part of a block among prose, list, table and junk; None if it is empty, a heading or a caption."""
    what = kind(form, lexicon)
    if what in ("empty", "heading", "caption"):
        return None
    return "list" if what in _LIST else "table" if what in _TABLE else "junk" if what == "junk" else "prose"


def block_sums(text: str, lexicon: frozenset[str] = frozenset()) -> list[float] | None:
    """The sums of one block, or None if it is empty, a heading or a caption."""
    form = fold(text)
    group = group_of(form, lexicon)
    return None if group is None else text_sums([form], [group], [0], 1)[0].tolist()


def page_sums(batch: pa.RecordBatch, repeated: Repeats | None, lexicon: frozenset[str] = frozenset()) -> np.ndarray:
    """The sums of the blocks of each row of a batch of pages, margins and repeated lines set aside."""
    row, _, flat = nested(batch, "blocks")
    y = pc.struct_field(flat, "yMin")
    text = pc.struct_field(flat, "text")
    inner = pc.and_(pc.fill_null(pc.and_(pc.greater_equal(y, TOP_MARGIN), pc.less_equal(y, BOTTOM_MARGIN)), True), pc.is_valid(text))
    forms = [fold(t) for t in text.filter(inner).to_pylist()]
    rows = row[inner.to_numpy(zero_copy_only=False)].tolist()
    sources = column(batch, "source")
    clear = repeated.without_all([sources[k] for k in rows], forms) if repeated else forms
    kept = [(k, form, group) for k, form in zip(rows, clear, strict=True) if (group := group_of(form, lexicon)) is not None]
    return text_sums([t for _, t, _ in kept], [g for _, _, g in kept], [k for k, _, _ in kept], batch.num_rows)


def statistics_of(sums: dict[str, Column | float]) -> dict[str, Column]:
    """The statistics as columns over sums; ratios of nothing are 0."""
    c = {k: F.col(k) if isinstance(v, str) else v for k, v in sums.items()}

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return {
        "words": c["words"], "mean_word_length": ratio(c["word_chars"], c["words"]), "symbol_ratio": ratio(c["symbols"], c["chars"]), "digit_ratio": ratio(c["digits"], c["chars"]),
        "letter_ratio": ratio(c["letters"], c["chars"]), "ended_line_share": ratio(c["ended_lines"], c["lines"]), "common_word_share": ratio(c["common"], c["words"]), "short_line_share": ratio(c["short_lines"], c["lines"]),
        "mean_line_length": ratio(c["chars"], c["lines"]), "numeric_share": ratio(c["numeric"], c["numeric"] + c["words"]), "vowelless_share": ratio(c["vowelless"], c["words"]), "bullet_line_share": ratio(c["bullet_lines"], c["lines"]),
        "comma_line_share": ratio(c["comma_lines"], c["lines"]), "tab_line_share": ratio(c["tab_lines"], c["lines"]), "capital_share": ratio(c["capitals"], c["words"]), "long_word_share": ratio(c["long_words"], c["words"]),
        "words_per_sentence": ratio(c["words"], c["sentences"]), "latin1_ratio": ratio(c["latin1"], c["chars"]), "list_share": ratio(c["list_chars"], c["chars"]), "table_share": ratio(c["table_chars"], c["chars"]),
        "junk_share": ratio(c["junk_chars"], c["chars"]),
    }


def running_words(pages: DataFrame, per: int = LEXICON_PAGES, least: int = 3) -> frozenset[str]:
    """Words in lower case that stand `least` times at least, and as often for each `per` pages, counted over all pages.

    The bound goes with the pages: a name that a large corpus happens to hold in lower case does not become a word. Words so
    frequent are few, whatever the corpus holds; only they are sent to the driver. Each delivery of a page is counted.
    """
    there = pages.where("document is not null and page is not null and blocks is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            # pieces were counted as they stand; words are taken from the distinct ones
            words: Counter[str] = Counter()
            for piece, n in pieces.items():
                for w in _RUNNING_WORD.findall(fold(piece)):
                    words[w] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in pc.list_flatten(batch.column(0)).to_pylist():
                if text:
                    pieces.update(text.split())
            if len(pieces) > 500_000:
                yield flush()
        if pieces:
            yield flush()

    counts = there.select(F.col("blocks.text").alias("texts")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in counts.where(F.col("n") >= least * max(1.0, there.count() / per)).select("word").collect())


def sums(pages: DataFrame) -> DataFrame:
    """(document, *SUMS): one row per document; a page that was delivered twice counts once."""
    lexicon = running_words(pages)
    repeated, source = repeats(pages)
    schema = pa.schema([("document", pa.string()), ("page", pa.int64()), ("loaded_at", pa.timestamp("us", "UTC")), *((k, pa.float64()) for k in SUMS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 50):
                part = batch.slice(a, 50)
                rows = page_sums(part, repeated, lexicon)
                keys = [part.column(part.schema.get_field_index(c)) for c in ("document", "page", "loaded_at")]
                yield pa.RecordBatch.from_arrays([keys[0], keys[1].cast(pa.int64()), keys[2].cast(pa.timestamp("us", "UTC")), *(pa.array(x) for x in rows.T)], schema=schema)

    texts = F.transform("blocks", lambda b: F.struct(b.yMin.alias("yMin"), b.text.alias("text"))).alias("blocks")
    read = source.where("document is not null and page is not null").select("document", "page", F.col("loaded_at").cast("timestamp").alias("loaded_at"), "source", texts)
    ddl = "document string, page bigint, loaded_at timestamp, " + ", ".join(f"{k} double" for k in SUMS)
    per_page = read.mapInArrow(run, ddl)
    latest = per_page.groupBy("document", "page").agg(F.max_by(F.struct(*SUMS), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))).alias("s"))
    return latest.groupBy("document").agg(*(F.sum(f"s.{k}").alias(k) for k in SUMS))


def weak_label(row: dict[str, float]) -> int:
    """1 if more than half of the characters of a document stand in blocks that the rules call list, table or junk."""
    structure = row["list_chars"] + row["table_chars"] + row["junk_chars"]
    return int(structure > 0.5 * max(1.0, row["chars"]))


def fit(rows: list[dict[str, float]]) -> Boosted:
    """Trees fitted on weak labels of rows with SUMS and STATISTICS, calibrated on the holdout checked by hand."""
    x = np.array([[r[k] for k in STATISTICS] for r in rows], dtype=float).reshape(-1, len(STATISTICS))
    y = np.array([weak_label(r) for r in rows])
    weight = np.where(y > 0, max(1.0, (len(y) - y.sum()) / max(1, y.sum()) / 2), 1.0)
    model = Boosted(trees=40, depth=3).fit(x, y, weight)
    return model.calibrate(np.array([c[1:] for c in CHECKED], dtype=float), np.array([c[0] for c in CHECKED]))


def judged(pages: DataFrame) -> DataFrame:
    """(document, *STATISTICS, probability): the statistics of every document and the probability that it is no prose.

    Documents of nothing but margins, headings and captions have statistics of 0 and probability 0. Null documents, pages and
    texts take no part; blocks without coordinates count as text; extra columns are ignored; an empty table gives no rows.
    The trees are fitted by the driver on the statistics of at most TRAINING_DOCUMENTS documents.
    """
    total = written(sums(pages), "sums")
    table = total.select("document", *SUMS, *(v.alias(f"s_{k}") for k, v in statistics_of({k: k for k in SUMS}).items()))
    sample = sorted(few(table.where("chars > 0"), ["document"], TRAINING_DOCUMENTS).collect(), key=lambda r: r.document)
    model = fit([{k: float(r[k]) for k in SUMS} | {k: float(r[f"s_{k}"]) for k in STATISTICS} for r in sample])
    schema = pa.schema([("document", pa.string()), *((k, pa.float64()) for k in STATISTICS), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(batch.schema.get_field_index(f"s_{k}")).to_numpy(zero_copy_only=False), dtype=float) for k in STATISTICS], axis=1)
            chars = batch.column(batch.schema.get_field_index("chars")).to_numpy(zero_copy_only=False)
            p = np.where(chars > 0, model.probability(x), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("document")), *(pa.array(v) for v in x.T), pa.array(p)], schema=schema)

    return table.select("document", "chars", *(f"s_{k}" for k in STATISTICS)).mapInArrow(run, "document string, " + ", ".join(f"{k} double" for k in STATISTICS) + ", probability double")


def found(pages: DataFrame) -> DataFrame:
    """(document): the documents that are lists, tables or junk rather than prose."""
    return judged(pages).where(F.col("probability") >= THRESHOLD).select("document")


__all__ = ["STATISTICS", "SUMS", "block_sums", "fit", "found", "judged", "sums", "weak_label"]
