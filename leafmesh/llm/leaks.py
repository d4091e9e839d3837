"""Documents that hold passages of held-out items (problem 6), by suffix arrays.

The texts of a shard become one array of word ids, and one of ideographs, with a break between documents. All suffixes
of both are sorted, as far as the length that counts, and every suffix of every item is looked up by binary search in
each shard; all matches of an entry are taken. The alphabet is that of the items: any other word is one foreign id that
equals no entry of an item, so it stands in the array and ends every match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmesh.llm.forms import column, fold

#: Consecutive words, or consecutive ideographs, that make a leak.
WORDS, IDEOGRAPHS = 12, 24
#: A shard is closed at so many characters; a single longer document is a shard of its own.
SHARD = 8_000_000
#: Ids of the break between documents and of whatever no item holds.
BREAK, FOREIGN = 0, 1
#: Entries that are packed into one key.
_PACK = 4

_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_IDEOGRAPH = re.compile(f"[{_HAN}]")
_TOKEN = re.compile(rf"[{_HAN}]+|(?:(?![{_HAN}])[^\W_])+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")
_CUT = re.compile(r"([^\W_]+)-\s+([^\W_]+)")


def _tokens(form: str) -> list[str]:
    """The words of a canonical text in lower case; a run of ideographs stands as one entry between them."""
    return (_ASCII_TOKEN if form.isascii() else _TOKEN).findall(form)


def readings(form: str, vocabulary: dict[str, int]) -> list[list[str]]:
    """The words of a document's canonical text, in one or two readings of its hyphens before a space or line break.

    Such a hyphen cuts a word or belongs to a compound. If only one reading is of words of the items, that one is taken;
    where both are, the text is read twice, with all such words joined and with all of them apart.
    """
    if "-" not in form or not _CUT.search(form):
        return [_tokens(form)]
    twofold = False

    def settle(match: re.Match[str]) -> str:
        nonlocal twofold
        a, z = match.groups()
        if a + z not in vocabulary:
            return match.group()
        twofold |= a in vocabulary and z in vocabulary
        return a + z if joined or not (a in vocabulary and z in vocabulary) else match.group()

    joined = True
    first = _tokens(_CUT.sub(settle, form))
    if not twofold:
        return [first]
    joined = False
    return [first, _tokens(_CUT.sub(settle, form))]


def canonical_words(text: str) -> str:
    """The canonical characters of a text in lower case."""
    return fold(text).casefold()


class Items:
    """Every run of `length` entries of the items, as keys to look up."""

    def __init__(self, sequences: list[tuple[int, list[str]]], length: int) -> None:
        self.length = length
        self.vocabulary: dict[str, int] = {}
        starts: list[list[int]] = []
        owners: list[int] = []
        for item, entries in sequences:
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in entries]
            for k in range(len(ids) - length + 1):
                starts.append(ids[k : k + length])
                owners.append(item)
        self.bits = (len(self.vocabulary) + 2).bit_length()
        if self.bits * _PACK > 62:
            raise ValueError("the items hold too many different words for keys of 64 bits")
        runs = np.array(starts, dtype=np.int64).reshape(-1, length)
        self.owners = np.array(owners, dtype=np.int64)
        self.keys = [self._packed([runs[:, k + j] for j in range(_PACK)]) for k in range(0, length, _PACK)]

    def _packed(self, entries: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(entries[0]), dtype=np.int64)
        for x in entries:
            key = (key << self.bits) | x
        return key

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all suffixes of ids in order of their first `length` entries, and the packed keys by start."""
        n = len(ids)
        padded = np.concatenate([ids, np.full(self.length + _PACK, BREAK, dtype=np.int64)])
        key = self._packed([padded[j : j + n + self.length] for j in range(_PACK)])
        depth, rank = _PACK, np.unique(key, return_inverse=True)[1].astype(np.int64)
        while depth < self.length:
            step = min(depth, self.length - depth)
            pair = rank[:n] * (n + self.length) + np.concatenate([rank, np.zeros(step, dtype=np.int64)])[step : step + n]
            # a last step shorter than depth overlaps the first rank and ends at the wanted length
            rank = np.concatenate([np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1, np.zeros(self.length, dtype=np.int64)])
            depth += step
        return np.argsort(rank[:n], kind="stable"), key

    def _bisect(self, order: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(self.owners), dtype=np.int64), np.full(len(self.owners), len(order), dtype=np.int64)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            middle = (low[todo] + high[todo]) >> 1
            at = order[middle]
            less, equal = np.zeros(len(todo), dtype=bool), np.ones(len(todo), dtype=bool)
            for k, wanted in enumerate(self.keys):
                there, want = key[at + k * _PACK], wanted[todo]
                less |= equal & (there < want)
                equal &= there == want
            if after:
                less |= equal
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ids, item) of every match of every run."""
        if not len(self.owners) or len(ids) < self.length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        order, key = self.suffix_array(ids)
        low, high = self._bisect(order, key, False), self._bisect(order, key, True)
        counts = high - low
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return order[np.repeat(low, counts) + offsets], np.repeat(self.owners, counts)


def _pairs(documents: list[int], sequences: list[list[str]], items: Items) -> np.ndarray:
    """Distinct rows of (document, item) of one shard."""
    look = items.vocabulary.get
    lengths = np.fromiter((len(s) + 1 for s in sequences), dtype=np.int64, count=len(sequences))
    ids = np.fromiter((i for s in sequences for i in (*(look(x, FOREIGN) for x in s), BREAK)), dtype=np.int64, count=int(lengths.sum()))
    at, item = items.matches(ids)
    document = np.array(documents, dtype=np.int64)[np.searchsorted(np.cumsum(lengths), at, side="right")] if len(at) else at
    return np.unique(np.stack([document, item], axis=1), axis=0)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that share with the item a run of WORDS words or of IDEOGRAPHS ideographs.

    Words are of letters and digits. Case, punctuation, spacing, line breaks, hyphens and the differences of problem 1 are
    set aside, a compound counts as its single words, and ideographs end a run of words; a run of ideographs goes on over
    anything else. Null texts and ids take no part. The items are held by each task; the documents are not shuffled.
    """
    rows = [(int(r.item_id), canonical_words(r.text)) for r in items.select("item_id", "text").where("item_id is not null and text is not null").collect()]
    by_words = Items([(i, _tokens(form)) for i, form in rows], WORDS)
    by_ideographs = Items([(i, _IDEOGRAPH.findall(form)) for i, form in rows], IDEOGRAPHS)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])

    def shard(texts: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        forms = [(d, canonical_words(t)) for d, t in texts]
        english = [(d, s) for d, form in forms for s in readings(form, by_words.vocabulary)]
        chinese = [(d, s) for d, form in forms if not form.isascii() and (s := _IDEOGRAPH.findall(form))]
        for found, part in ((by_words, english), (by_ideographs, chinese)):
            pairs = _pairs([d for d, _ in part], [s for _, s in part], found)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for d, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                if held and size + len(t) > SHARD:
                    yield from shard(held)
                    held, size = [], 0
                held.append((d, t))
                size += len(t)
        if held:
            yield from shard(held)

    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    return texts.mapInArrow(search, "doc_id bigint, item_id bigint").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `documents` whose text holds no passage of an item; rows without doc_id or text are kept.

    Leaking ids are joined as they are, by a shuffle where they are many; all columns stay.
    """
    bad = leaked(documents, items).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")


__all__ = ["Items", "leaked", "readings", "without_leaks"]
