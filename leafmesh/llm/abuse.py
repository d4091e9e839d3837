"""Scores of abusive, hateful and sexual language (problem 8), by a bidirectional gated recurrent network.

A text is read as units: words in one spelling (digits for letters, stretched, spaced and dotted words undone) and, in
Chinese, pairs of neighbouring ideographs. All overlapping windows of a text, to its end, go through the network; the
score of a document is that of its worst window. The network is trained on labels of documents: which windows of a
labelled document are to blame is settled in rounds, first by how often their units stand in flagged documents and then
by the network itself.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmesh.llm.abuse_seeds import HARMFUL, HARMLESS
from leafmesh.llm.forms import column, few, fold
from leafmesh.llm.recurrent import CHAR_BUCKETS, HIDDEN, WORD_BUCKETS, Adam, Network

#: Units of a window, and units from one window to the next.
WINDOW, STRIDE = 24, 8
#: Labelled documents that the network is fitted on at most, chosen by a hash of their id.
MAX_LABELLED = 3000
#: Other documents, chosen alike, whose windows are taken for harmless unless the network soon blames them.
MAX_UNLABELLED = 1500
#: Windows of harmless text in one round of training at most, for each window to blame, and at least.
PER_HARMFUL, LEAST_HARMLESS, MOST_WINDOWS = 16, 6000, 16_000
ROUNDS, EPOCHS, BATCH = 3, 4, 64
#: Share of the units that are hidden from the network while it is trained.
DROPPED = 0.1
#: A document is reported from this score on.
THRESHOLD = 0.5

_HAN = "㐀-䶿一-鿿豈-﫿"
_ASCII_TOKEN = re.compile(r"[a-z0-9@$*]+(?:[!'*#][a-z0-9@$*]+)*")
_TOKEN = re.compile(rf"[{_HAN}]+|[^\W_{_HAN}]+(?:[!'*#@$]+[^\W_{_HAN}]+)*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .·*_-]|\. )(?:[^\W\d_]\1){2,}[^\W\d_](?![.·*_-]?[^\W_])")
_BETWEEN_HAN = re.compile(rf"(?<=[{_HAN}])[·•*_.\-]{{1,2}}(?=[{_HAN}])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PLAIN = re.compile(r"[a-z]+")
_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "'": ""})


def _spelling(token: str) -> str:
    if token.isdigit():
        return "0"
    if any("a" <= c <= "z" for c in token):
        token = token.translate(_LETTERS)
    return _STRETCHED.sub(r"\1", token)


def units(text: str) -> list[str]:
    """The words of a text in one spelling, and the pairs of neighbours of each run of ideographs."""
    s = fold(text).casefold()
    s = _SPACED.sub(lambda m: re.sub(r"[\W_]+", "", m.group()), s)
    if s.isascii():
        return [t if _PLAIN.fullmatch(t) and not _STRETCHED.search(t) else _spelling(t) for t in _ASCII_TOKEN.findall(s)]
    out: list[str] = []
    for t in _TOKEN.findall(_BETWEEN_HAN.sub("", s)):
        if "㐀" <= t[0] <= "鿿" or "豈" <= t[0] <= "﫿":
            out.extend(t[k : k + 2] for k in range(len(t)))
        else:
            out.append(_spelling(t))
    return out


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


def _chars(unit: str) -> list[int]:
    """Buckets of the characters of a unit: the ideographs themselves, of words the runs of three and four."""
    if unit[0] > "⺀":
        return [_bucket(c, CHAR_BUCKETS) for c in unit]
    w = f"<{unit}>"
    return [_bucket(w[k : k + n], CHAR_BUCKETS) for n in (3, 4) for k in range(max(1, len(w) - n + 1))]


class Vocabulary:
    """Numbers of units, from 1, with their buckets."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.chars, self.owner = [0], [0], [0]

    def row(self, text: str) -> list[int]:
        out = []
        for u in units(text):
            k = self.number.get(u)
            if k is None:
                k = self.number[u] = len(self.number) + 1
                self.words.append(_bucket("w" + u, WORD_BUCKETS))
                c = _chars(u)
                self.chars.extend(c)
                self.owner.extend([k] * len(c))
            out.append(k)
        return out

    def subset(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with their units numbered anew, and the buckets of those units only."""
        used, again = np.unique(np.append(rows.ravel(), 0), return_inverse=True)
        new = np.full(len(self.words), -1)
        new[used] = np.arange(len(used))
        owner = new[np.asarray(self.owner)]
        return again[:-1].reshape(rows.shape), np.asarray(self.words)[used], np.asarray(self.chars)[owner >= 0], owner[owner >= 0]


def windows(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of all rows as one padded array, and the row of each; every unit is in a window."""
    out: list[list[int]] = []
    of: list[int] = []
    pad = [0] * WINDOW
    for k, row in enumerate(rows):
        if not row:
            continue
        a = 0
        while True:
            part = row[a : a + WINDOW]
            out.append(part + pad[len(part) :])
            of.append(k)
            if a + WINDOW >= len(row):
                break
            a += STRIDE
    return np.array(out, dtype=np.int64).reshape(-1, WINDOW), np.array(of, dtype=np.int64)


def scores(network: Network, table: np.ndarray, wins: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The probability of each window; table holds the projected units."""
    out = np.zeros(len(wins), np.float32)
    for a in range(0, len(wins), chunk):
        part = wins[a : a + chunk]
        out[a : a + chunk] = network.logits(table[part], (part > 0).astype(np.float32))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _first_blame(wins: np.ndarray, of: np.ndarray, flagged: np.ndarray, n_units: int) -> np.ndarray:
    """How much the units of each window stand in flagged documents rather than in others."""
    pairs = np.unique(np.stack([np.repeat(of, WINDOW), wins.ravel()], axis=1), axis=0)
    pairs = pairs[pairs[:, 1] > 0]
    bad = flagged[pairs[:, 0]]
    a = np.bincount(pairs[bad, 1], minlength=n_units) + 0.5
    b = np.bincount(pairs[~bad, 1], minlength=n_units) + 0.5
    odds = np.log(a / b) - np.log((flagged.sum() + 1) / (len(flagged) - flagged.sum() + 1))
    odds[0] = 0
    if flagged.sum() >= 30:
        odds[a < 2] = 0  # a unit of one flagged document says little once there are many of them
    return np.sort(odds[wins], axis=1)[:, -5:].mean(axis=1)


def train(labelled: list[tuple[str, bool]], others: list[str] = [], seed: int = 5) -> Network:  # noqa: B006
    """Fits the network on (text, flagged) of documents, on other documents and on the seed sentences; deterministic."""
    draw = np.random.default_rng(seed)
    vocabulary = Vocabulary()
    rows = [vocabulary.row(t) for t, _ in labelled] + [vocabulary.row(t) for t in others]
    flagged = np.array([y for _, y in labelled] + [False] * len(others), dtype=bool)
    unlabelled = np.arange(len(rows)) >= len(labelled)
    wins, of = windows(rows)
    neutral = [x for (t, y) in labelled if not y for x in re.split(r"(?<=[.!?。！？])\s*", t[:400])[:2] if x][:400] or [""]
    mixed: list[tuple[list[int], float]] = []
    for k, s in enumerate([*HARMFUL, *HARMLESS] * 2):
        # seed sentences stand alone and, the second time, between two sentences of harmless documents
        around = (neutral[k * 7 % len(neutral)], neutral[k * 13 % len(neutral)]) if k >= len(HARMFUL) + len(HARMLESS) else ("", "")
        row = vocabulary.row(f"{around[0][-60:]} {s} {around[1][:60]}")
        mixed.append((row[:WINDOW], float(k % (len(HARMFUL) + len(HARMLESS)) < len(HARMFUL))))
    seeds = np.array([r + [0] * (WINDOW - len(r)) for r, _ in mixed], dtype=np.int64)
    seed_y = np.array([y for _, y in mixed], dtype=np.float32)
    blame = _first_blame(wins, of, flagged, len(vocabulary.words)) if len(wins) else np.zeros(0)
    network = Network(seed)
    adam = Adam(network.weights)
    bad = flagged[of] if len(of) else np.zeros(0, dtype=bool)
    for turn in range(ROUNDS):
        positive, unclear = np.zeros(len(wins), dtype=bool), np.zeros(len(wins), dtype=bool)
        if bad.any():
            top = np.full(len(rows), -1e9)
            np.maximum.at(top, of[bad], blame[bad])
            # a flagged document in which nothing is to blame has a wrong label, and is left aside
            positive = bad & ((blame >= 0.6) if turn else (blame >= top[of] - 1e-9) & (blame > (1.5 if flagged.sum() >= 30 else 0)))
            unclear = bad & ~positive & ((blame > 0.1) | (top[of] < 0.6))
        weak = unlabelled[of] & (blame > (0.5 if turn else 2.0)) if len(of) else unclear
        p = np.flatnonzero(positive)
        p = draw.permutation(p)[: MOST_WINDOWS // 4]
        q = np.flatnonzero(~positive & ~unclear & ~weak)
        hard = q[np.argsort(-blame[q], kind="stable")[: 2 * len(p) + 200]]
        q = np.concatenate([hard, draw.permutation(q)[: min(MOST_WINDOWS, max(LEAST_HARMLESS, PER_HARMFUL * len(p)))]])
        x = np.concatenate([wins[p], wins[q], seeds])
        y = np.concatenate([np.ones(len(p), np.float32), np.zeros(len(q), np.float32), seed_y])
        weight = np.where(y > 0, min(3.0, max(1.0, 0.25 * (len(y) - y.sum()) / max(1.0, y.sum()))), 1.0).astype(np.float32)
        for epoch in range(EPOCHS):
            adam.rate = 3e-3 if turn < ROUNDS - 1 or epoch < 2 else 1e-3
            order = draw.permutation(len(y))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                sub, words, chars, owner = vocabulary.subset(np.where(draw.random(x[part].shape) < DROPPED, 0, x[part]))
                adam.update(network.gradients(sub, words, chars, owner, y[part], weight[part])[1])
        if turn < ROUNDS - 1 and len(wins):
            blame = scores(network, _table(network, vocabulary, 0), wins)
    return network


def _table(network: Network, vocabulary: Vocabulary, start: int) -> np.ndarray:
    """The projected units from `start` on."""
    owner = np.asarray(vocabulary.owner)
    at = np.searchsorted(owner, start)
    return network.projected(network.inputs(np.asarray(vocabulary.words[start:]), np.asarray(vocabulary.chars[at:]), owner[at:] - start))


class Scorer:
    """Scores texts, keeping the projected units that it has met."""

    def __init__(self, network: Network, most: int = 200_000) -> None:
        self.network, self.most = network, most
        self._reset()

    def _reset(self) -> None:
        self.vocabulary = Vocabulary()
        self.table = _table(self.network, self.vocabulary, 0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, windows, windows of at least THRESHOLD) of each text; texts without a word score 0."""
        if len(self.vocabulary.words) > self.most:
            self._reset()
        rows = [self.vocabulary.row(t) if t else [] for t in texts]
        if len(self.vocabulary.words) > len(self.table):
            self.table = np.concatenate([self.table, _table(self.network, self.vocabulary, len(self.table))])
        wins, of = windows(rows)
        best, hits = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if len(wins):
            # equal windows are scored once
            unique, again = np.unique(wins, axis=0, return_inverse=True)
            p = scores(self.network, self.table, unique)[again.ravel()]
            np.maximum.at(best, of, p)
            np.add.at(hits, of, p >= THRESHOLD)
        return best, np.bincount(of, minlength=len(texts)), hits


def labelled_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, bool]]:
    """(text, flagged) of at most `most` labelled documents, chosen by a hash of the id; ties of the raters are left out."""
    votes = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg(F.when(F.col("label") == "clean", 0.0).otherwise(1.0)).alias("_share"))
    chosen = votes.where("_share <> 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").collect()
    return [(r.text, r["_share"] > 0.5) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def unlabelled_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_UNLABELLED) -> list[str]:
    """At most `most` texts of documents without a label, chosen by a hash of the id."""
    chosen = documents.select("doc_id", "text").where("text is not null").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    return [r.text for r in few(chosen, ["doc_id"], most).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()]


SCORES = "doc_id bigint, source string, score double, windows bigint, hits bigint"


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, windows, hits): the score of every document, and its windows of at least THRESHOLD.

    Null, empty and wordless texts score 0; a null doc_id or source stays null; repeated rows are scored each. Extra columns
    are ignored. The network is trained by the driver on at most MAX_LABELLED labelled and MAX_UNLABELLED other documents and on
    the seed sentences, which alone hold harm where no labels are given; the documents themselves are neither shuffled nor sampled.
    """
    weights = train(labelled_documents(documents, labels), unlabelled_documents(documents, labels)).weights
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("windows", pa.int64()), ("hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network()
        network.weights = weights
        scorer = Scorer(network)
        for batch in batches:
            texts = column(batch, "text")
            for a in range(0, len(texts), 256):
                part = batch.slice(a, 256)
                best, n, hits = scorer(texts[a : a + 256])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), part.column(part.schema.get_field_index("source")), pa.array(best), pa.array(n), pa.array(hits)], schema=schema)

    return documents.select("doc_id", "source", "text").mapInArrow(run, SCORES)


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id): documents with a window of at least THRESHOLD."""
    return scored(documents, labels).where((F.col("score") >= THRESHOLD) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate): how many documents of each source are reported; a null source is one row."""
    s = scored(documents, labels).groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("flagged"))
    return s.withColumn("rate", F.col("flagged") / F.col("documents"))


__all__ = ["found", "labelled_documents", "rates", "scored", "train", "units", "windows"]
