"""Lines repeated across the documents of one source (problem 2).

The letters of a block form one stream; line breaks, digits, punctuation, spaces and case are no part of it. The stream
is cut where the rolling hash of eight letters is the smallest of ten in a row (content-defined chunking): the cuts
depend on the letters alone, and any 28 letters in a row hold two cuts that do not depend on what stands around them.
Each line of 28 letters or more is anchored by the chunk of smallest hash between its first and last such cut, so equal
wordings have equal anchors whatever block or page they stand in. Distinct documents are counted for each chunk and
source; lines with a chunk that is not repeated enough are out, and the wording of the rest is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmesh.llm.forms import column, fold
from leafmesh.pages import blocks
from leafmesh.session import written

#: Letters of a rolling hash; hashes of a window; the least letters of a line, which must hold two windows.
GRAM, WINDOW, LEAST = 8, 10, 28
#: A wording is repeated excessively if at least so many documents and this share of the source's documents hold it.
MIN_DOCUMENTS, MIN_SHARE = 4, 0.2

assert LEAST >= GRAM - 1 + 2 * WINDOW - 1  # two windows without common hashes

#: No letter has this code point or a higher one.
LETTERS = 0x34000

_TABLES: list[np.ndarray] = []
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded case and letter flag of each code point that can be a letter; the last entry stands for all others."""
    if not _TABLES:
        lower, letter = np.arange(LETTERS + 1, dtype=np.uint32), np.zeros(LETTERS + 1, dtype=bool)
        for code in range(LETTERS):
            ch = chr(code)
            if ch.isalpha():
                letter[code] = True
                if len(small := ch.casefold()) == 1:
                    lower[code] = ord(small)
        _TABLES.extend((lower, letter))
    return _TABLES[0], _TABLES[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_lines(texts: list[str]) -> dict[str, np.ndarray]:
    """Arrays over the lines of at least LEAST letters: text (index), line (from 1), letters, chars, anchor and wording (hashes)."""
    none = np.zeros(0, dtype=np.int64)
    empty = {"text": none, "line": none, "letters": none, "chars": none, "anchor": none, "wording": none}
    if not texts:
        return empty
    lower, letter = _tables()
    codes = np.frombuffer("\n".join(map(fold, texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, LETTERS)
    is_letter = letter[low]
    breaks = codes == 10
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_of_line = np.repeat(np.arange(len(texts)), per_text)
    first_line = np.cumsum(per_text) - per_text
    line_of_char = np.cumsum(breaks) - breaks
    stream = lower[low[is_letter]].astype(np.uint64)
    line_of = line_of_char[is_letter]
    n_lines = len(text_of_line)
    letters = np.bincount(line_of, minlength=n_lines)
    chars = np.bincount(line_of_char, minlength=n_lines) - 1
    keep = np.flatnonzero(letters >= LEAST)
    if not len(keep):
        return empty
    start = np.cumsum(letters) - letters
    n = len(stream)
    hashed = _mix(stream + np.uint64(0x1234567))
    rolling = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        rolling = rolling * _BASE + hashed[k : n - GRAM + 1 + k]
    place = np.arange(len(rolling), dtype=np.uint64)
    key = (_mix(rolling) & ~np.uint64((1 << 28) - 1)) | place
    two = np.minimum(key[:-1], key[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    lowest = (np.minimum(eight[:-2], two[8:]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    text_of = text_of_line[line_of]
    whole = text_of[: len(lowest)] == text_of[WINDOW + GRAM - 2 : WINDOW + GRAM - 2 + len(lowest)]
    cuts = np.unique(lowest[whole])
    power = np.full(n + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(n + 1, _INVERSE, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashed * power[:n], out=prefix[1:])
    chunk = _mix((prefix[cuts[1:]] - prefix[cuts[:-1]]) * inverse[cuts[:-1]])
    a, z = start[keep], start[keep] + letters[keep]
    first = np.searchsorted(cuts, lowest[a])
    last = np.searchsorted(cuts, lowest[z - GRAM + 1 - WINDOW])
    spans = np.empty(2 * len(keep), dtype=np.int64)
    spans[0::2], spans[1::2] = first, last
    anchor = np.minimum.reduceat(np.append(chunk, np.uint64(0xFFFFFFFFFFFFFFFF)), spans)[0::2]
    wording = _mix((prefix[z] - prefix[a]) * inverse[a])
    texts_of_kept = text_of_line[keep]
    return {
        "text": texts_of_kept, "line": keep - first_line[texts_of_kept] + 1, "letters": letters[keep], "chars": chars[keep],
        "anchor": anchor.view(np.int64), "wording": wording.view(np.int64),
    }


def line_wordings(texts: list[str], folded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, wording) of the lines of at least LEAST letters, as `long_lines` has them, without any chunk.

    folded: the texts have canonical characters already.
    """
    lower, letter = _tables()
    codes = np.frombuffer("\n".join(texts if folded else map(fold, texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(codes, LETTERS)
    is_letter = letter[low]
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_of_line = np.repeat(np.arange(len(texts)), per_text)
    first_line = np.cumsum(per_text) - per_text
    line_of = np.cumsum(codes == 10)[is_letter]
    letters = np.bincount(line_of, minlength=len(text_of_line))
    keep = np.flatnonzero(letters >= LEAST)
    ends = np.cumsum(letters)
    hashed = _mix(lower[low[is_letter]].astype(np.uint64) + np.uint64(0x1234567))
    power = np.full(len(hashed) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    prefix = np.zeros(len(hashed) + 1, dtype=np.uint64)
    np.cumsum(hashed * power[:-1], out=prefix[1:])
    inverse = np.full(len(hashed) + 1, _INVERSE, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    z = ends[keep]
    a = z - letters[keep]
    wording = _mix((prefix[z] - prefix[a]) * inverse[a])
    return text_of_line[keep], keep - first_line[text_of_line[keep]] + 1, wording.view(np.int64)


def safe_groups(texts: list[str], most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` characters together, or a single longer text: arrays that fit the cache are faster.

    The place of a cut has 28 bits, so a single text may have 2^28 letters.
    """
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


_LINES = pa.schema([("source", pa.string()), ("document", pa.string()), ("page", pa.int32()), ("block_id", pa.string()), ("line_no", pa.int32()), ("chars", pa.int32()), ("anchor", pa.int64()), ("wording", pa.int64())])
LINES_DDL = "source string, document string, page int, block_id string, line_no int, chars int, anchor bigint, wording bigint"


def _chunk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        for a, z in safe_groups(texts):
            x = long_lines(texts[a:z])
            rows = pa.array(x["text"] + a)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("source", "document", "page", "block_id")),
                     pa.array(x["line"].astype(np.int32)), pa.array(x["chars"].astype(np.int32)), pa.array(x["anchor"]), pa.array(x["wording"])], schema=_LINES)


def chunked_lines(pages: DataFrame) -> DataFrame:
    """One row per line of at least LEAST letters in a document with a source, with its anchor chunk and its wording."""
    b = blocks(pages.select("document", "page", "source", "blocks")).where("source is not null and document is not null and block_id is not null and text is not null")
    b = b.select("source", "document", F.col("page").cast("int").alias("page"), "block_id", "text")
    return b.mapInArrow(_chunk_lines, LINES_DDL)


#: Wordings that are sent to all tasks at most; beyond that they are joined by the shuffle.
MOST_WORDINGS = 500_000
#: Parts that the lines of one key are spread over in such a join.
SALTS = 32


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """`big` joined with the few rows of `small`, though one key may hold a third of all rows of `big`.

    `small` is written and counted: at most MOST_WORDINGS rows are sent to all tasks; otherwise each of its rows is repeated
    for SALTS parts, into which the rows of `big` fall by the hash of the column `salt`.
    """
    few = written(small, "small")
    if few.limit(MOST_WORDINGS + 1).count() <= MOST_WORDINGS:
        return big.join(F.broadcast(few), keys)
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")
    parts = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_part", part).join(parts, [*keys, "_part"]).drop("_part")


def excessive(lines: DataFrame, pages: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of `lines` whose wording is repeated excessively within its source.

    Documents are counted over hashes of their names, first for each chunk and source, then exactly for the wording of the
    lines whose chunk is repeated enough; equal wordings share their anchor, so the first count loses none.
    """
    sizes = pages.where("source is not null and document is not null").select("source", "document").distinct().groupBy("source").agg(F.count("*").alias("_n"))
    sizes = sizes.select("source", F.greatest(F.lit(min_documents), F.ceil(F.col("_n") * min_share - F.lit(1e-9))).alias("_least"))
    chunks = lines.select("source", "anchor", F.xxhash64("document").alias("_d")).distinct().groupBy("source", "anchor").agg(F.count("*").alias("_docs"))
    repeated = chunks.where(F.col("_docs") >= min_documents).join(sizes, "source").where("_docs >= _least").select("source", "anchor", "_least")
    candidates = spread_join(lines, repeated, ["source", "anchor"], "document")
    wordings = candidates.select("source", "anchor", "wording", "_least", F.xxhash64("document").alias("_d")).distinct()
    wordings = wordings.groupBy("source", "anchor", "wording").agg(F.count("*").alias("documents"), F.first("_least").alias("_least")).where("documents >= _least")
    return spread_join(candidates.drop("_least"), wordings.drop("_least"), ["source", "anchor", "wording"], "document")


def repeated_lines(pages: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(document, page, block_id, line_no, chars, documents): the lines of each document that its source repeats excessively.

    Lines are a block's text split at line feeds, from 1. Documents without source, null texts and lines of fewer than LEAST
    letters take no part; the blocks of a second delivery count once; an empty input gives no rows. The chunks are written to
    the shared folder once, because they are counted and then read again.
    """
    lines = written(chunked_lines(pages), "chunks")
    found = excessive(lines, pages, min_documents, min_share)
    return found.select("document", "page", "block_id", "line_no", "chars", "documents").dropDuplicates(["document", "block_id", "line_no"])


def texts_without_repeats(pages: DataFrame, **limits: float) -> DataFrame:
    """(document, page, block_id, text, cut): each block's text without its repeated lines and the number of lines cut.

    Blocks that hold nothing else give an empty text; null texts stay null, and blocks of a null page are cut like any other.
    Extra columns of the input are ignored.
    """
    found = repeated_lines(pages, **limits).groupBy("document", "page", "block_id").agg(F.collect_set("line_no").alias("_lines"))
    found = found.select(*(F.col(c).alias(f"_{c}") for c in ("document", "page", "block_id")), "_lines")
    b = blocks(pages.select("document", "page", "source", "blocks")).where("document is not null").dropDuplicates(["document", "page", "block_id"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lines", (i + 1).cast("int"))), "\n")
    same = (b.document == found._document) & b.page.eqNullSafe(found._page) & (b.block_id == found._block_id)
    out = b.join(found, same, "left")
    return out.select("document", "page", "block_id", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("_lines"), F.lit(0)).alias("cut"))


def repeated_wordings(pages: DataFrame, **limits: float) -> DataFrame:
    """(source, wording, documents, lines): each excessively repeated wording as it is first written, by source."""
    lines = written(chunked_lines(pages), "chunks")
    found = excessive(lines, pages, **limits).dropDuplicates(["document", "block_id", "line_no"])
    counts = found.groupBy("source", "wording").agg(F.max("documents").alias("documents"), F.count("*").alias("lines"), F.min(F.struct("document", "block_id", "line_no")).alias("at"))
    b = blocks(pages.select("document", "page", "source", "blocks")).select("document", "block_id", "text").dropDuplicates(["document", "block_id"])
    named = counts.join(b, (F.col("at.document") == b.document) & (F.col("at.block_id") == b.block_id))
    return named.select("source", F.element_at(F.split("text", "\n"), F.col("at.line_no")).alias("line"), "documents", "lines")


class Repeats:
    """The excessively repeated wordings of each source, as sorted arrays of hashes."""

    def __init__(self, by_source: dict[str, np.ndarray]) -> None:
        self.by_source = by_source
        self.every = np.unique(np.concatenate([*by_source.values(), np.zeros(0, dtype=np.int64)]))

    def without_all(self, sources: list[str | None], texts: list[str]) -> list[str]:
        """The texts, of canonical characters, without the lines that the source of each repeats."""
        out = list(texts)
        at = [k for k, (s, t) in enumerate(zip(sources, texts, strict=True)) if s in self.by_source and len(t) >= LEAST] if len(self.every) else []
        for a, z in safe_groups([texts[k] for k in at]):
            text, line, wording = line_wordings([texts[k] for k in at[a:z]], True)
            if not len(text):
                continue
            # a wording that no source repeats is no candidate; for the few others the own source decides
            place = np.minimum(np.searchsorted(self.every, wording), len(self.every) - 1)
            drop: dict[int, set[int]] = {}
            for r in np.flatnonzero(self.every[place] == wording).tolist():
                k = at[a + int(text[r])]
                known = self.by_source[sources[k]]
                where = np.searchsorted(known, wording[r])
                if where < len(known) and known[where] == wording[r]:
                    drop.setdefault(k, set()).add(int(line[r]))
            for k, lines in drop.items():
                out[k] = "\n".join(t for n, t in enumerate(texts[k].split("\n"), 1) if n not in lines)
        return out


def repeats(pages: DataFrame, **limits: float) -> tuple[Repeats | None, DataFrame]:
    """What a pass over `pages` needs to leave repeated lines out: the wordings by source, and the pages to read.

    A wording stands in a fifth of its source's documents, so a source has at most five times the long lines of a mean
    document. If there are more than MOST_WORDINGS over all sources they aren't collected: the first part is None then, and
    the lines are cut from the pages by a join.
    """
    found = excessive(written(chunked_lines(pages), "chunks"), pages, **limits)
    distinct = written(found.select("source", "wording").distinct(), "wordings")
    if distinct.limit(MOST_WORDINGS + 1).count() > MOST_WORDINGS:
        lines = found.groupBy("document", "page", "block_id").agg(F.collect_set("line_no").alias("_lines"))
        cut = lines.groupBy("document", "page").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "_lines"))).alias("_cut"))
        joined = pages.join(cut.withColumnRenamed("page", "_page").withColumnRenamed("document", "_document"), (F.col("document") == F.col("_document")) & F.col("page").cast("int").eqNullSafe(F.col("_page")), "left")

        def kept(b):  # noqa: ANN001, ANN202
            lines = F.col("_cut")[b.id]
            text = F.array_join(F.filter(F.split(b.text, "\n"), lambda x, i: ~F.array_contains(lines, (i + 1).cast("int"))), "\n")
            return b.withField("text", F.when(lines.isNull(), b.text).otherwise(text))

        return None, joined.withColumn("blocks", F.transform("blocks", kept)).drop("_cut", "_page", "_document")
    by_source: dict[str, list[int]] = {}
    for r in distinct.collect():
        by_source.setdefault(r.source, []).append(r.wording)
    return Repeats({s: np.sort(np.array(w, dtype=np.int64)) for s, w in by_source.items()}), pages


__all__ = [
    "Repeats", "repeats", "chunked_lines", "excessive", "long_lines", "repeated_lines", "repeated_wordings", "texts_without_repeats"]
