"""One character form for texts that look the same (problem 1).

A text is stable if no character of it can change under the canonical form. Only runs of unstable characters,
with one character of context before them, are decomposed, mapped and composed again; they are then spliced
into the rest, which stays as it is. The map takes full-width and half-width forms, joined letters, spaces of
other kinds, hyphens of the same shape and letters of other alphabets to their plain look-alikes and removes
characters without width. Case, accents, raised, lowered and circled characters and added marks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmesh.pages import blocks
from leafmesh.session import written

# Letters of other alphabets and the Latin letters that have their shape; fixed values.
_LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, phonetic
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a",
}
_HYPHENS = "‐‑﹣"
# Characters without width beyond category Cf; fixed values.
_NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}


def _map(ch: str) -> str:
    """The plain look-alike of one fully decomposed character."""
    plain = _LOOK_ALIKE.get(ch)
    if plain is not None:
        return plain
    if ch in _HYPHENS:
        return "-"
    category = unicodedata.category(ch)
    if category == "Zs" or ch in "\u0085\u2028\u2029":
        return " "
    if category == "Cf" or ord(ch) in _NO_WIDTH:
        return ""
    shape = unicodedata.decomposition(ch)
    if shape.startswith(("<wide>", "<narrow>")) or ch == "µ":
        return unicodedata.normalize("NFKC", ch)
    if shape.startswith("<compat>"):
        parts = unicodedata.normalize("NFKC", ch)
        if category == "Nl" or (category[0] == "L" and len(parts) > 1 and parts.isalpha()):
            return parts
    return ch


_COMPOSING: set[str] = set()


def _composing() -> set[str]:
    """Characters whose quick check is Maybe: they may compose with one before them. Built once, from all decompositions."""
    if not _COMPOSING:
        _COMPOSING.update(chr(c) for c in range(0x1161, 0x11C3))
        for code in (*range(0xC0, 0xD800), *range(0xE000, 0x20000)):
            parts = unicodedata.decomposition(chr(code))
            if parts and parts[0] != "<" and " " in parts:
                _COMPOSING.update(chr(int(x, 16)) for x in parts.split(" ")[1:])
    return _COMPOSING


def _is_unstable(code: int) -> bool:
    """Quick check of one code point: No or Maybe, or a combining class, or a character that the map takes to another."""
    ch = chr(code)
    if unicodedata.combining(ch) or ch in _composing():
        return True
    return unicodedata.normalize("NFC", "".join(map(_map, unicodedata.normalize("NFD", ch)))) != ch


#: Parts of the code space that hold characters beyond ASCII; ideographs of plane 2 and 3 are stable but for the compatible ones.
_SPANS = (range(0x80, 0x3400), range(0x9FF0, 0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0xE010), range(0xF900, 0x10000), range(0x10000, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0FFF))


def _ranges() -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for span in _SPANS:
        for code in span:
            if _is_unstable(code):
                if out and out[-1][1] == code - 1:
                    out[-1] = (out[-1][0], code)
                else:
                    out.append((code, code))
    return out


_UNSTABLE: re.Pattern[str] | None = None


def _unstable() -> re.Pattern[str]:
    """A run of unstable characters; built once per process, from character properties."""
    global _UNSTABLE
    if _UNSTABLE is None:
        inner = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges())
        _UNSTABLE = re.compile(f"[{inner}]+")
    return _UNSTABLE


_LATIN: list[bytes] = []


def _latin() -> bytes:
    """The unstable characters below 256; a text of the other ones is stable."""
    if not _LATIN:
        _LATIN.append(bytes(c for a, b in _ranges() for c in range(a, b + 1) if c < 0x100))
    return _LATIN[0]


_SEEN: dict[str, str] = {}


def _settle(run: str) -> str:
    out = _SEEN.get(run)
    if out is None:
        out = unicodedata.normalize("NFC", "".join(map(_map, unicodedata.normalize("NFD", run))))
        if len(run) <= 8 and len(_SEEN) < 100_000:
            _SEEN[run] = out
    return out


def fold(text: str) -> str:
    """The canonical characters of a text; line breaks and runs of spaces stay.

    Runs of unstable characters are settled together with the character before them and spliced into the rest.
    """
    if text.isascii():
        return text
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        if len(raw.translate(None, _latin())) == len(raw):
            return text
    out: list[str] = []
    last = 0
    for m in _unstable().finditer(text):
        begin, end = m.span()
        begin = max(last, begin - 1)
        out.append(text[last:begin])
        out.append(_settle(text[begin:end]))
        last = end
    if not last:
        return text
    out.append(text[last:])
    return "".join(out)


def canonical(text: str | None) -> str | None:
    """The canonical form: canonical characters, each run of white space as one space, none at the ends.

    None stays None; a text of nothing visible gives an empty string.
    """
    return None if text is None else " ".join(fold(text).split())


#: Java pattern of characters that may be unstable; it errs on the safe side and is cheap on ASCII.
MAY_CHANGE = (
    r"[^\u0000-\u001b -\u0084\u0086-\u009f¡-¬®-´¶-ıĴ-ňŊ-ž"
    r"‒-‧‰-⁄、-〃々-〩ぁ-ゖァ-ヺ一-鿿가-힣]"
)


@F.pandas_udf(StringType())
def _canonical_udf(texts):  # noqa: ANN001, ANN202
    return texts.map(canonical, na_action="ignore")


def canonical_column(text: Column) -> Column:
    """The canonical form of a column. Stable texts, by far the most, never leave the JVM."""
    unstable = (F.octet_length(text) != F.length(text)) & text.rlike(MAY_CHANGE)
    settled = _canonical_udf(F.when(unstable, text))
    return F.when(unstable, settled).otherwise(F.trim(F.regexp_replace(text, r"[\s\u001c-\u001f]+", " ")))


def canonical_blocks(pages: DataFrame) -> DataFrame:
    """(document, page, block_id, text, changed): each block's canonical text, and whether more than plain white space changed.

    Null texts stay null and count as unchanged; second deliveries of a page count once; rows without document or block id are
    left out; an empty input gives no rows.
    """
    b = blocks(pages.select("document", "page", "source", "blocks")).where("document is not null and block_id is not null")
    out = b.select("document", "page", "block_id", canonical_column(F.col("text")).alias("form"), _plain(F.col("text")).alias("plain"))
    out = out.select("document", "page", "block_id", F.col("form").alias("text"), F.coalesce(F.col("form") != F.col("plain"), F.lit(False)).alias("changed"))
    return out.dropDuplicates(["document", "page", "block_id"])


def _plain(text: Column) -> Column:
    """The text with runs of plain spaces and line breaks as one space."""
    return F.trim(F.regexp_replace(text, r"[ \n\r]+", " "))


def look_alike_classes(pages: DataFrame) -> DataFrame:
    """(document, form, block_id, plain): the blocks of the classes that look the same, where their characters differ.

    `form` is a hash of the canonical text and numbers the class within its document, `plain` is one of the text with white
    space made plain; both are of 96 bits. A class all of whose blocks are written alike gives no row. Null, blank and
    invisible texts and rows without document or block id take no part. Blocks of a second delivery are the same blocks.
    The hashes are written once, so the texts are read and normalised once.
    """
    b = blocks(pages.select("document", "page", "source", "blocks")).where("document is not null and block_id is not null and text is not null")
    b = b.select("document", "block_id", canonical_column(F.col("text")).alias("form"), _plain(F.col("text")).alias("plain"))

    def wide(c: str) -> Column:
        return F.when(F.col(c) != "", F.struct(F.xxhash64(c).alias("a"), F.hash(c).alias("b"))).alias(c)

    hashed = written(b.select("document", "block_id", wide("form"), wide("plain")), "forms").where("form is not null and plain is not null")
    mixed = hashed.groupBy("document", "form").agg(F.min("plain").alias("lo"), F.max("plain").alias("hi")).where("lo <> hi").select("document", "form")
    return hashed.join(mixed, ["document", "form"], "left_semi").groupBy("document", "form", "block_id").agg(F.max("plain").alias("plain"))


def look_alike_pairs(pages: DataFrame) -> DataFrame:
    """(document, block_id_a, block_id_b): blocks of one document that look the same though their characters differ.

    The pairs of `look_alike_classes`: only blocks of one class are joined, and only classes of two or more spellings have
    any. Ids are ordered as strings; an empty input gives no rows.
    """
    members = look_alike_classes(pages)
    a, z = members.alias("a"), members.alias("z")
    return (
        a.join(z, (F.col("a.document") == F.col("z.document")) & (F.col("a.form") == F.col("z.form")) & (F.col("a.plain") != F.col("z.plain")) & (F.col("a.block_id") < F.col("z.block_id")))
        .select(F.col("a.document").alias("document"), F.col("a.block_id").alias("block_id_a"), F.col("z.block_id").alias("block_id_b"))
        .distinct()
    )


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of an Arrow batch as a list."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def nested(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """An array of structs as one flat array, with the row of the batch and the place in its list of each element."""
    lists = batch.column(batch.schema.get_field_index(name))
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.searchsorted(row, np.arange(batch.num_rows))
    return row, np.arange(len(row)) - first[row] if len(row) else row, lists.flatten()


def few(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The rows of at most `most` keys, chosen by a hash of the key; only keys are sent to the driver to choose them."""
    there = df.where(" and ".join(f"{k} is not null" for k in keys))
    chosen = there.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(most)
    return there.join(F.broadcast(chosen), keys, "left_semi")
