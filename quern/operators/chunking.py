"""Cutting texts into chunks for embedding and indexing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of chunks that a task holds before it hands them on.
HELD = 1 << 20


def without_data_urls(text: Column) -> Column:
    """Inline images reduced to their alternative text; other base64 data goes."""
    images = F.regexp_replace(text, r"!\[([^\]]*)\]\(data:[^)]*\)", "![$1](image)")
    return F.regexp_replace(images, r"data:[a-zA-Z0-9/+.-]+;base64,[A-Za-z0-9+/=]+", "")


@dataclass(frozen=True)
class Sizes:
    """words in a chunk, words that a chunk repeats from the one before, and UTF-8 bytes in a chunk."""

    words: int = 384
    overlap: int = 0
    bytes: int = 3500

    def proper(self) -> Sizes:
        words = self.words if self.words > 0 else 384
        overlap = max(0, self.overlap)
        return Sizes(words, words // 8 if overlap >= words else overlap, self.bytes if self.bytes > 0 else 3500)


def paragraphs(text: str) -> Iterator[list[str]]:
    """Words of each paragraph. A blank line ends one; a line that starts with # is one of its own."""
    held: list[str] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            if held:
                yield held
                held = []
            if line:
                yield line.split()
        else:
            held += line.split()
    if held:
        yield held


def packed(text: str, size: Sizes) -> Iterator[list[str]]:
    """Words of each chunk before the limit on bytes.

    Paragraphs stay whole: one that doesn't fit starts a new chunk, which begins with the last words of the
    one before. A paragraph larger than a chunk is cut by a sliding window, and shares no words with its neighbours.
    """
    held: list[str] = []
    for words in paragraphs(text):
        if len(words) > size.words:
            if held:
                yield held
            held = []
            for start in range(0, len(words), size.words - size.overlap):
                yield words[start : start + size.words]
                if start + size.words >= len(words):
                    break
            continue
        if held and len(held) + len(words) > size.words:
            yield held
            held = held[-size.overlap :] if 0 < size.overlap < len(held) else []
        held = held + words
    if held:
        yield held


def _width(words: list[str]) -> int:
    return sum(len(w.encode()) + 1 for w in words) - 1 if words else 0


def limited(words: list[str], limit: int) -> Iterator[tuple[str, int]]:
    """(text, words) of the pieces of a chunk that keep to the limit on bytes.

    A piece begins with words of the one before that make up at least a sixteenth of the limit (100 bytes at least), unless
    the next word then would not fit. A word over the limit is cut to it and stands alone.
    """
    text = " ".join(words)
    if len(text.encode()) <= limit:
        yield text, len(words)
        return
    repeat = max(100, limit // 16)
    held: list[str] = []
    width = 0
    for word in words:
        n = len(word.encode())
        if n > limit:
            if held:
                yield " ".join(held), len(held)
            held, width = [], 0
            yield word.encode()[:limit].decode("utf-8", "ignore"), 1
            continue
        if held and width + 1 + n > limit:
            yield " ".join(held), len(held)
            start, seed = len(held), 0
            while start and seed < repeat:
                start -= 1
                seed += len(held[start].encode()) + 1
            held = held[start:]
            width = _width(held)
        if width + 1 + n > limit:
            held, width = [], 0
        held.append(word)
        width = width + 1 + n if width else n
    if held:
        yield " ".join(held), len(held)


def chunk_text(text: str | None, size: Sizes) -> list[tuple[str, int]]:
    return [piece for words in packed(text or "", size) for piece in limited(words, size.bytes)]


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Sizes = Sizes(), prefix: str = "") -> DataFrame:
    """(id, ord, chunk_id, text, token_count, embed_text) of each chunk, ord from 0. embed_text has the prefix that an embedding
    model wants; what is stored has not. A blank text has no chunks."""
    size = size.proper()
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("ord", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType())]
    texts = df.select(F.col(id_col).alias("id"), without_data_urls(F.col(text_col)).alias("text"))
    pieces = texts.mapInArrow(lambda batches: _cut(batches, size), T.StructType(fields))
    return pieces.select(
        F.col("id").alias(id_col), "ord", F.concat_ws("#", F.col("id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"), "text", "token_count",
        F.concat(F.lit(prefix), F.col("text")).alias("embed_text"),
    )


def _cut(batches: Iterator[pa.RecordBatch], size: Sizes, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(id, ord, text, token_count) of batches (id, text). Texts are read one by one and chunks handed on when they have `held` characters,
    so that of a batch nothing but itself is held."""
    for b in batches:
        ids, texts = b.columns
        who, ords, pieces, counts, n = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            columns = [ids.take(pa.array(who, pa.int64())), pa.array(ords, pa.int32()), pa.array(pieces, texts.type), pa.array(counts, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["id", "ord", "text", "token_count"])

        for k, x in enumerate(texts):
            for o, (text, count) in enumerate(chunk_text(x.as_py(), size)):
                who.append(k)
                ords.append(o)
                pieces.append(text)
                counts.append(count)
                n += len(text)
                if n >= held:
                    yield made()
                    who, ords, pieces, counts, n = [], [], [], [], 0
        if who:
            yield made()


def word_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 384, overlap: int = 48) -> DataFrame:
    """(id, ord, words, token_count): the windows of texts of one paragraph, before the limit on bytes, by expressions
    alone. A window starts `words - overlap` words after the one before; the last one reaches the end."""
    split = df.select(F.col(id_col), F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "").alias("all"))
    n = F.size("all")
    last = F.when(n <= words, 0).otherwise(F.ceil((n - words) / (words - overlap))).cast("int")
    return (
        # a null range has no rows; a filter would be pushed down and split every text twice
        split.select(id_col, "all", F.explode(F.when(n > 0, F.sequence(F.lit(0), last))).alias("ord"))
        .select(id_col, "ord", F.slice("all", F.col("ord") * (words - overlap) + 1, words).alias("words"))
        .withColumn("token_count", F.size("words"))
    )
