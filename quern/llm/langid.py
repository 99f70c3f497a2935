"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in one array, a mask of languages for each slot. The mask of an n-gram is
the conjunction of its slots' masks: all languages that contain it. A text's score for a language is the
share of its n-grams whose mask has the language's bit, corrected for the share that false positives
would give, which the filter's fill tells. The best language decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import fresh, share, small_batches, tidy, unused

#: Bytes of text that are looked at together.
_WINDOW = 1 << 18
#: Rows of a batch that are looked at together.
_ROWS = 512
_HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: ASCII letters and all bytes of other characters stay; the rest becomes a space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


@dataclass
class Filters:
    """langs: in the order of their bits, commonest first. masks: (words of 64 languages, slots). false: each
    language's rate of false positives."""

    langs: list[str]
    n: int
    masks: np.ndarray
    false: np.ndarray


def slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(codes * np.uint64(h)) >> np.uint64(64 - bits) for h in _HASHES]


def build(langs: list[str], grams: list[np.ndarray], n: int, bits: int) -> Filters:
    """Filters of the n-gram codes of each language."""
    width = np.min_scalar_type((1 << min(64, max(1, len(langs)))) - 1)
    masks = np.zeros((-(-max(1, len(langs)) // 64), 1 << bits), dtype=width)
    for k, codes in enumerate(grams):
        for at in slots(codes.astype(np.uint64), bits):
            masks[k // 64, at] |= masks.dtype.type(1 << (k % 64))
    fill = [((masks[k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)).mean() for k in range(len(langs))]
    return Filters(langs, n, masks, np.array(fill) ** len(_HASHES))


def _flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of strings in lower case, and where each text begins and ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at


def codes_of(data: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of every n-gram: n bytes of a text whose runs of non-letters are one space.

    Works in windows of bounded size, whatever the texts' lengths.
    """
    carry = (np.zeros(0, np.uint8), np.zeros(0, np.int32))
    at = np.asarray(at, dtype=np.int64)
    for s in range(int(at[0]), int(at[-1]), _WINDOW):
        e = min(s + _WINDOW, int(at[-1]))
        first, last = np.searchsorted(at, [s, e - 1], side="right") - 1
        edge = np.clip(at[first : last + 2], s, e)
        b, r = _FOLD[data[s:e]], np.repeat(np.arange(first, last + 1, dtype=np.int32), np.diff(edge))
        b, r = np.concatenate([carry[0], b]), np.concatenate([carry[1], r])
        blank = b == 32
        keep = np.r_[True, ~(blank[1:] & blank[:-1] & (r[1:] == r[:-1]))]
        b, r = b[keep], r[keep]
        carry = (b[-(n - 1) :], r[-(n - 1) :]) if n > 1 else carry
        if len(b) >= n:
            code = np.zeros(len(b) - n + 1, dtype=np.uint64)
            for k in range(n):
                code |= b[k : len(b) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
            same = r[: len(code)] == r[n - 1 :]
            yield r[: len(code)][same], code[same]


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    out = np.zeros(len(at) - 1, dtype=bool)
    for k in range(len(out)):
        b = data[at[k] : at[k + 1]]
        plain = (b >= 97) & (b <= 122)
        out[k] = bool(plain[:256].any() or plain.any()) or (bool((b >= 128).any()) and any(c.isalpha() for c in b.tobytes().decode("utf-8", "ignore")))
    return out


def predict_texts(model: Filters, texts) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of an Arrow array of strings."""
    data, at = _flat(texts)
    rows, langs = len(at) - 1, len(model.langs)
    hits, grams = np.zeros((langs, rows)), np.zeros(rows)
    bits = model.masks.shape[1].bit_length() - 1
    one = model.masks.dtype.type(1)
    for row, code in codes_of(data, at, model.n):
        grams += np.bincount(row, minlength=rows)
        where = slots(code, bits)
        for word in range(len(model.masks)):
            mask = model.masks[word, where[0]] & model.masks[word, where[1]]
            for k in range(64 * word, min(langs, 64 * word + 64)):
                hits[k] += np.bincount(row[((mask >> model.masks.dtype.type(k % 64)) & one).view(model.masks.dtype) != 0], minlength=rows)
    false = model.false[:, None]
    share = np.clip((hits - false * grams) / ((1 - false) * np.maximum(grams, 1)), 0, 1) if langs else hits
    letters = has_letter(data, at) if langs else np.zeros(rows, dtype=bool)
    best = share.argmax(axis=0) if langs else np.zeros(rows, dtype=int)
    score = np.where(letters, share.max(axis=0), 0.0) if langs else np.zeros(rows)
    return [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", n: int = 4, bits: int = 21, max_docs: int = 3000, min_rate: float = 1e-5, dominance: float = 0.2) -> Filters:
    """Filters learned from the rows of labelled whose text and language are not null.

    About max_docs rows of each language are looked at, chosen by a hash of key_col: the documented bound of
    the sample. A language contains an n-gram if at least min_rate of its n-grams are that one, so it
    contains 1 / min_rate at most, and if its rate is at least `dominance` of the highest rate in any language.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key"))
    counts = known.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return build([], [], n, 1)
    langs = [r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))]
    part = {r["lang"]: min(1.0, max_docs / r["count"]) for r in counts}
    chance = F.create_map(*(x for k, v in part.items() for x in (F.lit(k), F.lit(v))))
    sample = known.where(F.pmod(F.xxhash64("key", F.lit("lang")), F.lit(1_000_000)) < 1_000_000 * chance[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            names = np.array(b.column(1).to_pylist(), dtype=object)
            data, at = _flat(b.column(0))
            for row, code in codes_of(data, at, n):
                for lang in set(names[np.unique(row)]):
                    found, times = np.unique(code[names[row] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "code", "n"])

    grams = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = grams.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # totals: a row for each language
    rows = (
        rates.where(F.col("rate") >= min_rate)
        .groupBy("code")
        .agg(F.collect_list(F.struct("lang", "rate")).alias("r"), F.max("rate").alias("top"))
        .select("code", F.expr(f"transform(filter(r, x -> x.rate >= {dominance} * top), x -> x.lang)").alias("langs"))
        .select("code", F.explode("langs").alias("lang"))
        .toArrow()  # 1 / min_rate rows for each language at most
    )
    code, lang = rows["code"].to_numpy().astype(np.int64).view(np.uint64), rows["lang"].to_numpy(zero_copy_only=False)
    by = {k: np.sort(code[lang == k]) for k in langs}
    return build(langs, [by.get(k, np.zeros(0, dtype=np.uint64)) for k in langs], n, bits)


def predict(df: DataFrame, model: Filters, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score.

    lang_pred is `und` with score 0 if the text is null, empty or has no letter, or nothing was learned;
    if none of a text's n-grams is known, it is the language that was commonest in training, with score 0.
    The score is the corrected share of n-grams that the language contains. Columns of df by these names are an error.
    """
    fresh(df, "lang_pred", "score")
    small_batches(df.sparkSession)
    held = share(df.sparkSession, model)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(0, max(1, len(batch)), _ROWS):
                lang, score = predict_texts(held(), batch.slice(k, _ROWS))
                yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])
            tidy()

    found = arrow_udf(of, "struct<lang:string,score:double>", ArrowUDFType.SCALAR_ITER)(F.col(text_col))
    (name,) = unused(df, "_found")
    return df.select("*", found.alias(name)).select("*", F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("score")).drop(name)


def in_fold(ids, parts: int, part: int):
    """Whether the CRC-32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % parts == part, F.lit(False))


