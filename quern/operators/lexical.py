"""Lexical search: BM25 over an inverted index held in tables, phrases, and snippets.

score = sum over the query's phrases of idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)),
idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 if that is not positive. N, n, and lengths count all indexed chunks,
whatever filters a query has; length and tf count all indexed columns together.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKED, QUERY_STOPWORDS, QUERY_WORD, UNMARKED, index_tokens, phrase_counts, query_words, stemmed_tokens
from ..functions.text import tokens as plain_tokens

K1, B = 1.2, 0.75


def index(chunks: DataFrame, id_col: str = "chunk_id", columns: tuple[str, ...] = ("text",), stemmed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, columns of keep, terms, length): the tokens of the indexed columns, one column after the other.

    Columns are kept apart by a null, so that no phrase runs from one into the next. Write this table, sorted or bucketed by
    what queries filter on, and search it many times.
    """
    of = stemmed_tokens if stemmed else plain_tokens
    parts: list[Column] = []
    for k, c in enumerate(columns):
        parts += ([F.array(F.lit(None).cast("string"))] if k else []) + [F.coalesce(of(F.col(c)), F.array().cast("array<string>"))]
    all_ = F.concat(*parts) if len(parts) > 1 else parts[0]
    return chunks.select(F.col(id_col).alias("chunk_id"), *keep, all_.alias("terms")).withColumn("length", F.size(F.filter("terms", lambda t: t.isNotNull())))


def postings(indexed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, chunk_id, columns of keep, length, tf, positions): the index turned round, for tables that are looked up by term.

    A chunk's own tokens make its postings: they are sorted, and each run of one term is a posting. So a chunk costs little more than its tokens, nothing
    but a chunk's terms is gathered in one place, and nothing is shuffled. Write it in the order of terms: a query then reads the files and
    row groups of its own terms alone.
    """
    placed = F.filter(F.transform("terms", lambda t, k: F.struct(t.alias("term"), k.alias("at"))), lambda x: x["term"].isNotNull())
    each = indexed.select("chunk_id", *keep, "length", F.inline(_held(F.sort_array(placed), _runs)))
    return each.select("term", "chunk_id", *keep, "length", F.size("positions").alias("tf"), "positions")


def _held(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value found once however often it is read."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _runs(placed: Column) -> Column:
    """(term, positions) of each run of one term among sorted (term, at)."""
    n = F.size(placed)
    first = lambda k: (k == 0) | (F.get(placed, k)["term"] != F.get(placed, k - 1)["term"])
    begins = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)), first)
    places = lambda b, end: F.transform(F.slice(placed, b + 1, end - b), lambda x: x["at"])
    return _held(begins, lambda s: F.transform(s, lambda b, k: F.struct(F.get(placed, b)["term"].alias("term"), places(b, F.coalesce(F.get(s, k + 1), n)).alias("positions"))))


def inverted(indexed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """postings, for building an index of everything."""
    return postings(indexed, keep)


def scores_of_postings(posted: DataFrame, stats: DataFrame, phrases: list[list[str]], keep: tuple[str, ...] = (), frequencies: DataFrame | None = None) -> DataFrame:
    """(chunk_id, columns of keep, score) from postings: only those of the query's terms are read. stats: one row (n_all, mean) of all chunks.

    frequencies (term, chunks: signed sums of the chunks that hold a term): they are looked up where each phrase is one word, so posted may be a part of
    all postings, as of some documents; else chunks are counted here.
    """
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    if not distinct:
        return posted.select("chunk_id", *keep, F.lit(0.0).alias("score")).where("false")
    own = posted.where(F.col("term").isin(*sorted({t for p in distinct for t in p})))
    hits = own.groupBy("chunk_id", *keep).agg(F.max("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    none = F.array().cast("array<int>")
    of = lambda t: F.coalesce(F.try_element_at("at", F.lit(t)), none)

    def count(phrase: list[str]) -> Column:
        starts = of(phrase[0])
        for j, t in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, moved(of(t), j))
        return F.size(starts)

    def moved(places: Column, by: int) -> Column:
        return F.transform(places, lambda p: p - by)

    counted = hits.select("chunk_id", *keep, "length", F.array(*map(count, distinct)).alias("tf")).where(F.exists("tf", lambda t: t > 0))
    if frequencies is not None and all(len(p) == 1 for p in distinct):
        each = frequencies.where(F.col("term").isin(*(p[0] for p in distinct))).groupBy("term").agg(F.sum("chunks").alias("n"))
        by = F.map_from_entries(F.collect_list(F.struct("term", "n")))  # the query's terms at most
        held = each.agg(by.alias("by")).select(F.array(*(F.coalesce(F.try_element_at("by", F.lit(p[0])), F.lit(0).cast("long")) for p in distinct)).alias("n_with"))
        return score_counts(counted, stats.crossJoin(held), [phrases.count(p) for p in distinct], keep)
    held = counted.agg(F.array(*(F.count_if(F.get("tf", F.lit(k)) > 0) for k in range(len(distinct)))).alias("n_with"))
    return score_counts(counted, stats.crossJoin(held), [phrases.count(p) for p in distinct], keep)


def scores_of_queries(posted: DataFrame, stats: DataFrame, queries: DataFrame, digits: int = 9, stemmed: bool = False) -> DataFrame:
    """(query_id, chunk_id, document_id, score) of the chunks that hold a phrase of each query (query_id, text), from postings with document_id.

    Phrases are those of phrases_of. The queries are a stated set, so their distinct phrases are sent round and meet the postings where these lie; a phrase of several words
    is where the positions of its words follow each other. Scores are rounded to `digits`, so that equal ones are equal in whatever order they are
    added up. stats: one row (n_all, mean) of all chunks. Null texts, and queries without a word, find nothing; queries that share an id are one.
    """
    words = queries.where("query_id is not null").select("query_id", F.explode(query_words(F.col("text"))).alias("word"))
    said = words.select("query_id", (stemmed_tokens if stemmed else plain_tokens)(F.col("word")).alias("terms")).where(F.size("terms") > 0).withColumn("phrase", F.array_join("terms", " "))
    asked = said.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))
    wanted = said.select("phrase", "terms").distinct().select("phrase", F.size("terms").alias("words"), F.posexplode("terms").alias("at", "term"))
    met = posted.select("term", "chunk_id", "document_id", "length", "tf", "positions").join(F.broadcast(wanted), "term")
    one = met.where("words = 1").select("phrase", "chunk_id", "document_id", "length", F.col("tf").cast("long").alias("tf"))
    # a start is a place where each word of the phrase stands as far on as it stands in the phrase
    starts = met.where("words > 1").select("phrase", "words", "chunk_id", "document_id", "length", "at", F.explode("positions").alias("place"))
    starts = starts.groupBy("phrase", "words", "chunk_id", "document_id", "length", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("n")).where("n = words")
    several = starts.groupBy("phrase", "chunk_id", "document_id", "length").agg(F.count("*").alias("tf"))
    hits = one.unionByName(several)
    n = F.col("n_with")
    idf = F.log((F.col("n_all") - n + 0.5) / (n + 0.5))
    weights = hits.groupBy("phrase").agg(F.count("*").alias("n_with")).crossJoin(F.broadcast(stats)).select("phrase", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))  # stats: one row
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # A chunk's hits are brought together once, before queries multiply them; what follows is by chunk too, and exchanges nothing.
    each = hits.repartition("chunk_id").join(F.broadcast(asked.join(weights, "phrase")), "phrase").select("query_id", "chunk_id", "document_id", part.alias("part"))
    return each.groupBy("query_id", "chunk_id", "document_id").agg(F.round(F.sum("part"), digits).alias("score"))


def statistics(lengths: DataFrame) -> DataFrame:
    """One row (n_all, mean) of chunks' lengths."""
    return lengths.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean"))


def summed_statistics(changes: DataFrame) -> DataFrame:
    """One row (n_all, mean) of signed sums (chunks, tokens)."""
    return changes.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_all"), (F.sum("tokens") / F.sum("chunks")).alias("mean"))


def changes(lengths: DataFrame, sign: int) -> DataFrame:
    """One row (chunks, tokens): what chunks' lengths add to the statistics, or take away."""
    return lengths.agg((F.count("*") * sign).alias("chunks"), (F.coalesce(F.sum("length"), F.lit(0)) * sign).cast("long").alias("tokens"))


def term_changes(posted: DataFrame, sign: int) -> DataFrame:
    """(term, chunks): in how many more, or fewer, chunks each term stands."""
    return posted.groupBy("term").agg((F.count("*") * sign).alias("chunks"))


def phrases_of(query: str, stemmed: bool = True) -> list[list[str]]:
    """The query's phrases, as tokens, repeats included; a hyphenated word is a phrase of its parts."""
    import regex

    out = []
    for w in regex.findall(QUERY_WORD, query):
        if w.lower() not in QUERY_STOPWORDS:
            tokens = [t for t, _, _ in index_tokens(w)] if stemmed else regex.findall(r"[\p{L}\p{N}]+", w.lower().translate(str.maketrans(MARKED, UNMARKED)))
            if tokens:
                out.append(tokens)
    return out


def frequency(terms: Column, phrase: list[str]) -> Column:
    """How often a phrase stands among tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(terms, lambda t: t == phrase[0]))
    starts = F.sequence(F.lit(1), F.size(terms) - len(phrase) + 1)
    same = lambda k: F.forall(F.sequence(F.lit(0), F.lit(len(phrase) - 1)), lambda j: F.get(terms, k - 1 + j) == F.get(F.array(*map(F.lit, phrase)), j))
    return F.when(F.size(terms) >= len(phrase), F.size(F.filter(starts, lambda k: F.coalesce(same(k), F.lit(False))))).otherwise(0)


def scores(indexed: DataFrame, phrases: list[list[str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, columns of keep, score) of the chunks that hold at least one of the phrases."""
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    if not distinct:
        return indexed.select("chunk_id", *keep, F.lit(0.0).alias("score")).where("false")
    # a chunk's tokens are gone through once; words are counted among those that the query has
    words = [p[0] for p in distinct if len(p) == 1]
    few = F.filter("terms", lambda t: t.isin(*words)) if words else F.array().cast("array<string>")
    own = indexed.select("chunk_id", *keep, "length", "terms", few.alias("few"))
    counts = (frequency(F.col("few") if len(p) == 1 else F.col("terms"), p) for p in distinct)
    return _scored(own.select("chunk_id", *keep, "length", F.array(*counts).alias("tf")), phrases, keep)


def scores_of_texts(chunks: DataFrame, phrases: list[list[str]], columns: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ()) -> DataFrame:
    """scores of chunks that are searched once, without an index: phrases (of stems) are counted where texts are read, and no token leaves there."""
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    if not distinct:
        return chunks.select("chunk_id", *keep, F.lit(0.0).alias("score")).where("false")
    own = chunks.select("chunk_id", *keep, phrase_counts([F.col(c) for c in columns], distinct).alias("counts"))
    # never null: the scores would leave nulls out below the exchange, the statistics would not, and texts would be gone through once for each
    length, tf = F.coalesce(F.get("counts", F.lit(0)), F.lit(0)), F.coalesce(F.slice("counts", 2, len(distinct)), F.array().cast("array<int>"))
    return _scored(own.select("chunk_id", *keep, length.alias("length"), tf.alias("tf")), phrases, keep)


def _scored(counts: DataFrame, phrases: list[list[str]], keep: tuple[str, ...]) -> DataFrame:
    """Scores above 0 from (chunk_id, columns of keep, length, tf array).

    Chunks are cut into tokens once: what is counted of each, a few numbers, is exchanged, and both the statistics (one row,
    whatever the size of the corpus) and the scores read that exchange.
    """
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    # all columns are used, those of keep by the exchange, so that the plan of both readers is the same up to it
    counted = counts.where(F.col("chunk_id").isNotNull()).repartition("chunk_id", *keep)
    holding = [F.count_if(F.get("tf", F.lit(k)) > 0) for k in range(len(distinct))]
    stats = counted.agg(F.count("chunk_id").alias("n_all"), F.avg("length").alias("mean"), F.array(*holding).alias("n_with"))
    # A chunk without a phrase scores 0 and any other more. A filter on the counts would be pushed down, and with it, for each phrase, the
    # whole tokenisation; one on the score stays above.
    return score_counts(counted, stats, [phrases.count(list(p)) for p in distinct], keep).where("score > 0")


def score_counts(counted: DataFrame, stats: DataFrame, repeats: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores from counts: counted has (chunk_id, columns of keep, length, tf array), stats one row (n_all, mean, n_with array)."""
    joined = counted.crossJoin(F.broadcast(stats))  # stats: one row
    total = F.lit(0.0)
    for k, times in enumerate(repeats):
        tf, n = F.get("tf", F.lit(k)).cast("double"), F.get("n_with", F.lit(k))
        idf = F.log((F.col("n_all") - n + F.lit(0.5)) / (n + F.lit(0.5)))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        one = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        total = total + (one if times == 1 else one * times)
    return joined.select("chunk_id", *keep, total.alias("score"))


def top(scored: DataFrame, limit: int = 50) -> DataFrame:
    """The best rows, equal scores by chunk, with their rank from 1."""
    from .fusion import ranked

    return ranked(scored.orderBy(F.desc("score"), "chunk_id").limit(limit), F.desc("score"), F.asc("chunk_id"))


def snippet_of(text: str, phrases: list[list[str]], size: int = 32, before: str = "<em>", after: str = "</em>", cut: str = "…") -> str:
    """The part of a text, of at most `size` tokens, that shows most phrases, with their tokens marked.

    A window is worth 1000 for each phrase it holds and 1 for each repetition; among equals one that begins a sentence or
    the text is preferred (100 and 120 more), then the first.
    """
    tokens = index_tokens(text)
    hits: list[tuple[int, int, int]] = []  # first token, tokens, phrase
    for p, phrase in enumerate(phrases):
        for k in range(len(tokens) - len(phrase) + 1):
            if [t for t, _, _ in tokens[k : k + len(phrase)]] == phrase:
                hits.append((k, len(phrase), p))
    hits.sort()
    starts_sentence = [k == 0 or any(c in ".:" for c in text[tokens[k - 1][2] : tokens[k][1]]) for k in range(len(tokens))]

    def worth(start: int) -> tuple[int, int]:
        seen: set[int] = set()
        score, first, last = 0, None, start
        for k, n, p in hits:
            if start <= k < start + size:
                score += 1 if p in seen else 1000
                seen.add(p)
                first = k if first is None else first
                last = max(last, k + n)
        if first is None:
            return 0, start
        centred = first - (size - (last - first)) // 2
        return score, max(0, min(centred, len(tokens) - size))

    best, at = -1, 0
    for k, _, _ in hits:
        score, centred = worth(k)
        if score > best:
            best, at = score, centred
        sentence = next((s for s in range(k, -1, -1) if starts_sentence[s]), 0)
        if k - sentence < size:
            score, _ = worth(sentence)
            if score and score + (120 if sentence == 0 else 100) > best:
                best, at = score + (120 if sentence == 0 else 100), sentence
    end = min(len(tokens), at + size)
    marked = [any(k <= t < k + n for k, n, _ in hits) for t in range(len(tokens))]
    out = cut if at > 0 else text[: tokens[0][1]] if tokens else text
    for t in range(at, end):
        if t > at:
            gap = text[tokens[t - 1][2] : tokens[t][1]]
            out += gap
        opens = marked[t] and not (t > at and marked[t - 1] and any(k <= t - 1 and t < k + n for k, n, _ in hits))
        closes = marked[t] and not (t + 1 < end and marked[t + 1] and any(k <= t and t + 1 < k + n for k, n, _ in hits))
        out += (before if opens else "") + text[tokens[t][1] : tokens[t][2]] + (after if closes else "")
    return out + (cut if end < len(tokens) else text[tokens[-1][2] :] if tokens else "")


def snippets(text: Column, phrases: list[list[str]], **how) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t or "", phrases, **how) for t in texts], dtype=object)

    return of(text)
