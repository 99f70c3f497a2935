"""Words: query sanitising, index tokens, the Porter stemmer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a lexical query leaves out.
QUERY_STOPWORDS = (
    "a an the and or but nor so yet is are was were be been being am do does did doing have has had having "
    "of in on at to from by for with about against between into through during before after above below up down out off over under again further then once "
    "i me my we us our you your he him his she her it its they them their this that these those what which who whom whose "
    "all any some no not only own same than too very just can will would should could may might must shall "
    "find show give tell want need please best good bad how why when where"
).split()
# Words that a term label leaves out.
LABEL_STOPWORDS = (
    "the and for with from this that how why what your you are was were has have had not but can will our out get "
    "guide introduction intro tutorial using use part com www html http https org net about into over when where which who its his her"
).split()
# Letters with marks that Latin text uses, and what is left without the marks.
MARKED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšž"
UNMARKED = "aaaaaaaeeeeeiiiiioooooouuuuuyyncsz"

QUERY_WORD = r"[\p{L}\p{N}'\-]+"


def query_words(query: Column) -> Column:
    """The words of a query that a lexical search looks for, in their order, repeats included."""
    return F.filter(F.regexp_extract_all(query, F.lit(f"({QUERY_WORD})"), F.lit(1)), lambda w: ~F.lower(w).isin(*QUERY_STOPWORDS))


def sanitized(query: Column) -> Column:
    """The query as alternatives of quoted phrases; empty if no word is left."""
    return F.array_join(F.transform(query_words(query), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def tokens(text: Column) -> Column:
    """Index tokens without stemming: runs of letters and digits in lower case without marks, by expressions."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, UNMARKED), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def label_terms(title: Column) -> Column:
    """Terms of a title that may name a cluster: at least three ASCII letters or digits, no stopword."""
    return F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*LABEL_STOPWORDS))


def _bare(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


_RUN = re.compile(r"[^\W_]+")


_FORMS: dict[str, str] = {}
_MOST_FORMS = 200_000


def token(run: str) -> str:
    """The index token of a run of letters and digits, remembered within bounds."""
    found = _FORMS.get(run)
    if found is None:
        if len(_FORMS) >= _MOST_FORMS:
            _FORMS.clear()
        found = _FORMS[run] = stem(_bare(run))
    return found


def index_tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(stemmed token, begin, end) of each run of letters and digits."""
    return [(token(m.group()), m.start(), m.end()) for m in _RUN.finditer(text or "")]


# --- Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) -----------------------------

_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, rules) -> tuple[str, str] | None:
    fits = [r for r in rules if word.endswith(r[0])]
    return max(fits, key=lambda r: len(r[0])) if fits else None


def stem(word: str) -> str:
    """The stem of a lower-case token; short, very long and non-ASCII tokens stay."""
    return _stem(word) if 2 < len(word.encode()) < 64 and word.isascii() else word


def _stem(w: str) -> str:
    if w.endswith("s"):
        two = (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3)
        w = w[:-2] if two else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        rule = _longest(w, rules)
        if rule and _measure(w[: -len(rule[0])]) > 0:
            w = w[: -len(rule[0])] + rule[1]
    rule = _longest(w, [(s, "") for s in _STEP4])
    if rule:
        rest = w[: -len(rule[0])]
        if _measure(rest) > 1 and (rule[0] != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _ends_cvc(rest)):
            w = rest
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(texts: pd.Series) -> pd.Series:
    return pd.Series([list(map(token, _RUN.findall(x or ""))) for x in texts], dtype=object)


# --- phrases in texts, without a stem for each token -------------------------------------------------------------


def _begins(stemmed: str) -> str:
    """How each token begins that has this stem.

    A step of the stemmer cuts a word off; what it writes anew is one e, one i (for y) or the le of ble (for biliti), all at the end.
    """
    if stemmed.endswith("ble"):
        return stemmed[:-2]
    return stemmed[:-1] if stemmed.endswith(("e", "i", "bl")) else stemmed


@cache
def _spellings() -> dict[str, str]:
    """Characters of tokens, each with those of texts that become it. Sigmas, which depend on their place, and what a character
    becomes together with others are left out."""
    out: dict[str, str] = {}
    mixed = set("σς")
    for c in filter(str.isalnum, map(chr, range(0x110000))):
        bare = _bare(c)
        if len(bare) == 1:
            out[bare] = out.get(bare, "") + c
        else:
            mixed |= set(bare)
    return {b: c for b, c in out.items() if b not in mixed}


def _run_of(stemmed: str) -> str:
    """A pattern of runs that finds all with this token, and more."""
    known = ""
    for c in _begins(stemmed):
        if c not in _spellings():
            break
        known += f"[{_spellings()[c]}]"  # letters and digits only
    return known + r"[^\W_]*+" if known else r"[^\W_]++"


def phrase_counter(phrases: list[list[str]]) -> Callable[[str | None], list[int]]:
    """A function of texts: how many tokens one has, then how often each phrase (of stems) stands in it.

    Runs are counted, and those kept where a phrase may begin, in one pass; only these and what follows them in the phrase are stemmed. So the
    cost hardly depends on how many different words the texts have. Where phrases begin alike the longest that fits is kept, and all are looked for in it.
    """
    may = "|".join(r"[\W_]++".join(map(_run_of, p)) for p in sorted(phrases, key=len, reverse=True))
    runs = re.compile(rf"(?:(?=({may}))|)[^\W_]++")

    def count(text: str | None) -> list[int]:
        kept = runs.findall(text or "")
        out = [len(kept)] + [0] * len(phrases)
        for found in filter(None, kept):
            tokens = list(map(token, _RUN.findall(found)))
            for k, p in enumerate(phrases, 1):
                out[k] += tokens[: len(p)] == p
        return out

    return count


def phrase_counts(texts: list[Column], phrases: list[list[str]]) -> Column:
    """The sums of what phrase_counter counts in each of texts: no phrase runs from one into the next."""
    count = phrase_counter(phrases)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(*each: pd.Series) -> pd.Series:
        return pd.Series([[sum(n) for n in zip(*map(count, row))] for row in zip(*each)], dtype=object)

    return of(*texts)


def title_cased(word: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))
