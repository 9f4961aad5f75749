"""Text column expressions (F1-F8, F16, P9). All are built-in Spark SQL expressions, so
they run inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes (Unicode White_Space plus the
# ASCII information separators \x1c-\x1f).
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")

# Fixed value: a word is a maximal run of letters, digits and underscore (the reference's
# (?u)\b\w+\b in Unicode terms).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

def strip_ws(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``str.strip``), not only
    spaces as plain ``trim`` does (trap T2). ``trim`` with an explicit character set only
    looks at the two ends of the string (no regex scan of the whole text)."""
    return F.trim(c, F.lit(STRIP_CHARS))


# Hangul syllables decompose by rule into jamo: first code point, and the counts of vowels x
# trailing jamo and of trailing jamo.
_HANGUL, _HANGUL_END, _VT, _T = 0xAC00, 0xD7A3, 588, 28
_SEPARATOR = "\x01"


@lru_cache(maxsize=None)
def _accent_tables():
    """Derive the folding of every code point by rule: NFKD-decompose and drop combining marks
    (what ``strip_accents='unicode'`` does per character). Returns (from_chars, to_chars,
    deletions, expansions): one-to-one replacements for ``translate``, characters that fold to
    nothing, and those that fold to several (Hangul syllables left out)."""
    one_from, one_to, deletions, expansions = [], [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or _HANGUL <= cp <= _HANGUL_END:
            continue
        ch = chr(cp)
        folded = "".join(x for x in unicodedata.normalize("NFKD", ch)
                         if not unicodedata.combining(x))
        if folded == ch:
            continue
        if len(folded) == 1:
            one_from.append(ch)
            one_to.append(folded)
        elif len(folded) == 0:
            deletions.append(ch)
        else:
            expansions.append((ch, folded))
    return "".join(one_from), "".join(one_to), "".join(deletions), tuple(expansions)


def _jamo() -> tuple[Column, Column, Column]:
    """The leading, vowel and trailing jamo as constant arrays (the first trailing one is none)."""
    arr = lambda cps: F.split(F.lit(_SEPARATOR.join(cps)), _SEPARATOR)
    return (arr([chr(0x1100 + i) for i in range(19)]), arr([chr(0x1161 + i) for i in range(21)]),
            arr([""] + [chr(0x11A8 + i) for i in range(_T - 1)]))


def strip_accents(c: Column) -> Column:
    """Unicode accent stripping (NFKD, then drop combining marks) of all code points, in the JVM. Texts of
    ASCII alone stay as they are; texts with Latin letters besides take one ``translate`` of those; others take
    the whole table, and only those that hold a character with a longer folding, a replacement character by
    character."""
    src, dst, dele, expansions = _accent_tables()
    latin = [(a, b) for a, b in zip(src, dst) if ord(a) <= _LATIN_END]
    some = F.translate(c, "".join(a for a, _ in latin), "".join(b for _, b in latin))
    out = F.translate(c, src + dele, dst)
    keys, values = (F.split(F.lit(_SEPARATOR.join(x)), _SEPARATOR) for x in zip(*expansions))
    table = F.map_from_arrays(keys, values)
    lead, vowel, trail = _jamo()

    def one(ch: Column) -> Column:
        s = F.ascii(ch) - _HANGUL
        hangul = F.concat(F.get(lead, F.floor(s / _VT).cast("int")),
                          F.get(vowel, F.floor(s % _VT / _T).cast("int")), F.get(trail, s % _T))
        return F.when((s >= 0) & (s <= _HANGUL_END - _HANGUL), hangul) \
            .otherwise(F.coalesce(F.try_element_at(table, ch), ch))

    longer = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), one), "")
    other = F.translate(c, _latin(), "")
    return (F.when(F.octet_length(c) == F.length(c), c).when(F.octet_length(other) == F.length(other), some)
            .when(out.rlike(_guard()), longer).otherwise(out))


_LATIN_END = 0x24F


def _ranges(cps) -> str:
    """Sorted code points as ranges of a character class."""
    ranges: list[list[int]] = []
    for cp in cps:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join("\\x{%X}-\\x{%X}" % (a, b) for a, b in ranges)


@lru_cache(maxsize=None)
def _latin() -> str:
    """The Latin letters beyond ASCII that fold to one character or to themselves. A text that is ASCII without them
    holds no other character; ``translate`` tells that several times faster than a class of their ranges."""
    _, _, dele, expansions = _accent_tables()
    other = set(map(ord, dele)) | {ord(ch) for ch, _ in expansions}
    return "".join(chr(cp) for cp in range(0x80, _LATIN_END + 1) if cp not in other)


@lru_cache(maxsize=None)
def _guard() -> str:
    """A character class of all code points with a longer folding, as ranges."""
    cps = {ord(ch) for ch, _ in _accent_tables()[3]} | set(range(_HANGUL, _HANGUL_END + 1))
    return "[" + _ranges(sorted(cps)) + "]"


def normalize_text(c: Column) -> Column:
    """F1 + F4: lower-case first, then strip accents (the reference's order)."""
    return strip_accents(F.lower(c))


def tokens(c: Column) -> Column:
    """words (letters, digits, underscore), one-character tokens and numbers kept."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def word_ngrams(toks: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """all word n-grams for n in [n_min, n_max], unigrams first, joined by one space.

    Built from shifted slices combined by ``zip_with``: no lambda refers to ``toks``, so
    the token array is evaluated once per row, not once per element."""
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(toks)
            continue
        length = F.greatest(F.size(toks) - (n - 1), F.lit(0))
        grams = F.slice(toks, 1, length)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(toks, k + 1, length),
                               lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def analyzed_terms(text: Column, n_min: int = 1, n_max: int = 2) -> Column:
    """Lower-case, fold accents, tokenise and build n-grams: the analyzer of the TF-IDF
    vectorizer as one expression."""
    return word_ngrams(tokens(normalize_text(text)), n_min, n_max)


def sublinear_tf(tf: Column) -> Column:
    """1 + ln(tf) for tf >= 1."""
    return F.lit(1.0) + F.ln(tf.cast("double"))


def type_feature(c: Column) -> Column:
    """Transaction type -> +1 (contains 'credit', tested first), -1 (contains 'debit'),
    0 otherwise or when null. Lower-casing happens before the test; trimming cannot change
    a substring test, so it is not needed."""
    low = F.lower(c)
    return (F.when(c.isNull(), F.lit(0.0))
            .when(low.contains("credit"), F.lit(1.0))
            .when(low.contains("debit"), F.lit(-1.0))
            .otherwise(F.lit(0.0)))


def prefix(c: Column, n: int = 80) -> Column:
    """F16: first ``n`` characters."""
    return F.substring(c, 1, n)
