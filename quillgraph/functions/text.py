"""Column expressions over text. Offsets and lengths count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SEARCH_STOP

#: White space, for character classes: the JVM's \s is ASCII only.
BLANK = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Word borders by ASCII word characters: the JVM's \b follows Unicode.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newlines(c: Column | str) -> Column:
    """CR and CRLF become LF."""
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^[{BLANK}]+|[{BLANK}]+$", "")


def words(c: Column | str) -> Column:
    """Runs without white space; none in an empty text."""
    return F.filter(F.split(col(c), f"[{BLANK}]+"), lambda w: w != "")


def token_estimate(c: Column | str) -> Column:
    """The larger of 1.3 times the words and a quarter of the characters, rounded up."""
    c = col(c)
    return F.ceil(F.greatest(F.size(words(c)) * 1.3, F.length(c) / 4)).cast("long")


def fold(c: Column | str) -> Column:
    """Takes common endings off an English word."""
    t = col(c)

    def cut(s: Column, n: int) -> Column:
        return F.substring(s, F.lit(1), F.length(s) - n)

    def has(s: Column, *ends: str) -> Column:
        return F.coalesce(*[F.when(s.endswith(e), True) for e in ends], F.lit(False))

    n = F.length(t)
    s = (
        F.when((n > 4) & has(t, "ies"), F.concat(cut(t, 3), F.lit("y")))
        .when((n > 4) & has(t, "ches", "shes", "sses", "xes", "zes"), cut(t, 2))
        .when((n > 3) & has(t, "s") & ~has(t, "ss", "us"), cut(t, 1))
        .otherwise(t)
    )
    return _rest(s, cut, has)


def folded(word: str) -> str:
    """The same of one word, plainly."""
    s = word
    if len(s) > 4 and s.endswith("ies"):
        s = s[:-3] + "y"
    elif len(s) > 4 and s.endswith(("ches", "shes", "sses", "xes", "zes")):
        s = s[:-2]
    elif len(s) > 3 and s.endswith("s") and not s.endswith(("ss", "us")):
        s = s[:-1]
    for least, ends, n in ((5, ("ing",), 3), (4, ("ed",), 2)):
        if len(s) > least and s.endswith(ends):
            s = s[:-n]
            break
    for least, ends, n in ((5, ("tion", "sion"), 3), (5, ("ly",), 2), (4, ("e",), 1)):
        if len(s) > least and s.endswith(ends):
            s = s[:-n]
    return s[:-1] if len(s) > 3 and s[-1] == s[-2] and s[-1] not in "aeiou" else s


def _rest(s: Column, cut, has) -> Column:
    # a one-element array binds the intermediate value once, so that expressions don't double at each rule
    steps = [
        lambda v: F.when((F.length(v) > 5) & has(v, "ing"), cut(v, 3)).when((F.length(v) > 4) & has(v, "ed"), cut(v, 2)).otherwise(v),
        lambda v: F.when((F.length(v) > 5) & has(v, "tion", "sion"), cut(v, 3)).otherwise(v),
        lambda v: F.when((F.length(v) > 5) & has(v, "ly"), cut(v, 2)).otherwise(v),
        lambda v: F.when((F.length(v) > 4) & has(v, "e"), cut(v, 1)).otherwise(v),
        lambda v: F.when((F.length(v) > 3) & (F.substring(v, -1, 1) == F.substring(v, -2, 1)) & ~F.substring(v, -1, 1).isin(*"aeiou"), cut(v, 1)).otherwise(v),
    ]
    out = F.array(s)
    for step in steps:
        out = F.transform(out, step)
    return out[0]


def tokens(c: Column | str, stop: list[str] = SEARCH_STOP) -> Column:
    """Search tokens in order: lower case, two characters or more, no stop words, folded."""
    parts = F.split(F.lower(col(c)), "[^a-z0-9_]+")
    return F.transform(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*stop)), fold)


def exploded(rows, *keys: str, of: str, name: str):
    """A row per element of an array column. The outer form, for a plain explode's own filter would work the array out twice."""
    return rows.select(*keys, F.explode_outer(of).alias(name)).where(F.col(name).isNotNull())


def name_code(c: Column | str) -> Column:
    """Three letters for a name: its first letter and two consonants, or what comes near."""
    letters = F.upper(F.regexp_replace(col(c), "[^a-zA-Z]", ""))
    first, rest = F.substring(letters, 1, 1), F.substring(letters, F.lit(2), F.length(letters))
    consonants = F.regexp_replace(rest, "[AEIOU]", "")
    return (
        F.when(letters == "", "UNK")
        .when(F.length(consonants) >= 2, F.concat(first, F.substring(consonants, 1, 2)))
        .when(F.length(consonants) == 1, F.concat(first, consonants, F.substring(letters, -1, 1)))
        .otherwise(F.rpad(F.concat(first, F.substring(rest, 1, 2)), 3, "X"))
    )


def plain_code(name: str) -> str:
    """The same of one name, plainly."""
    letters = re.sub("[^a-zA-Z]", "", name).upper()
    if not letters:
        return "UNK"
    rest = re.sub("[AEIOU]", "", letters[1:])
    if len(rest) > 1:
        return letters[0] + rest[:2]
    return letters[0] + rest + letters[-1] if rest else letters[:3].ljust(3, "X")


def note_id(seq: Column | str) -> Column:
    """A number from 1 on as text of three digits or more."""
    s = col(seq).cast("string")
    return F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0"))


def round2(c: Column | str) -> Column:
    """To two places, halves up, on the double's own value."""
    return F.floor(col(c) * 100 + 0.5) / 100


def literal_replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


LINE_ENDS = [("\r", "\\r"), ("\n", "\\n")]


def escape_quote(c: Column | str) -> Column:
    return literal_replace(col(c), [("\\", "\\\\"), ('"', '\\"'), *LINE_ENDS])


def escape_field(c: Column | str) -> Column:
    return literal_replace(col(c), [("\\", "\\\\"), ("|", "\\|"), *LINE_ENDS])


def escape_topic(c: Column | str) -> Column:
    return literal_replace(col(c), [("\\", "\\\\"), (",", "\\,"), ("|", "\\|"), (" ", "\\_"), *LINE_ENDS])


def escape_name(c: Column | str) -> Column:
    return literal_replace(col(c), [("\\", "\\\\"), (";", "\\;"), ("=", "\\="), *LINE_ENDS])


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def chunk_size_for(c: Column | str) -> Column:
    """A chunk size that suits a text's length."""
    n = F.length(col(c))
    return F.when(n < 1000, 150).when(n < 3000, 300).when(n < 8000, 500).otherwise(800)


def highlight(c: Column | str, question: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text as HTML; words that begin with one of the question's words of three characters or more are marked."""
    safe = literal_replace(col(c), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])
    terms = sorted({t for t in re.split("[^a-z0-9]+", question.lower()) if len(t) > 2})
    return F.regexp_replace(safe, f"(?i){LEFT}(?:{'|'.join(terms)})[a-z]*", f"{before}$0{after}") if terms else safe
