"""Secret scans: fixed patterns, and guess costs of the values that stand where credentials stand.

The guess cost of a value is the least log10 of guesses over all ways to cut it into words, dates,
repeats, keyboard walks and brute-force characters (dynamic programming, linear in the value's length).
Values that cost at least `least_cost` become spans of kind `guess`.

Words come with ranks, the guesses that they take. They are those of the public vocabularies, whose numbers
follow their frequency (some 30,000 whole words of several languages), behind a few common passwords.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable
from math import log10

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, read

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)
HEX = re.compile(r"[0-9a-f]{24,}", re.A)

#: Where credentials stand: a name, a mark of assignment, a value (group 1).
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|authorization)["']?[ \t]{0,4}(?:=>|:=|[:=]|\bis\b)[ \t]{0,4}["']?([^\s"'<>]{6,})""",
    re.I | re.A,
)
#: A text without any of these matches neither ASSIGN nor CONTEXT.
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")

#: Common passwords and words that stand for them, by falling frequency.
PASSWORDS = tuple(
    """password admin user login welcome letmein master secret token key test example dragon monkey sunshine princess football baseball shadow
    summer winter spring autumn love hello freedom whatever trust hunter ranger access server root guest default change changeme temp demo sample
    dummy none null true false""".split()
)

#: Vocabularies that give words and their ranks (files of public_tokenizers).
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@functools.cache
def ranked_words(vocabularies: tuple[str, ...] = VOCABULARIES, first: tuple[str, ...] = PASSWORDS) -> dict[str, int]:
    """word -> rank (from 1): `first` in its order, then the vocabularies' whole words of three letters or more, in lower case.

    A word's rank is the smallest of its numbers in the vocabularies, behind those of `first`. Read by each task, not sent.
    """
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(first)))}
    found: dict[str, int] = {}
    for name in vocabularies:
        with open(public_tokenizers.path(name), "rb") as lines:
            for token, number in map(bytes.split, lines):
                word = base64.b64decode(token).decode("utf-8", "replace")
                if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                    low = word[1:].lower()
                    found[low] = min(found.get(low, 1 << 30), int(number))
    for word, number in found.items():
        ranks.setdefault(word, len(first) + number + 1)
    return ranks


ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$57@", "aeoissta")
#: Dates with their guesses; a place may begin one of each form.
DAY, MONTH, MARK = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", "[-/._]?"
YEAR = r"(?:19|20)\d\d"
DATES = [(re.compile(f"(?=({p}))", re.A), log10(n)) for p, n in ((YEAR, 120), (YEAR + MARK + MONTH + MARK + DAY, 365 * 120), (DAY + MARK + MONTH + MARK + YEAR, 365 * 120))]

#: Repeats and walks are as long as they can be, or of at most so many characters.
REACH = 32


def _neighbours() -> dict[str, frozenset[str]]:
    at = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {c: frozenset(d for d, (v, u) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1) for c, (y, x) in at.items()}


NEXT_TO = _neighbours()


def guess_cost(value: str, ranks: dict[str, int], longest: int) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in DATES:
        for m in pattern.finditer(value):
            dates.setdefault(m.end(1), []).append((m.start(), cost))
    best = [0.0] * (n + 1)
    repeat = walk = 0  # where the run of equal characters, and that of neighbouring keys, began
    for j in range(1, n + 1):
        c = low[j - 1]
        if j > 1:
            repeat = repeat if value[j - 1] == value[j - 2] else j - 1
            walk = walk if c in NEXT_TO.get(low[j - 2], ()) else j - 1
        kind = 26 if c.isalpha() and value[j - 1] == c else 52 if c.isalpha() else 10 if c.isdigit() else 95
        cost = best[j - 1] + log10(kind)
        for start, least, base in ((repeat, 3, kind), (walk, 4, len(NEXT_TO) * 4)):
            if j - start >= least:
                if j - start > REACH:
                    cost = min(cost, best[start] + log10(base * (j - start)))
                for i in range(max(start, j - REACH), j - least + 1):
                    cost = min(cost, best[i] + log10(base * (j - i)))
        for i, guesses in dates.get(j, ()):
            cost = min(cost, best[i] + guesses)
        for i in range(max(0, j - longest), j - 2):
            if (rank := ranks.get(low[i:j])) or (rank := 2 * ranks.get(plain[i:j], 0)):
                cost = min(cost, best[i] + log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0))
        best[j] = cost
    return best[n]


def scanner(least_cost: float, vocabularies: tuple[str, ...] = VOCABULARIES) -> Callable[[str], list[tuple[str, int, int]]]:
    ranks = ranked_words(vocabularies)
    longest = max(map(len, ranks), default=0)

    def scan(text: str) -> list[tuple[str, int, int]]:
        spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        low = text.lower()
        if any(h in low for h in HINTS):
            spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
            spans += [("guess", m.start(1), m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks, longest) >= least_cost]
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))

    return scan


def scan_secrets(docs: DataFrame, least_cost: float = 9.0, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) by start, then kind; places are code points, ends exclusive.

    One narrow pass over whole texts, however long. Null and empty texts have no spans; a null doc_id stays; repeated rows
    each get a row; spans of several kinds at one place all stay; an empty table gives no rows.
    """

    def make():
        scan = scanner(least_cost, vocabularies)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t)] if t else [] for t in batch[1].to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch[0], pa.array(found, kind)], ["doc_id", "spans"])

        return work

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def hide(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping or touching spans replaced by a mark of the first one's kind."""
    out, at, done = [], 0, -1
    for kind, start, end in spans:
        if start > done:
            out += [text[at:start], f"[{kind}]"]
        done = max(done, end)
        at = done
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, least_cost: float = 9.0, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The same rows and columns; in `text`, spans are replaced by marks like [assign]. n_chars, if there, follows.

    Null and empty texts stay as they are (a null text has a null n_chars); ids take no part; repeated rows all stay; an
    empty table gives no rows; other columns are left as they are.
    """

    def make():
        scan = scanner(least_cost, vocabularies)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            texts = [hide(t, s) if t and (s := scan(t)) else t for t in batch[at].to_pylist()]
            return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        return work

    out = arrow_pass(docs, make, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"))
