"""Memories as text: one header, one line of names, a line per note, a line per link; and back.

    FILE:<notes, 3 digits>|<codes of the first 3 names>|<date>|<title>|v2
    E:<code>=<name>;...
    <id>:<codes by +>|<topics by ,>|"<quote>"|<weight, 2 places>|<emotions by +>|<flags by +>[|<start>-<end>]
    T:<id><-><id>|<label>

Values escape by a backslash what would part them. Lines of the older form (no v2 in the header) have no escapes, topics
by _ and no line of names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions.annotate import BLANKS, EDGES, collation, half_up
from ..functions.text import escape_field, escape_name, escape_quote, escape_topic
from ..operators.links import in_order

# ---- out, as expressions


def coded(names: Column | str, book: Column | str) -> Column:
    """Codes of names by a map; of unknown ones the first three letters."""
    names, book = (F.col(c) if isinstance(c, str) else c for c in (names, book))
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(book, n), F.upper(F.substring(n, 1, 3))))


def note_line(notes: DataFrame) -> Column:
    """A note's line; the notes have a column `book`, a map from names to codes."""
    places = {"source_start", "source_end"} <= set(notes.columns)
    span = F.when(F.col("source_start").isNotNull() & F.col("source_end").isNotNull(), F.concat(F.lit("|"), "source_start", F.lit("-"), "source_end")) if places else F.lit(None)
    return F.concat(
        "id", F.lit(":"), F.array_join(coded("entities", "book"), "+"), F.lit("|"), F.array_join(F.transform("topics", escape_topic), ","), F.lit('|"'), escape_quote("quote"),
        F.lit('"|'), F.format_string("%.2f", "weight"), F.lit("|"), F.array_join("emotions", "+"), F.lit("|"), F.array_join("flags", "+"), F.coalesce(span, F.lit("")),
    )


def link_line() -> Column:
    return F.concat(F.lit("T:"), "from_id", F.lit("<->"), "to_id", F.lit("|"), "label")


def with_book(notes: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds `book`: each document's map from names to codes."""
    books = codes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "code"))).alias("book"))
    empty = F.create_map().cast("map<string,string>")
    return notes.join(books, "doc_id", "left").withColumn("book", F.coalesce("book", empty))


def header(n: Column, tops: Column) -> Column:
    """The first line, from the number of notes and the first codes; `date` and `title` are columns."""
    n = n.cast("string")
    said = [escape_field(F.coalesce(c, F.lit(""))) for c in ("date", "title")]
    return F.concat(F.lit("FILE:"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")), F.lit("|"), tops, F.lit("|"), said[0], F.lit("|"), said[1], F.lit("|v2"))


def heads_of(notes: DataFrame, meta: DataFrame | None) -> DataFrame:
    """doc_id, date, title: one row for each memory, those without notes included if meta tells of them."""
    if meta is not None:
        return meta.select("doc_id", "date", "title")
    none = F.lit(None).cast("string")
    return notes.select("doc_id").distinct().select("doc_id", none.alias("date"), none.alias("title"))


def encode(notes: DataFrame, links: DataFrame, codes: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """doc_id, text for each document. Notes go by `rank` if they have it, else by seq; meta: doc_id, date, title.

    With meta, documents without notes have a header alone; without, they are unknown.
    """
    order = "rank" if "rank" in notes.columns else "seq"
    rows = with_book(notes, codes)
    named_in = rows.select("doc_id", F.col(order).alias("at"), F.posexplode("entities").alias("pos", "name"), "book")
    first = named_in.groupBy("doc_id", "name").agg(F.min(F.struct("at", "pos")).alias("seen"), F.first("book").alias("book"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("seen"))).where("k <= 3")
    first = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", coded(F.array("name"), "book")[0].alias("code")))).alias("tops"))
    heads = heads_of(notes, meta).join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").join(first, "doc_id", "left")
    tops = F.array_join(F.transform(F.coalesce("tops", F.array().cast("array<struct<k:int,code:string>>")), lambda x: x["code"]), "+")
    zero = F.lit(0).cast("long")
    lines = heads.select("doc_id", F.lit(0).alias("part"), zero.alias("at"), header(F.coalesce("n", zero), tops).alias("line"))
    entries = F.array_sort(F.collect_list(F.struct("code", F.concat("code", F.lit("="), escape_name("name")).alias("entry"))))
    named = codes.join(heads.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(entries.alias("e"))
    lines = lines.unionByName(named.select("doc_id", F.lit(1).alias("part"), zero.alias("at"), F.concat(F.lit("E:"), F.array_join(F.transform("e", lambda x: x["entry"]), ";")).alias("line")))
    lines = lines.unionByName(rows.select("doc_id", F.lit(2).alias("part"), F.col(order).cast("long").alias("at"), note_line(rows).alias("line")))
    lines = lines.unionByName(in_order(links).select("doc_id", F.lit(3).alias("part"), F.col("at").cast("long"), link_line().alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(text.alias("text"))


# ---- one document's memory, plainly


def count_tokens(text: str) -> int:
    return math.ceil(max(sum(map(bool, BLANKS.split(text))) * 1.3, len(text) / 4))


def escaped(s: str, marks: str) -> str:
    for c in ("\\", *marks):
        s = s.replace(c, "\\" + ("_" if c == " " else c))
    return s.replace("\r", "\\r").replace("\n", "\\n")


# Names of what JSON shows, and what they stand for here.
JSON_NOTE = {
    "id": "id", "entities": "entities", "topics": "topics", "quote": "quote", "weight": "weight", "emotions": "emotions", "flags": "flags",
    "sourceStart": "source_start", "sourceEnd": "source_end", "resolvedDate": "resolved_date",
}
JSON_LINK = {"from": "from_id", "to": "to_id", "label": "label"}
JSON_WHOLE = ("zettels", "tunnels")


def two_places(x: float) -> str:
    """Halves go up, by the double's exact value."""
    return str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


@dataclass
class Plain:
    """One document's memory. Links are in the order in which they are shown."""

    notes: list[dict]
    links: list[dict]
    codes: dict[str, str]
    date: str | None = None
    title: str | None = None
    warnings: list[str] = field(default_factory=list)

    def line(self, z: dict, format: str = "text") -> str:
        if format == "markdown":
            parts = [p for p in (z.get("resolved_date"), ", ".join(z["flags"])) if p]
            return f"**[{z['id']}]** " + (f"*({' · '.join(parts)})* " if parts else "") + z["quote"]
        if format == "json":
            return json.dumps(self.shown(z), indent=2, ensure_ascii=False)
        place = f"|{z['source_start']}-{z['source_end']}" if z.get("source_start") is not None and z.get("source_end") is not None else ""
        named = "+".join(self.codes.get(n, n[:3].upper()) for n in z["entities"])
        said = ",".join(escaped(t, ",| ") for t in z["topics"])
        return f'{z["id"]}:{named}|{said}|"{escaped(z["quote"], chr(34))}"|{two_places(z["weight"])}|{"+".join(z["emotions"])}|{"+".join(z["flags"])}{place}'

    @staticmethod
    def shown(z: dict) -> dict:
        out = {k: z[c] for k, c in JSON_NOTE.items() if z.get(c) is not None}
        weight = out["weight"]
        return out | {"weight": int(weight) if weight == int(weight) else weight}

    def render(self, chosen: list[dict], format: str = "text") -> str:
        if format == "markdown":
            return "\n\n".join(self.line(z, format) for z in chosen)
        ids = {z["id"] for z in chosen}
        ties = [t for t in self.links if {t["from_id"], t["to_id"]} <= ids]
        if format == "json":
            told = (list(map(self.shown, chosen)), [{k: t[c] for k, c in JSON_LINK.items()} for t in ties])
            return json.dumps(dict(zip(JSON_WHOLE, told, strict=True)), indent=2, ensure_ascii=False)
        names = list(dict.fromkeys(n for z in chosen for n in z["entities"]))
        used = {self.codes[n]: n for n in names if n in self.codes}
        tops = "+".join(self.codes.get(n, n[:3].upper()) for n in names[:3])
        out = [f"FILE:{len(chosen):03d}|{tops}|{escaped(self.date or '', '|')}|{escaped(self.title or '', '|')}|v2"]
        if used:
            out.append("E:" + ";".join(f"{c}={escaped(n, ';=')}" for c, n in sorted(used.items())))
        return "\n".join([*out, *map(self.line, chosen), *(f"T:{t['from_id']}<->{t['to_id']}|{t['label']}" for t in ties)])


# ---- in

ENDS = {"n": "\n", "r": "\r"}


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: ENDS.get(m[1], m[1]), s)


def unescaped_topic(s: str) -> str:
    return unescaped(s.replace("\\_", " "))


def parted(s: str, mark: str) -> list[str]:
    """Split at marks that no backslash escapes."""
    out, at = [], 0
    for m in re.finditer(r"\\.|(" + re.escape(mark) + ")", s, re.S):
        if m[1] is not None:
            out.append(s[at : m.start()])
            at = m.end()
    return [*out, s[at:]]


def number(s: str) -> float | None:
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)", s)
    return float(m[0]) if m else None


class Reader:
    """Reads one text; strict readers raise what others note as warnings."""

    def __init__(self, strict: bool = False) -> None:
        self.strict, self.v2, self.declared = strict, False, None
        self.memory = Plain([], [], {})
        self.names: dict[str, str] = {}

    def warn(self, what: str) -> None:
        if self.strict:
            raise ValueError(what)
        self.memory.warnings.append(what)

    def read(self, text: str) -> Plain:
        for line in filter(None, (x.strip(EDGES) for x in text.split("\n"))):
            if line.startswith("FILE:"):
                self.header(parted(line[5:], "|"))
            elif line.startswith("E:"):
                for entry in filter(None, parted(line[2:], ";")):
                    code, *name = parted(entry, "=")
                    if name and code:
                        self.names[unescaped(code)] = unescaped("=".join(name))
            elif line.startswith("T:"):
                ends, _, label = line[2:].partition("|")
                a, arrow, b = ends.partition("<->")
                if arrow:
                    self.memory.links.append({"from_id": a, "to_id": b, "label": label})
                else:
                    self.warn(f"malformed link line skipped: '{line[:40]}'")
            elif note := self.note(line):
                self.memory.notes.append(note)
            else:
                self.warn(f"malformed note line skipped: '{line[:40]}'")
        if self.declared is not None and self.declared != len(self.memory.notes):
            self.warn(f"header declares {self.declared} notes but {len(self.memory.notes)} parsed")
        self.memory.codes = {name: code for code, name in self.names.items()}
        return self.memory

    def header(self, parts: list[str]) -> None:
        parts += [""] * 5
        self.v2 = parts[4] == "v2"
        if m := re.match(r"\s*[+-]?\d+", parts[0]):
            self.declared = int(m[0])
        self.memory.date, self.memory.title = unescaped(parts[2]) or None, unescaped(parts[3]) or None

    def note(self, line: str) -> dict | None:
        m = re.match(r'(\d+):([^"]*)"((?:[^"\\]|\\.)*)"(.*)$' if self.v2 else r'(\d+):([^"]*)"(.*)"(.*?)$', line, re.S | re.A)
        if not m:
            return None
        split = parted if self.v2 else str.split
        before, after = split(m[2], "|") + [""], split(m[4], "|") + [""] * 5
        weight = number(after[1] or ("" if self.v2 or len(split(m[4], "|")) > 1 else "0"))
        if weight is None:
            return None
        codes = [c for c in before[0].split("+") if c]
        for c in codes:
            if c not in self.names:
                if self.v2:
                    self.warn(f"note {m[1]}: name code '{c}' missing from index")
                else:
                    self.names[c] = c
        topics = [unescaped_topic(t) for t in parted(before[1], ",") if t] if self.v2 else [t for t in before[1].split("_") if t]
        span = re.fullmatch(r"(\d+)-(\d+)", after[4], re.A) if self.v2 else None
        return {
            "id": m[1],
            "entities": [self.names.get(c, c) for c in codes],
            "topics": topics,
            "quote": unescaped(m[3]) if self.v2 else m[3],
            "weight": half_up(weight),
            "emotions": self.known(after[2], lex.EMOTIONS, m[1], "emotion"),
            "flags": self.known(after[3], lex.FLAGS, m[1], "flag"),
            "source_start": int(span[1]) if span else None,
            "source_end": int(span[2]) if span else None,
        }

    def known(self, text: str, table: dict, id: str, kind: str) -> list[str]:
        out = []
        for x in filter(None, text.split("+")):
            if x in table:
                out.append(x)
            else:
                self.warn(f"note {id}: unknown {kind} '{x}' dropped")
        return out


NOTE = "struct<seq:int,id:string,entities:array<string>,topics:array<string>,quote:string,weight:double,emotions:array<string>,flags:array<string>,source_start:int,source_end:int>"
DECODED = f"doc_id long, notes array<{NOTE}>, links array<struct<from_id:string,to_id:string,label:string>>, codes array<struct<name:string,code:string>>, date string, title string, warnings array<string>, input_length long"


def decode_rows(texts: DataFrame, strict: bool = False) -> DataFrame:
    """One row per text (doc_id, text) with its notes, links, codes, header and warnings. Strict: the first fault raises."""
    kind = texts.sparkSession.createDataFrame([], DECODED).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                m = Reader(strict).read(text or "")
                notes = [z | {"seq": i + 1} for i, z in enumerate(m.notes)]
                rows.append({"doc_id": doc, "notes": notes, "links": m.links, "codes": [{"name": n, "code": c} for n, c in m.codes.items()], "date": m.date, "title": m.title, "warnings": m.warnings, "input_length": sum(len(z["quote"]) for z in m.notes)})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


__all__ = ["Plain", "Reader", "collation", "count_tokens", "decode_rows", "encode", "link_line", "note_line", "with_book"]
