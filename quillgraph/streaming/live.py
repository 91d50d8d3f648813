"""Incremental memories: messages come in, notes decay, are absorbed and evicted; a snapshot is a memory.

The state of a conversation is a function of its messages in turn order. `replay` runs it over a table, `live` over a
stream with keyed state; both use the same class.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RecallOptions, StreamOptions
from ..functions import annotate
from ..functions.annotate import collation
from ..functions.text import plain_code, round2
from ..operators import links, weights
from ..operators.dedupe import plain_tokens
from ..operators.weights import decayed


@dataclass
class Live:
    """One conversation's state. The log of what was pushed isn't kept here: it is the table the messages come from."""

    turn: int = 0
    pushed: int = 0
    made: int = 0
    log_length: int = 0
    notes: list[dict] = field(default_factory=list)
    codes: dict[str, str] = field(default_factory=dict)
    recent: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.known: dict[int, frozenset[str]] = {}  # tokens of notes, no part of the state

    @classmethod
    def load(cls, text: str) -> Live:
        return cls(**json.loads(text))

    def dump(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    def push(self, text: str | None, options: StreamOptions) -> None:
        build = options.build
        text = text or ""
        self.turn += 1
        self.pushed += len(text)
        text = re.sub(r"\r\n?", "\n", text)
        parts = annotate.passages(text, build.chunk_size, build.chunk_overlap)
        if not parts:
            return
        base = self.log_length + 2 if self.log_length else 0
        self.log_length = base + len(text)
        met = annotate.Mentions(self.recent)
        bodies = [text[s:e] for s, e in parts]
        named = [met.resolve(b, annotate.names(b, build.min_entity_frequency)) for b in bodies]
        self.name({n for names in named for n in names})
        for (start, end), body, entities in zip(parts, bodies, named, strict=True):
            flags, emotions = annotate.signals(body, "flags"), annotate.signals(body, "emotions")
            note = {
                "entities": entities,
                "topics": annotate.topics(body, build.min_topic_frequency, build.stop_words),
                "quote": annotate.key_quote(body),
                "raw_weight": annotate.raw_weight(emotions, flags, body),
                "emotions": emotions,
                "flags": flags,
                "turn": self.turn,
                "source_start": base + start,
                "source_end": base + end,
            }
            if build.dedupe and self.absorb(note, build.dedupe_threshold):
                continue
            self.made += 1
            self.notes.append({"seq": self.made, "id": f"{self.made:03d}"} | note)
            self.recent = [n for n in self.recent if n not in entities] + list(entities)
        self.recent = self.recent[-8:]
        self.evict(options)

    def name(self, names: set[str]) -> None:
        """Codes for new names; none that is given changes."""
        used = set(self.codes.values())
        for n in sorted(names - self.codes.keys()):
            code = base = plain_code(n)
            k = 0
            while code in used:
                k += 1
                code = f"{base[:2]}{k}"
            used.add(code)
            self.codes[n] = code

    def absorb(self, note: dict, threshold: float) -> bool:
        """Into the first note that is near enough; that one is then as recent as this turn."""
        own = plain_tokens(note)
        for old in self.notes:
            theirs = self.known.get(old["seq"])
            if theirs is None:
                theirs = self.known[old["seq"]] = plain_tokens(old)
            if own and theirs and len(own & theirs) / len(own | theirs) >= threshold:
                old["turn"] = self.turn
                old["raw_weight"] = max(old["raw_weight"], note["raw_weight"])
                old["entities"] = sorted({*old["entities"], *note["entities"]})
                for k in ("topics", "emotions", "flags"):
                    old[k] = list(dict.fromkeys([*old[k], *note[k]]))
                del self.known[old["seq"]]
                return True
        return False

    def weight(self, note: dict, half_life: float | None) -> float:
        return note["raw_weight"] * (0.5 ** ((self.turn - note["turn"]) / half_life) if half_life and half_life > 0 else 1.0)

    def evict(self, options: StreamOptions) -> None:
        if options.max_notes is not None and len(self.notes) > options.max_notes:
            ranked = sorted(self.notes, key=lambda z: (self.weight(z, options.half_life_turns), z["turn"], collation(z["id"])))
            gone = {z["seq"] for z in ranked[: len(self.notes) - options.max_notes]}
            self.notes = [z for z in self.notes if z["seq"] not in gone]
            for seq in gone:
                self.known.pop(seq, None)


STATE = (
    "conv_id long, turn int, pushed long, notes array<struct<seq:int,id:string,entities:array<string>,topics:array<string>,quote:string,raw_weight:double,"
    "emotions:array<string>,flags:array<string>,turn:int,source_start:int,source_end:int>>, codes array<struct<name:string,code:string>>"
)


def shown(conv: int, live: Live) -> dict:
    return {"conv_id": conv, "turn": live.turn, "pushed": live.pushed, "notes": live.notes, "codes": [{"name": n, "code": c} for n, c in live.codes.items()]}


def replay(messages: DataFrame, options: StreamOptions = StreamOptions()) -> DataFrame:
    """STATE: each conversation's state after all its messages (conv_id, turn, text), streamed in turn order."""
    schema = messages.sparkSession.createDataFrame([], STATE).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = None, Live()
        for batch in batches:
            done = []
            for conv, text in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True):
                if conv != now:
                    if now is not None:
                        done.append(shown(now, live))
                    now, live = conv, Live()
                live.push(text, options)
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([shown(now, live)], arrow)

    rows = messages.select(F.col("conv_id").cast("long"), "turn", "text").where("conv_id IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return rows.mapInArrow(run, schema)


def live(messages: DataFrame, options: StreamOptions = StreamOptions()) -> DataFrame:
    """The same over a stream: after each micro-batch, the state of the conversations that it touched (update mode).

    Messages of one conversation that come in one batch are taken in turn order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Live.load(state.get[0]) if state.exists else Live()
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        for text in rows["text"]:
            memory.push(text, options)
        state.update((memory.dump(),))
        yield pd.DataFrame([{"conv_id": key[0], "turn": memory.turn, "pushed": memory.pushed, "state": memory.dump()}])

    rows = messages.select(F.col("conv_id").cast("long"), "turn", "text").where("conv_id IS NOT NULL")
    out = "conv_id long, turn int, pushed long, state string"
    states = rows.groupBy("conv_id").applyInPandasWithState(step, out, "state string", "update", GroupStateTimeout.NoTimeout)
    note = STATE[STATE.index("notes ") + 6 : STATE.index(", codes")]
    parsed = F.from_json("state", f"notes {note}, codes map<string,string>")
    entries = F.transform(F.map_entries(parsed["codes"]), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("code")))
    return states.select("conv_id", "turn", "pushed", parsed["notes"].alias("notes"), entries.alias("codes"))


def snapshot(states: DataFrame, options: StreamOptions = StreamOptions(), log: DataFrame | None = None):
    """A memory from states: decayed weights, then links, centrality and ranks as in a batch. For use in foreachBatch.

    log: the source_log of the messages that the states stand for. With it (and keep_source), questions search and show
    whole passages; without, only quotes, topics and names, as states don't hold the messages.
    """
    from ..plans.memory import NOTE, Memory

    rows = states.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("now"), F.inline("notes"))
    weight = round2(decayed(F.col("raw_weight"), F.col("now") - F.col("turn"), options.half_life_turns))
    rows = rows.withColumn("weight", weight).withColumn("resolved_date", F.lit(None).cast("string"))
    codes = states.select(F.col("conv_id").alias("doc_id"), F.inline("codes"))
    build = options.build
    tied = links.build_links(rows, codes, build.link_threshold, build.link_top_k, build.verbose_labels, build.full)
    notes = weights.normalize_weights(weights.blend_centrality(rows, tied), build.temperature).select(*NOTE)
    lit = F.lit
    kept = states.withColumn("source", lit(None).cast("string"))
    if log is not None and build.keep_source:
        kept = states.join(log.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("source")), "conv_id", "left")
    meta = kept.select(F.col("conv_id").alias("doc_id"), F.col("pushed").alias("input_length"), F.size("notes").alias("chunk_count"), lit(options.date).cast("string").alias("date"), lit(options.title).cast("string").alias("title"), lit(None).cast("array<string>").alias("warnings"), "source")
    return Memory(notes, tied, codes, meta)


def live_recall(
    messages: DataFrame, questions: DataFrame, answer: Callable[[DataFrame, int], None], options: StreamOptions = StreamOptions(),
    recall: RecallOptions = RecallOptions(), log: Callable[[], DataFrame] | None = None, max_tokens: int | None = None, context: bool = False,
) -> DataStreamWriter:
    """A stream that, after each micro-batch, asks the memories which it touched and hands the answers to `answer`.

    questions: query_id, doc_id (the conversation), text. Answers are hits, or passages with `context`. log reads the
    messages (conv_id, turn, text) that have come so far; notes' places index it, so more of them do no harm.
    Options of the writer (checkpoint, trigger) are the caller's; start() starts it.
    """

    def step(states: DataFrame, batch: int) -> None:
        states = states.persist()
        try:
            with snapshot(states, options, source_log(log()) if log else None) as memory:
                asked = questions.join(states.select(F.col("conv_id").alias("doc_id")), "doc_id", "left_semi")
                answer(memory.recall_context(asked, recall, max_tokens) if context else memory.recall(asked, recall), batch)
        finally:
            states.unpersist()

    return live(messages, options).writeStream.outputMode("update").foreachBatch(step)


def source_log(messages: DataFrame) -> DataFrame:
    """doc_id, text: what places in notes of a stream index: messages that aren't blank, in turn order, parted by blank lines."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    rows = messages.select(F.col("conv_id").alias("doc_id"), "turn", text.alias("text")).where(F.trim("text") != "")
    lines = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("text"))


__all__ = ["Live", "live", "live_recall", "replay", "snapshot", "source_log"]
