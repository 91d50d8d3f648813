"""From notes to prompts: summaries, selections under a budget, passages of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import InjectOptions
from ..functions import lexicon as lex
from ..sources import codec
from .links import in_order, links_among
from .passes import each

SIGNAL = ("DECISION", "ORIGIN", "CORE")


def selection_score() -> Column:
    signal = F.arrays_overlap("flags", F.array(*map(F.lit, SIGNAL)))
    return 0.7 * F.col("weight") + 0.3 * F.when(signal, 1.0).otherwise(0.0)


def by_id() -> Column:
    return F.collate("id", "UNICODE")


def top_notes(notes: DataFrame, n: int) -> DataFrame:
    """The n heaviest notes of each document; equal ones in their order. Adds `rank` from 1."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "seq")
    return notes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def select_notes(notes: DataFrame, n: int) -> DataFrame:
    """The n notes of each document with the best selection score. Adds `rank` from 1."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(selection_score()), by_id())
    return notes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def wake_up(notes: DataFrame, share: float = 0.15, most: int = 5) -> DataFrame:
    """doc_id, text: a short summary of each document's heaviest and founding notes."""
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy(F.desc("weight"), "seq")
    n = F.count("*").over(whole)
    limit = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(n * F.lit(share)).cast("int")))
    rows = notes.withColumn("place", F.row_number().over(order)).withColumn("limit_", limit)
    cut = F.max(F.when(F.col("place") == F.col("limit_"), F.col("weight"))).over(whole)
    rows = rows.withColumn("cut", cut).where((F.col("weight") >= F.col("cut")) | F.arrays_overlap("flags", F.array(*map(F.lit, ("ORIGIN", "CORE", "GENESIS")))))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    titles = F.create_map(*[F.lit(x) for item in lex.FLAG_TITLES.items() for x in item])
    line = F.concat(F.coalesce(F.try_element_at(titles, F.get("flags", F.lit(0))), F.lit("")), "quote")
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), ". ")
    return rows.groupBy("doc_id").agg(F.replace(text, F.lit(".."), F.lit(".")).alias("text"))


def merge_spans(spans: DataFrame, keys: list[str], gap: int = 2) -> DataFrame:
    """keys, start, end: spans united where one starts at most `gap` characters after the others' end."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def recall_context(hits: DataFrame, notes: DataFrame, sources: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """query_id, doc_id, text: the passages that the hits came from, in the document's order, within a budget.

    hits: query_id, doc_id, seq, rank. Passages come in by rank; the first always, later ones if they fit. Without sources,
    or places in them, quotes by rank stand for passages and stop at the first that doesn't fit.
    """
    places = [c for c in ("source_start", "source_end") if c in notes.columns]
    rows = hits.select("query_id", "doc_id", "seq", "rank").join(notes.select("doc_id", "seq", "quote", *places), ["doc_id", "seq"])
    if sources is not None and len(places) == 2 and max_tokens is None:
        spans = merge_spans(rows.where("source_start IS NOT NULL AND source_end IS NOT NULL").select("query_id", "doc_id", F.col("source_start").alias("start"), F.col("source_end").alias("end")), ["query_id", "doc_id"])
        parts = spans.join(sources.select("doc_id", "text"), "doc_id").withColumn("part", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
        told = parts.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
        quotes = rows.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda x: x["quote"]), "\n").alias("quotes"))
        return quotes.join(told, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("text", "quotes").alias("text"))
    group = F.array_sort(F.collect_list(F.struct("rank", "quote", *places))).alias("hits")
    rows = rows.groupBy("query_id", "doc_id").agg(group)
    rows = rows.join(sources.select("doc_id", "text"), "doc_id", "left") if sources is not None else rows.withColumn("text", F.lit(None).cast("string"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [fit_passages(h, t, max_tokens) for h, t in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string())], ["query_id", "doc_id", "text"])

    return rows.select("query_id", "doc_id", "hits", "text").mapInArrow(run, f"query_id {kind}, doc_id long, text string")


def fit_passages(hits: list[dict], source: str | None, max_tokens: int | None) -> str:
    quotes = [h["quote"] or "" for h in hits]
    if source is None:
        kept: list[str] = []
        for q in quotes:
            if max_tokens is not None and codec.count_tokens("\n".join([*kept, q])) > max_tokens:
                break
            kept.append(q)
        return "\n".join(kept)
    spans: list[tuple[int, int]] = []
    for h in hits:
        if h.get("source_start") is None or h.get("source_end") is None:
            continue
        united: list[tuple[int, int]] = []
        for s, e in sorted([*spans, (h["source_start"], h["source_end"])]):
            if united and s <= united[-1][1] + 2:
                united[-1] = (united[-1][0], max(united[-1][1], e))
            else:
                united.append((s, e))
        if spans and max_tokens is not None and codec.count_tokens("\n\n".join(source[s:e] for s, e in united)) > max_tokens:
            continue
        spans = united
    return "\n\n".join(source[s:e] for s, e in spans) if spans else "\n".join(quotes)


# ---- prompts


def markdown_line() -> Column:
    parts = F.concat_ws(" · ", "resolved_date", F.when(F.size("flags") > 0, F.array_join("flags", ", ")))
    return F.concat(F.lit("**["), "id", F.lit("]** "), F.when(parts != "", F.concat(F.lit("*("), parts, F.lit(")* "))).otherwise(""), "quote")


def inject(notes: DataFrame, links: DataFrame, codes: DataFrame, meta: DataFrame | None = None, options: InjectOptions = InjectOptions()) -> DataFrame:
    """doc_id, text: what of each document's memory goes into a prompt.

    Filters and selection by weight are expressions; the greedy parts (relevance against repetition, guaranteed flags, the
    budget) and JSON work on one document's notes at a time. Each memory has a row: where nothing is selected, text has
    the header alone, JSON empty lists and markdown is empty.
    """
    chosen = notes
    if options.min_weight is not None:
        chosen = chosen.where(F.col("weight") >= options.min_weight)
    if options.flags:
        chosen = chosen.where(F.arrays_overlap("flags", F.array(*map(F.lit, options.flags))))
    mmr = options.selection == "mmr" and options.max_notes is not None
    if mmr or options.guarantee_flags or options.max_tokens is not None or options.format == "json":
        return _inject_greedy(notes, chosen, links, codes, meta, options)
    if options.max_notes is not None:
        chosen = select_notes(chosen, options.max_notes)
    else:
        chosen = chosen.withColumn("rank", F.col("seq"))
    heads = codec.heads_of(notes, meta)
    if options.format == "markdown":
        lines = F.array_sort(F.collect_list(F.struct("rank", markdown_line().alias("line"))))
        told = chosen.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))
        return heads.select("doc_id").join(told, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    used = chosen.select("doc_id", F.explode("entities").alias("name")).distinct()
    return codec.encode(chosen, links_among(links, chosen), codes.join(used, ["doc_id", "name"], "left_semi"), heads)


def _inject_greedy(notes: DataFrame, chosen: DataFrame, links: DataFrame, codes: DataFrame, meta: DataFrame | None, options: InjectOptions) -> DataFrame:
    fields = [c for c in ("seq", "id", "entities", "topics", "quote", "weight", "emotions", "flags", "source_start", "source_end", "resolved_date") if c in notes.columns]
    mark = chosen.select("doc_id", "seq", F.lit(True).alias("in_"))
    rows = notes.select("doc_id", *fields).join(mark, ["doc_id", "seq"], "left").withColumn("in_", F.coalesce("in_", F.lit(False)))
    group = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "in_", *[f for f in fields if f != "seq"]))).alias("notes"))
    ties = in_order(links).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "from_id", "to_id", "label"))).alias("links"))
    book = codes.groupBy("doc_id").agg(F.collect_list(F.struct("code", "name")).alias("codes"))
    group = codec.heads_of(notes, meta).join(group, "doc_id", "left").join(ties, "doc_id", "left").join(book, "doc_id", "left")

    def of(notes: list[dict] | None, links: list[dict] | None, codes: list[dict] | None, date: str | None, title: str | None) -> list[tuple]:
        memory = codec.Plain(notes or [], links or [], {c["name"]: c["code"] for c in codes or []}, date, title)
        return [(memory.render(choose(memory, options), options.format),)]

    return each(group.select("doc_id", "notes", "links", "codes", "date", "title"), ["doc_id"], of, "text string")


def score_of(note: dict) -> float:
    return 0.7 * note["weight"] + 0.3 * (not set(SIGNAL).isdisjoint(note["flags"]))


def alike(a: dict, b: dict) -> float:
    x, y = {*a["topics"], *a["entities"]}, {*b["topics"], *b["entities"]}
    return len(x & y) / len(x | y) if x and y else 0.0


def choose(memory: codec.Plain, options: InjectOptions) -> list[dict]:
    """The notes of one document to show, in order."""
    from ..functions.annotate import collation

    def ranked(rows: list[dict], key: Callable[[dict], float]) -> list[dict]:
        return sorted(rows, key=lambda z: (-key(z), collation(z["id"])))

    out = [z for z in memory.notes if z["in_"]]
    if options.max_notes is not None:
        pool = ranked(out, score_of)
        if options.selection == "mmr" and len(pool) > options.max_notes:
            out, near = [], [0.0] * len(pool)
            left = list(range(len(pool)))
            while left and len(out) < options.max_notes:
                best = max(left, key=lambda i: (0.7 * score_of(pool[i]) - 0.3 * near[i], -i))
                out.append(pool[best])
                left.remove(best)
                for i in left:
                    near[i] = max(near[i], alike(pool[i], pool[best]))
        else:
            out = pool[: options.max_notes]
    for flag in options.guarantee_flags:
        if any(flag in z["flags"] for z in out):
            continue
        ids = {z["seq"] for z in out}
        best = next(iter(ranked([z for z in memory.notes if flag in z["flags"] and z["seq"] not in ids], lambda z: z["weight"])), None)
        if best is None:
            continue
        free = [i for i, z in enumerate(out) if set(options.guarantee_flags).isdisjoint(z["flags"])]
        if free:
            out[min(free, key=lambda i: (score_of(out[i]), i))] = best
        else:
            out.append(best)
    if options.max_tokens is not None:
        count = options.count_tokens or codec.count_tokens
        fit: list[dict] = []
        used = count(memory.render(fit, options.format))
        for z in ranked(out, score_of):
            if used + count(memory.line(z, options.format)) <= options.max_tokens and (total := count(memory.render([*fit, z], options.format))) <= options.max_tokens:
                fit.append(z)
                used = total
        out = fit
    return out
