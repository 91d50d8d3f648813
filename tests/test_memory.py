"""Whole memories: built, asked, shown, merged, streamed."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.config import BuildOptions, InjectOptions, RecallOptions, StreamOptions
from quillgraph.functions import hashing, text
from quillgraph.functions import lexicon as lex
from quillgraph.operators import context, dedupe, evaluate, links, segment, topics
from quillgraph.plans import memory
from quillgraph.sources import codec, corpora
from quillgraph.streaming import live

TALK = """Alice: We decided to use Redis for the session cache. She will deploy it on 8 May 2023.

Bob: I'm not happy about connection pool timeouts. The connection pool was exhausted yesterday.

Carol said Mr. Smith was thrilled. They founded the TokenRotation module in 2021.

Alice: We decided against Redis for the session cache. Bob will deploy Memcached."""
SMALL = BuildOptions(chunk_size=120, chunk_overlap=0)


@pytest.fixture(scope="module")
def built(spark):
    rows = [(1, TALK, None, "A|title"), (2, "too short", None, None), (3, "", None, None), (4, None, None, None), (5, "One passage that is long enough to make a note of.", "2020-01", None)]
    return memory.build(spark.createDataFrame(rows, "doc_id long, text string, date string, title string"), SMALL)


def rows(df, *order):
    return df.orderBy(*order).collect()


def test_notes(built):
    got = rows(built.notes, "doc_id", "seq")
    assert [(r.doc_id, r.id) for r in got] == [(1, "001"), (1, "002"), (1, "003"), (1, "004"), (2, "001"), (5, "001")]
    one = got[:4]
    assert {min(r.weight for r in one), max(r.weight for r in one)} == {0.0, 1.0}
    assert all(TALK[r.source_start : r.source_end].strip() == TALK[r.source_start : r.source_end] for r in one)
    assert one[0].entities == ["Alice", "Redis"]
    assert [r.resolved_date for r in one] == ["2023-05-08", "2023-05-07", "2021", None]
    assert got[-1].resolved_date == "2020-01"


def test_meta(built):
    got = {r.doc_id: r for r in built.meta.collect()}
    assert {d: r.chunk_count for d, r in got.items()} == {1: 4, 2: 1, 3: 0, 4: 0, 5: 1}
    assert got[2].warnings and not got[1].warnings and not got[3].warnings
    assert got[1].source == TALK


def test_links_have_at_most_three_at_a_note(built):
    got = built.links.collect()
    assert {(r.from_id, r.to_id) for r in got} == {("001", "004")}
    assert got[0].label == "ALC+RDS"


def test_conflicts(built):
    got = rows(built.conflicts, "later", "earlier")
    assert [(r.earlier, r.later, r.signal) for r in got] == [("001", "004", "negation-flip")]
    assert got[0].summary.startswith('[Alice] "Alice: We decided to use Redis')


def test_text_and_back(built):
    e = built.encode()
    lines = e.where("doc_id = 1").first().text.split("\n")
    assert lines[0] == "FILE:004|ALC+RDS+BBB||A\\|title|v2"
    assert lines[1].startswith("E:ALC=Alice;BBB=Bob;")
    assert lines[-1] == "T:001<->004|ALC+RDS"
    back = memory.decode(e)
    for c in ("id", "quote", "entities", "topics", "flags", "emotions", "source_start", "source_end"):
        assert [r[c] for r in rows(back.notes, "doc_id", "seq")] == [r[c] for r in rows(built.notes, "doc_id", "seq")]
    assert back.meta.where("warnings IS NOT NULL").count() == 0
    assert back.meta.where("doc_id = 1").first().title == "A|title"


def test_recall(spark, built):
    asked = [(1, 1, "When did Bob see the pool timeouts?"), (2, 1, "the of and"), (3, 1, "zzzz"), (4, 2, "short"), (5, 3, "short"), (6, 1, "what about May 2023 and Redis redis")]
    q = spark.createDataFrame(asked, "query_id int, doc_id long, text string")
    got = rows(built.recall(q), "query_id", "rank")
    best = {r.query_id: r.id for r in got if r["rank"] == 1}
    assert best == {1: "002", 4: "001", 6: "001"}
    plain = rows(built.recall(q, RecallOptions(hops=False)), "query_id", "rank")
    assert {r.query_id for r in plain} == {1, 4, 6}
    assert [r.id for r in rows(built.recall(q.where("query_id = 6"), RecallOptions(after="2022", hops=False)), "rank")] == ["001", "002"]
    assert built.recall(q, RecallOptions(top_k=0)).collect() == []


def test_links_carry_answers(spark, built):
    q = spark.createDataFrame([(1, 1, "Memcached")], "query_id int, doc_id long, text string")
    assert [r.id for r in rows(built.recall(q), "rank")] == ["004", "001"]
    assert [r.id for r in rows(built.recall(q, RecallOptions(hops=False)), "rank")] == ["004"]


def test_passages(spark, built):
    q = spark.createDataFrame([(1, 1, "pool timeouts Smith"), (2, 1, "qqq")], "query_id int, doc_id long, text string")
    got = built.recall_context(q).collect()
    assert [r.query_id for r in got] == [1]
    assert TALK[89:].startswith(got[0].text[:40])
    small = built.recall_context(q, max_tokens=10).collect()[0].text
    assert small in TALK
    hits = built.recall(q)
    quotes = context.recall_context(hits, built.notes).collect()[0].text
    assert quotes.count("\n") >= 1


def test_wake_up(built):
    got = {r.doc_id: r.text for r in built.wake_up().collect()}
    assert set(got) == {1, 2, 5}
    assert "Origin: Carol said" in got[1]
    assert ".." not in got[1]


@pytest.mark.parametrize("format", ["text", "json", "markdown"])
def test_budgets_are_kept(built, format):
    for budget in (10, 60, 90, 150):
        options = InjectOptions(format=format, max_tokens=budget)
        for r in built.inject(options).collect():
            empty = codec.count_tokens(codec.Plain([], [], {}, None, "A|title" if r.doc_id == 1 else None).render([], format))
            assert codec.count_tokens(r.text) <= max(budget, empty)


def test_prompts(built):
    shown = {r.doc_id: r.text for r in built.inject(InjectOptions(format="markdown", max_notes=1)).collect()}
    assert shown[1].startswith("**[004]** *(DECISION, TECHNICAL)* ")
    full = json.loads(built.inject(InjectOptions(format="json")).where("doc_id = 1").first().text)
    assert [n["id"] for n in full["zettels"]] == ["001", "002", "003", "004"]
    assert full["tunnels"] == [{"from": "001", "to": "004", "label": "ALC+RDS"}]
    held = built.inject(InjectOptions(format="markdown", max_notes=1, guarantee_flags=("ORIGIN",))).where("doc_id = 1").first().text
    assert "[003]" in held
    assert built.inject(InjectOptions(max_notes=2)).where("doc_id = 1").first().text.split("\n")[2].startswith("004:")
    counted = built.inject(InjectOptions(format="markdown", max_tokens=200, count_tokens=len)).where("doc_id = 1").first().text
    assert len(counted) <= 200


def test_empty_selections(built):
    whole = {1, 2, 3, 4, 5}
    for options in (InjectOptions(min_weight=2.0), InjectOptions(flags=("GENESIS",)), InjectOptions(min_weight=2.0, max_tokens=100), InjectOptions(min_weight=2.0, max_notes=2, selection="mmr")):
        got = {r.doc_id: r.text for r in built.inject(options).collect()}
        assert got == dict.fromkeys(whole, "FILE:000||||v2") | {1: "FILE:000|||A\\|title|v2", 5: "FILE:000||2020-01||v2"}
    for max_tokens in (None, 50):
        assert {r.doc_id: r.text for r in built.inject(InjectOptions(min_weight=2.0, format="markdown", max_tokens=max_tokens)).collect()} == dict.fromkeys(whole, "")
        shown = {r.doc_id: r.text for r in built.inject(InjectOptions(min_weight=2.0, format="json", max_tokens=max_tokens)).collect()}
        assert shown == dict.fromkeys(whole, '{\n  "zettels": [],\n  "tunnels": []\n}')
    assert {r.doc_id for r in built.encode().collect()} == whole


# ---- prompts against brute force


def memories(draw):
    """Notes, scored links and codes of a few memories, with ties in weights and links."""
    flags = ["DECISION", "ORIGIN", "CORE", "PIVOT", "TECHNICAL"]
    notes, ties, codes = [], [], []
    for d in range(6):
        n = draw.randint(1, 14)
        names = [f"Name{x}" for x in "ABCDE"]
        codes += [(d, x, f"N{i}X") for i, x in enumerate(names)]
        for i in range(1, n + 1):
            words = [" ".join(draw.choices(["alpha", "beta", "gamma"], k=draw.randint(1, 2))) for _ in range(draw.randint(0, 3))]
            notes.append((d, i, f"{i:03d}", sorted(draw.sample(names, draw.randint(0, 2))), words, "said " * draw.randint(1, 30) + '"x"', draw.choice([0.0, 0.25, 0.5, 0.5, 1.0]), draw.sample(["joy", "fear"], draw.randint(0, 2)), draw.sample(flags, draw.randint(0, 2)), i * 10, i * 10 + 9, draw.choice([None, "2020-05"])))
        for _ in range(draw.randint(0, 12)):
            a, b = sorted((draw.randint(1, n), draw.randint(1, n)))
            if a != b and (d, f"{a:03d}", f"{b:03d}") not in {t[:3] for t in ties}:
                ties.append((d, f"{a:03d}", f"{b:03d}", f"l{a}_{b}", draw.choice([0.3, 0.5, 0.5, 0.9])))
    return notes, ties, codes


FIELDS = ("doc_id", "seq", "id", "entities", "topics", "quote", "weight", "emotions", "flags", "source_start", "source_end", "resolved_date")


def shown_plainly(notes, ties, codes, format):
    """A prompt by the rules, with nothing of the library."""
    ids = [z["id"] for z in notes]
    ties = sorted((t for t in ties if t[1] in ids and t[2] in ids), key=lambda t: (t[1], -t[4], t[2]))
    if format == "markdown":
        out = []
        for z in notes:
            head = " · ".join(x for x in (z["resolved_date"], ", ".join(z["flags"])) if x)
            out.append(f"**[{z['id']}]** " + (f"*({head})* " if head else "") + z["quote"])
        return "\n\n".join(out)
    if format == "json":
        keys = dict(zip(FIELDS[2:], ("id", "entities", "topics", "quote", "weight", "emotions", "flags", "sourceStart", "sourceEnd", "resolvedDate"), strict=True))
        rows = [{k: int(z[c]) if c == "weight" and z[c] in (0, 1) else z[c] for c, k in keys.items() if z[c] is not None} for z in notes]
        return json.dumps({"zettels": rows, "tunnels": [{"from": t[1], "to": t[2], "label": t[3]} for t in ties]}, indent=2)
    book = {n: c for _, n, c in codes}
    seen = []
    for z in notes:
        seen += [n for n in z["entities"] if n not in seen]
    lines = [f"FILE:{len(notes):03d}|{'+'.join(book[n] for n in seen[:3])}|||v2"]
    if seen:
        lines.append("E:" + ";".join(f"{book[n]}={n}" for n in sorted(seen, key=book.get)))
    for z in notes:
        quote = z["quote"].replace('"', '\\"')
        lines.append(f"{z['id']}:{'+'.join(book[n] for n in z['entities'])}|{','.join(t.replace(' ', chr(92) + '_') for t in z['topics'])}|\"{quote}\"|{z['weight']:.2f}|{'+'.join(z['emotions'])}|{'+'.join(z['flags'])}|{z['source_start']}-{z['source_end']}")
    return "\n".join([*lines, *(f"T:{t[1]}<->{t[2]}|{t[3]}" for t in ties)])


def chosen_plainly(notes, ties, codes, options):
    def score(z):
        return 0.7 * z["weight"] + (0.3 if {"DECISION", "ORIGIN", "CORE"} & set(z["flags"]) else 0)

    def like(x, y):
        a, b = ({*z["topics"], *z["entities"]} for z in (x, y))
        return len(a & b) / len(a | b) if a and b else 0

    out = [z for z in notes if options.min_weight is None or z["weight"] >= options.min_weight]
    if options.max_notes is not None:
        pool, out = sorted(out, key=lambda z: (-score(z), z["id"])), []
        if options.selection != "mmr" or len(pool) <= options.max_notes:
            out, pool = pool[: options.max_notes], []
        while pool and len(out) < options.max_notes:
            values = [0.7 * score(z) - 0.3 * max((like(z, s) for s in out), default=0) for z in pool]
            out.append(pool.pop(values.index(max(values))))
    for flag in options.guarantee_flags:
        if any(flag in z["flags"] for z in out):
            continue
        spare = sorted((z for z in notes if flag in z["flags"] and z not in out), key=lambda z: (-z["weight"], z["id"]))
        if spare:
            free = [i for i, z in enumerate(out) if not set(options.guarantee_flags) & set(z["flags"])]
            if free:
                out[min(free, key=lambda i: score(out[i]))] = spare[0]
            else:
                out.append(spare[0])
    if options.max_tokens is not None:
        def size(some):
            text = shown_plainly(some, ties, codes, options.format)
            return -(-max(len(text.split()) * 13 * 100, len(text) * 250) // 1000)

        fit = []
        for z in sorted(out, key=lambda z: (-score(z), z["id"])):
            if size([*fit, z]) <= options.max_tokens:
                fit.append(z)
        out = fit
    return out


@pytest.mark.parametrize("format", ["text", "json", "markdown"])
def test_prompts_are_those_of_the_rules(spark, format):
    draw = random.Random(40)
    notes, ties, codes = memories(draw)
    n = spark.createDataFrame(notes, "doc_id long, seq int, id string, entities array<string>, topics array<string>, quote string, weight double, emotions array<string>, flags array<string>, source_start int, source_end int, resolved_date string")
    c = spark.createDataFrame(codes, "doc_id long, name string, code string")
    cases = [
        InjectOptions(format=format), InjectOptions(format=format, max_notes=3), InjectOptions(format=format, min_weight=0.4, max_notes=4, selection="mmr"), InjectOptions(format=format, max_tokens=120),
        InjectOptions(format=format, max_notes=2, guarantee_flags=("ORIGIN", "PIVOT")), InjectOptions(format=format, max_tokens=300, guarantee_flags=("CORE",), max_notes=6, selection="mmr"),
    ]
    for options in cases:
        want = {}
        for d in range(6):
            own = [dict(zip(FIELDS, z, strict=True)) for z in notes if z[0] == d]
            tied, book = [t for t in ties if t[0] == d], [x for x in codes if x[0] == d]
            want[d] = shown_plainly(chosen_plainly(own, tied, book, options), tied, book, format)
        for parts, order in ((1, ties), (5, ties[::-1])):  # links in any order and place
            t = spark.createDataFrame(order, "doc_id long, from_id string, to_id string, label string, score double").repartition(parts, "label")
            assert {r.doc_id: r.text for r in context.inject(n, t, c, options=options).collect()} == want


def test_relevance_against_repetition():
    notes = [{"seq": i, "in_": True, "id": f"{i:03d}", "weight": w, "flags": [], "topics": t, "entities": []} for i, (w, t) in enumerate([(1.0, ["a"]), (0.9, ["a"]), (0.8, ["b"])])]
    plain = codec.Plain(notes, [], {})
    assert [z["seq"] for z in context.choose(plain, InjectOptions(max_notes=2))] == [0, 1]
    assert [z["seq"] for z in context.choose(plain, InjectOptions(max_notes=2, selection="mmr"))] == [0, 2]


def test_merge(spark, built):
    groups = spark.createDataFrame([(1, 9, 1), (5, 9, 0)], "doc_id long, group_id long, position int")
    m = memory.merge(built, groups)
    got = rows(m.notes, "seq")
    assert [r.id for r in got] == ["001", "002", "003", "004", "005"]
    assert got[0].quote.startswith("One passage")
    assert got[0].source_start is None
    assert m.meta.first().input_length == len(TALK) + 50


def test_dedupe(spark):
    copy = "The quick brown fox jumps over the lazy dog near the river bank today."
    other = "A wholly different paragraph speaks of mountains and of distant storms."
    df = spark.createDataFrame([(1, "\n\n".join([copy, other, copy, copy]))], "doc_id long, text string")
    whole = memory.build(df, BuildOptions(chunk_size=90, chunk_overlap=0))
    assert whole.notes.count() == 4
    once = memory.build(df, BuildOptions(chunk_size=90, chunk_overlap=0, dedupe=True))
    assert [r.id for r in rows(once.notes, "seq")] == ["001", "002"]


# ---- expressions agree with plain functions


def test_chunks_and_topics_are_those_of_notes(spark):
    draw = random.Random(2)
    words = "cache pool GraphStore rate-limit the of and limiting APIS session tokens rotation schedule review maria Anna:".split()
    texts = ["\n\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(0, 12))) for _ in range(30)]
    texts += ["", " \n\n ", "\n\n\nabc\n\n", "x\r\n\r\ny", "é\u00a0\n\n\u2003z", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((60, 0), (200, 500)):
        notes = rows(segment.annotate_notes(df, BuildOptions(chunk_size=size, chunk_overlap=overlap).notes), "doc_id", "seq")
        cut = segment.chunks(df, size, overlap)
        assert [(r.doc_id, r.idx + 1, r.char_start, r.char_end, r.text) for r in rows(cut, "doc_id", "idx")] == [(r.doc_id, r.seq, r.source_start, r.source_end, r.body) for r in notes]
        who = segment.speaker_names(df.where("text IS NOT NULL")).groupBy("doc_id").agg(F.collect_list("name").alias("speakers"))
        told = topics.top_topics(cut.join(who, "doc_id", "left"))
        got = {}
        for r in rows(told, "doc_id", "idx", "rank"):
            got.setdefault((r.doc_id, r.idx + 1), []).append(r.topic)
        assert got == {(r.doc_id, r.seq): r.topics for r in notes if r.topics}


def test_codes_agree(spark):
    draw = random.Random(3)
    names = ["".join(draw.choice("ABCDEIOU"[i == 0 :]) if i == 0 else draw.choice("abcdeiou") for i in range(draw.randint(2, 6))) for _ in range(60)]
    df = spark.createDataFrame([(d, names[d * 15 : d * 15 + 15]) for d in range(4)], "doc_id long, entities array<string>")
    got = {(r.doc_id, r.name): r.code for r in segment.entity_codes(df).collect()}
    for d in range(4):
        memo = live.Live()
        memo.name(set(names[d * 15 : d * 15 + 15]))
        assert {n: c for (k, n), c in got.items() if k == d} == memo.codes


def test_links_agree_with_brute_force(spark):
    draw = random.Random(5)
    data = [(d, s + 1, f"{s + 1:03d}", sorted(draw.sample("ABCDEF", draw.randint(0, 3))), draw.sample(["t one", "two t", "three", "four", "five six"], draw.randint(0, 3))) for d in range(6) for s in range(25)]
    notes = spark.createDataFrame(data, "doc_id long, seq int, id string, entities array<string>, topics array<string>")
    got = {(r.doc_id, r.a, r.b) for r in links.cap_degree(links.link_candidates(notes, 0.3), 3).collect()}
    want = set()
    for d in range(6):
        own = [r for r in data if r[0] == d]
        pairs = []
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                a, b = set(x[3]), set(y[3])
                v, w = ({p for t in r[4] for p in t.split() if len(p) > 1} for r in (x, y))
                score = max(len(a & b) / len(a | b) * 1.2 if a & b else 0, len(v & w) / len(v | w) if v & w else 0)
                if score >= 0.3:
                    pairs.append((-score, x[1], y[1]))
        used = {}
        for _, a, b in sorted(pairs):
            if used.get(a, 0) < 3 and used.get(b, 0) < 3:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                want.add((d, a, b))
    assert got == want


def test_long_documents_miss_no_pair(spark):
    draw = random.Random(8)
    names, words = [f"N{i}" for i in range(300)], [f"w{i}" for i in range(400)]
    # the first 80 are the same note, so buckets of bands overflow
    data = [(1, s, sorted(draw.sample(names, draw.randint(0, 3))), draw.sample(words, draw.randint(0, 6)), f"q{s}") for s in range(81, 561)]
    data += [(1, s, ["N1", "N2"], ["w1", "w2", "w3"], "the same") for s in range(1, 81)]
    notes = spark.createDataFrame(data, "doc_id long, seq int, entities array<string>, topics array<string>, quote string")
    linked, same = set(), set()
    for i, x in enumerate(data):
        for y in data[i + 1 :]:
            e, w = (len({*x[k]} & {*y[k]}) / max(len({*x[k]} | {*y[k]}), 1) for k in (2, 3))
            pair = tuple(sorted((x[1], y[1])))
            if max(e * 1.2, w) >= 0.3:
                linked.add(pair)
            if x[2:] == y[2:]:
                same.add(pair)
    assert {(r.a, r.b) for r in links.link_candidates(notes, 0.3).collect()} == linked
    assert {(r.a, r.b) for r in dedupe.similar_notes(notes, 0.95).collect()} == same
    assert {(r.a, r.b) for r in links.link_candidates(notes, 0.3, full=500).collect()} < linked


def test_the_size_switch_reaches_builds(spark):
    text_ = "\n\n".join(f"We met Maria{i % 40} about the shared budget review number{i % 30} of thing{i}." for i in range(60))
    df = spark.createDataFrame([(1, text_)], "doc_id long, text string")
    whole, banded = (memory.build(df, BuildOptions(chunk_size=60, chunk_overlap=0, full=full)) for full in (None, 10))
    assert banded.links.count() <= whole.links.count()
    pairs = links.link_candidates(banded.notes, full=10)
    ends = {(f"{r.a:03d}", f"{r.b:03d}") for r in pairs.collect()}
    assert {(r.from_id, r.to_id) for r in banded.links.collect()} <= ends
    assert pairs.count() < links.link_candidates(whole.notes).count()
    for m in (whole, banded):
        m.close()


def test_closed_memories_hold_nothing(spark):
    df = spark.createDataFrame([(1, TALK)], "doc_id long, text string")
    with memory.build(df, SMALL) as m:
        m.notes.count()
        assert all(x.storageLevel.useMemory for x in m.held)
    assert not any(x.storageLevel.useMemory or x.storageLevel.useDisk for x in m.held)


def test_bands_find_equal_sets(spark):
    df = spark.createDataFrame([(1, i, [f"t{i // 2 * 10 + k}" for k in range(8)]) for i in range(20)], "doc_id long, seq int, tokens array<string>")
    got = {(r.a, r.b) for r in links.band_pairs(df).collect()}
    assert {(i, i + 1) for i in range(0, 20, 2)} <= got
    sig = links.signatures(df).first().sig
    assert len(sig) == 32 and all(0 <= x < 2**32 for x in sig)
    for words in (["a", "bc", "é😀"], ["x"]):
        h = []
        for w in words:
            x = 2166136261
            for unit in (int.from_bytes(w.encode("utf-16-le")[i : i + 2], "little") for i in range(0, len(w.encode("utf-16-le")), 2)):
                x = (x ^ unit) * 16777619 % 2**32
            h.append(x)
        assert hashing.signature(words) == [min((a * x + b) % 2**32 for x in h) for a, b in hashing.CONSTANTS]
    assert hashing.signature([]) == [2**32 - 1] * 32


def test_folding(spark):
    words = {"rotation": "rotat", "rotate": "rotat", "rotating": "rotat", "capping": "cap", "cities": "city", "wedding": "wed", "boxes": "box", "glass": "glas", "bus": "bus", "quickly": "quick", "ies": "ies"}
    assert {w: text.folded(w) for w in words} == words
    more = [a + b for a in "a pass run stress box bush quiz study bottle hop press".split() for b in "s es ies ing ed tion sions ly ely e ess y er".split()] + [w for group in lex.SYNONYMS for w in group]
    df = spark.createDataFrame([*words.items(), *((w, text.folded(w)) for w in more)], "w string, f string")
    assert df.where(text.fold("w") != F.col("f")).collect() == []


def test_measures(spark):
    df = spark.createDataFrame([(1, "The red red car", "a red car"), (2, "", ""), (3, "x", ""), (4, "cat", "dog")], "pair_id int, said string, gold string")
    got = {r.pair_id: (round(r.f1, 3), r.held) for r in evaluate.token_f1(df).collect()}
    assert got == {1: (0.8, True), 2: (1.0, True), 3: (0.0, True), 4: (0.0, False)}


def test_session_corpus(spark):
    df = spark.createDataFrame([("s", 1, "1 May 2023", 0, "Ann", "hi", None), ("s", 1, "1 May 2023", 1, "Bo", None, "a dog")], "sample_id string, session int, session_date string, pos int, speaker string, text string, caption string")
    assert corpora.from_sessions(df).first().text == "(1 May 2023) Ann: hi\n\n(1 May 2023) Bo: [shares a photo: a dog]"


# ---- text form

WORD = st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc", "Zl", "Zp")) | st.sampled_from('\\|"=;,\n_ '), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(WORD.filter(lambda s: s.strip() == s and "\\" not in s), max_size=2), st.text('ab"\\\n|é ', max_size=20)), min_size=1, max_size=5))
def test_text_form_is_exact(data):
    notes, codes = [], {}
    for i, (names, quote) in enumerate(data):
        names = sorted(set(names))
        for n in names:
            codes.setdefault(n, f"C{len(codes)}")
        notes.append({"id": f"{i + 1:03d}", "entities": names, "topics": ["plain", "two words", "a,b|c"], "quote": quote, "weight": 0.25, "emotions": ["joy"], "flags": ["CORE"], "source_start": 1, "source_end": 9})
    plain = codec.Plain(notes, [{"from_id": "001", "to_id": "002", "label": "x|y"}], codes)
    back = codec.Reader(strict=True).read(plain.render(notes)) if len(notes) > 1 else codec.Reader().read(plain.render(notes))
    assert back.notes == notes
    assert {n: c for n, c in back.codes.items()} == codes


def test_faulty_text(spark):
    faulty = 'FILE:009|||t|v2\nE:ABC=Abe\n001:ABC+XYZ|a|"q"|0.50|joy+odd|CORE+NONE\nnot a line\nT:001-002\n002:|b|"q"|nan||'
    got = codec.Reader().read(faulty)
    assert len(got.warnings) == 7
    assert got.notes[0]["entities"] == ["Abe", "XYZ"]
    assert (got.notes[0]["emotions"], got.notes[0]["flags"]) == (["joy"], ["CORE"])
    with pytest.raises(ValueError, match="missing from index"):
        codec.Reader(strict=True).read(faulty)
    old = codec.Reader().read('FILE:001|ABC|d|t\n001:ABC|one_two|"say "hi" now"|0.7|joy|CORE')
    assert old.notes[0]["topics"] == ["one", "two"]
    assert old.notes[0]["quote"] == 'say "hi" now'
    assert old.codes == {"ABC": "ABC"}
    with pytest.raises(Exception, match="missing from index"):
        memory.decode(spark.createDataFrame([(1, faulty)], "doc_id long, text string"), strict=True).notes.collect()


# ---- streams

PUSHES = ["Maria joined the team and we decided on Rust.", "She likes it.", "", "Maria joined the team and we decided on Rust.", "Peter asked about the schedule of the release."]


def test_live_state():
    memo = live.Live()
    options = StreamOptions(BuildOptions(dedupe=True), half_life_turns=2, max_notes=2)
    for p in PUSHES:
        memo.push(p, options)
    assert memo.turn == 5
    assert memo.pushed == sum(map(len, PUSHES))
    assert [n["id"] for n in memo.notes] == ["001", "003"]
    assert memo.notes[0]["turn"] == 4
    assert live.Live.load(memo.dump()) == memo
    assert memo.codes["Maria"] == "MRA"


def test_replay_equals_stream(spark, tmp_path):
    table = spark.createDataFrame([(c, t, f"{p} {c}") for c in range(3) for t, p in enumerate(PUSHES)], "conv_id long, turn long, text string")
    options = StreamOptions(BuildOptions(dedupe=True, dedupe_threshold=0.8), half_life_turns=10)
    want = {r.conv_id: r for r in live.replay(table, options).collect()}
    folder = str(tmp_path / "in")
    for part in (table.where("turn < 2"), table.where("turn >= 2")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = live.live(stream, options).writeStream.outputMode("update").format("memory").queryName("lived").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.conv_id: r for r in spark.table("lived").orderBy("turn").collect()}
    assert {c: (r.turn, r.pushed, r.notes) for c, r in last.items()} == {c: (r.turn, r.pushed, r.notes) for c, r in want.items()}
    m = live.snapshot(live.replay(table, options), options)
    assert m.notes.count() == sum(len(r.notes) for r in want.values())
    log = {r.doc_id: r.text for r in live.source_log(table).collect()}
    first = want[0].notes[-1]
    assert log[0][first.source_start : first.source_end].endswith("release. 0")


def test_snapshots_recall_words_outside_quotes(spark):
    said = "We decided on Rust for the parser. The parser team wrote the parser tests in Rust, and the tests of the parser run in the build. A zebra stood by the fence. "
    said += "Maria agreed with the decision on Rust, the parser and the build. The build runs the tests of the parser each night, and the release of the parser follows the tests."
    table = spark.createDataFrame([(1, 0, said), (1, 1, "Peter asked about the schedule.")], "conv_id long, turn long, text string")
    states, asked = live.replay(table), spark.createDataFrame([(7, 1, "zebra fence")], "query_id long, doc_id long, text string")
    m = live.snapshot(states, log=live.source_log(table))
    assert [r.id for r in m.recall(asked).collect()] == ["001"]
    assert "zebra" in str(m.recall_context(asked).collect())
    assert live.snapshot(states, StreamOptions(BuildOptions(keep_source=False)), live.source_log(table)).sources.count() == 0
    assert live.snapshot(states).recall(asked).collect() == []


def brute_recall(notes, ties, asked, top, hops):
    """Recall by plain loops over one document: notes (id, words, date), links (a, b), asked words and dates."""
    import math

    n, mean = len(notes), sum(len(w) for _, w, _ in notes) / len(notes) or 1
    words, dates = asked
    df = {t: sum(t in w for _, w, _ in notes) for t in words}
    bm = [sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in words if t in w) for _, w, _ in notes]
    if max(bm) <= 0:
        return []
    score = []
    for (_, _, day), b in zip(notes, bm, strict=True):
        bonus = next((0.25 if day.startswith(q) or q.startswith(day) else 0.1 for q in dates if day and (day.startswith(q) or q.startswith(day) or len(q) == 7 <= len(day) and abs((int(day[:4]) - int(q[:4])) * 12 + int(day[5:7]) - int(q[5:7])) == 1)), 0) if day else 0
        score.append(b / max(bm) + bonus)
    if hops and ties:
        ids = [i for i, _, _ in notes]
        near = {i: [b for a, b in ties if a == i] + [a for a, b in ties if b == i] for i in ids}
        start = [s / sum(score) for s in score]
        rank = dict(zip(ids, start, strict=True))
        for _ in range(20):
            new = {i: 0.15 * p for i, p in zip(ids, start, strict=True)}
            for i in ids:
                for j, p in zip(ids, start, strict=True):
                    new[j] += 0.85 * rank[i] * p if not near[i] else 0
                for j in near[i]:
                    new[j] += 0.85 * rank[i] / len(near[i])
            rank = new
        score = [0.6 * s + 0.4 * rank[i] / max(rank.values()) for i, s in zip(ids, score, strict=True)]
    best = sorted(((-round(s, 9), i) for (i, _, _), s in zip(notes, score, strict=True) if s > 0))[:top]
    return [(i, -s) for s, i in best]


@pytest.mark.parametrize("hops", [True, False])
def test_recall_is_that_of_plain_loops(spark, hops):
    draw = random.Random(41)
    vocabulary = "apple brick cloud drum eagle flute grape house igloo".split()
    notes, ties, questions, want = [], [], [], {}
    for d in range(5):
        n = draw.randint(2, 12)
        own = [(f"{i:03d}", draw.choices(vocabulary, k=draw.randint(0, 6)), draw.choice([None, "2023-03-05", "2023-04", "2022", "2024-12-30"])) for i in range(1, n + 1)]
        tied = {tuple(sorted(draw.sample([x[0] for x in own], 2))) for _ in range(draw.randint(0, 8))} if d else set()
        notes += [(d, int(i), i, [], [], " ".join(w), day) for i, w, day in own]
        ties += [(d, a, b) for a, b in tied]
        for k in range(70 if d == 1 else 4):
            words = draw.choices([*vocabulary, "zzz"], k=draw.randint(1, 4))
            dates, said = draw.choice([([], ""), (["2023-03"], " in March 2023"), (["2022", "2024"], " in 2022 or 2024"), (["2025-01"], " January 2025")])
            questions.append((d * 1000 + k, d, " ".join(words) + said))
            from quillgraph.operators import search

            folded = [text_fold(w) for w in words] + [text_fold(w) for w in said.lower().split() if w not in ("in", "or")]
            assert not {a for a, _ in search.synonym_pairs()} & set(folded)
            want[d * 1000 + k] = brute_recall([(i, [text_fold(w) for w in ws], day) for i, ws, day in own], tied, (folded, dates), 4, hops)
    n = spark.createDataFrame(notes, "doc_id long, seq int, id string, entities array<string>, topics array<string>, quote string, resolved_date string")
    t = spark.createDataFrame(ties, "doc_id long, from_id string, to_id string")
    q = spark.createDataFrame(questions, "query_id long, doc_id long, text string")
    got = {k: [] for k in want}
    from quillgraph.operators import search

    for r in rows(search.recall(n, q, t, RecallOptions(top_k=4, hops=hops)), "query_id", "rank"):
        got[r.query_id].append((r.id, pytest.approx(r.score, abs=1e-8)))
    assert want == got


def text_fold(w):
    """The endings that these words have."""
    return {"apple": "appl", "eagle": "eagl", "flute": "flut", "grape": "grap", "house": "hous", "igloo": "igloo", "march": "march", "january": "january"}.get(w, w)


def test_live_recall_is_that_of_replays(spark, tmp_path):
    said = ["Maria joined the team and we decided on Rust.", "The zebra stood by the fence while Maria wrote the parser in Rust.", "Peter asked about the schedule of the release.", "The zebra left."]
    table = spark.createDataFrame([(c, t, f"{p} Part {c}.") for c in range(3) for t, p in enumerate(said)], "conv_id long, turn long, text string")
    asked = spark.createDataFrame([(c * 10, c, "zebra parser") for c in range(3)], "query_id long, doc_id long, text string")
    options = StreamOptions(half_life_turns=10)
    folder = str(tmp_path / "in")
    for part in (table.where("turn < 2"), table.where("turn >= 2")):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for context_ in (False, True):
        answers = {}

        def keep(found, batch, answers=answers):
            answers[batch] = found.collect()

        writer = live.live_recall(stream, asked, keep, options, RecallOptions(top_k=2), log=lambda: spark.read.parquet(folder), context=context_)
        writer.option("checkpointLocation", str(tmp_path / f"ck{context_}")).trigger(availableNow=True).start().awaitTermination(200)
        for batch, upto in ((0, 2), (1, 4)):
            some = table.where(f"turn < {upto}")
            m = live.snapshot(live.replay(some, options), options, live.source_log(some))
            want = m.recall_context(asked, RecallOptions(top_k=2)) if context_ else m.recall(asked, RecallOptions(top_k=2))
            assert sorted(map(tuple, answers[batch])) == sorted(map(tuple, want.collect()))
            assert answers[batch]


def test_texts_are_not_dealt_by_fact(spark):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one\n\ntwo").alias("text"))
    facts = spark.createDataFrame([(0, "zero"), (1, "first")], "fact_id int, sentence string")
    rows = evaluate.plant(texts, facts, 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {(r.doc_id % 4, r.fact_id) for r in rows.collect()} == {(0, 0), (1, 1)} and rows.count() == 20


def test_pairs_are_judged_without_a_shuffle_of_their_own(spark):
    import re

    notes = spark.createDataFrame([(1, s, ["Ann"], [f"w{s % 9}", "same"]) for s in range(100)], "doc_id long, seq int, entities array<string>, topics array<string>")
    found = links.link_candidates(notes, 0.3)
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, a#\d+, b#\d+", found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == found.select("a", "b").distinct().count() == 100 * 99 // 2
