"""The pipeline's stages, one by one and together."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    draw = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    item = " ".join(f"q{i}" for i in range(40))
    rows, labels = [], []
    for d in range(120):
        body = [draw.choice(words) for _ in range(60)]
        if d % 10 == 1:
            body[3:3] = ["idiot", "scum", "stupid"]
        text = " ".join(body)
        if d == 20:
            text += " " + item
        if d == 30:
            text += " password=hG7kkW92ma"
        if d in (42, 43):
            text = " ".join(["copy", *rows[40][1].split()])
        rows.append((d, text, "en", "s", len(text)))
        labels.append((d, 1, int(d % 10 == 1)))
    rows.append((200, None, None, None, None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out), {r[0]: r[1] for r in rows}


def test_stages(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(texts)
    gone = [{d for d in texts if d < 200 and d % 10 == 1}, {42, 43}, {20}, set()]
    for (_, stage), lost in zip(corpus_pipeline.STAGES, gone, strict=False):
        docs = stage(spark, docs, sf)
        want -= lost
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert set(rows) == want
    assert rows[30].text.endswith("[assign]")
    assert rows[30].n_chars == len(rows[30].text)


EXTRA = "a long, b long, n long, set_key string, y int, words array<string>, spans string, kept int, x double"


def edge_rows(texts):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as the operators name theirs."""
    long = " ".join(f"z{i % 9973}" for i in range(60_000))
    own = [(300, None), (301, ""), (302, " \n "), (303, long), (304, texts[20]), (304, texts[20]), (305, texts[1]), (305, texts[1]), (306, texts[2]), (306, texts[2]), (None, texts[2]), (None, None), (307, texts[30]), (307, texts[30])]
    return [(d, t, None, "s", len(t) if t is not None else None, d, 1, 2, "k", 1, ["w"], "s", 3, 0.5) for d, t in own]


def test_stages_on_edges(spark, folder):
    sf, texts = folder
    rows = [(d, t, "en", "s", len(t or ""), d, 1, 2, "k", 1, ["w"], "s", 3, 0.5) for d, t in texts.items()] + edge_rows(texts)
    table = spark.createDataFrame(rows, f"{SCHEMA}, {EXTRA}")
    toxic = {d for d in texts if d < 200 and d % 10 == 1}
    want = {"toxicity": toxic | {305}, "n-gram Jaccard join": {42, 43, 304, 305, 306, 307}, "benchmark decontamination": {20, 304}}

    def shape(found):
        return sorted(((r[0], r[1], *r[5:9]) for r in found), key=str)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        got = out.collect()
        assert out.limit(0).collect() == []
        if name == "secret scans":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
            assert [r.text for r in got if r.doc_id == 307] == [texts[30].replace("password=hG7kkW92ma", "[assign]")] * 2
            assert {r.n_chars for r in got if r.doc_id == 307} == {len(texts[30]) - len("password=hG7kkW92ma") + len("[assign]")}
            assert shape(r for r in got if r.doc_id not in (30, 307)) == shape(r for r in rows if r[0] not in (30, 307))
        else:
            assert shape(got) == shape(r for r in rows if r[0] not in want[name]), name
        empty = stage(spark, table.limit(0), sf)
        assert empty.collect() == [] and empty.columns == table.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r[0]) for r in rows)
    assert [r.length for r in packed if r.doc_id in (300, 301)] == [1, 1]
    assert corpus_pipeline.STAGES[-1][1](spark, table.limit(0), sf).collect() == []


def test_near_duplicates_keep_the_smallest_id_and_all_its_rows(spark, folder):
    sf, texts = folder
    rows = [(9, texts[2]), (9, texts[2]), (8, texts[2]), (8, texts[2]), (7, texts[3]), (None, texts[2])]
    table = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, table, sf).collect()
    assert sorted((str(r.doc_id) for r in got)) == ["7", "8", "8", "None"]


def brute_stages(sf, spark):
    """The first three stages worked out document by document, with the fitted chain of the first."""
    from quillgraph.llm import decontaminate, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    kept = [(d, t) for d, t in rows if chain.probabilities(toxicity.matrix([t], chain.words))[0, -1] < chain.cut]

    def shingles(t):
        w = (t or "").lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {d: shingles(t) for d, t in kept}
    up = {d: d for d in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, a in enumerate(sets):
        for b in list(sets)[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    kept = [(d, t) for d, t in kept if find(d) == d]
    least = [decontaminate.words_of(t) for t in items]

    def covered(t, item):
        # words of the item in runs of four or more that stand in the text: greedy tiles of one copy cover just these
        w = decontaminate.words_of(t)
        runs = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        held = {j + k for j in range(len(item) - 3) if tuple(item[j : j + 4]) in runs for k in range(4)}
        return len(held)

    return [(d, t) for d, t in kept if all(covered(t, item) < 0.5 * len(item) for item in least)]


def test_run_against_brute_force(spark, folder):
    sf, _ = folder
    from quillgraph.llm import packing, secrets

    scan, encode = secrets.scanner(9.0), packing.encoder()
    want = {d: [*encode(secrets.hide(t, scan(t)) if t else ""), 2] for d, t in brute_stages(sf, spark)}
    rows = corpus_pipeline.run(spark, sf).withColumn("ids", packing.ids_of()).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += r.ids
    assert got == want


def test_run(spark, folder):
    sf, texts = folder
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {d for d in texts if not (d < 200 and d % 10 == 1) and d not in (42, 43, 20)}
    assert [r.length for r in rows if r.doc_id == 200] == [1]
    full = defaultdict(int)
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024
