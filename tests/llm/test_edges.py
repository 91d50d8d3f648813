"""Every operator over nulls, empty and long texts, repeated rows, extra columns with clashing names, and empty tables."""

import glob

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import common, decontaminate, jaccard, language, neighbours, packing, quality, secrets, substring, toxicity, urlrules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, score double, set_key string, y int, a int, b int, words string, text_key int, part int, x string"
EXTRA = (1, 0.5, "k", 1, 2, 3, "w", 4, 5, "x")
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
        (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
        (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"),
        (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, "idiot"), (None, "a text without an id"), (None, None), (8, "das ist ein kurzer Satz über nichts"),
    ]
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else None, "s", len(t or ""), *EXTRA) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (7, 0, 1, "x"), (2, None, None, None), (None, 1, 1, None), (99, 1, 1, None)], "doc_id long, quality int, toxic int, text string")


def ids(df):
    return sorted(((r["doc_id"] is None, r["doc_id"]) for r in df.select("doc_id").collect()), key=str)


def check(out, docs):
    assert ids(out) == ids(docs)


def operators(docs, labels):
    yield "packing", packing.pack(docs).dropDuplicates(["doc_id", "piece", "sequence_id", "offset"])
    yield "secrets", secrets.scan_secrets(docs)
    yield "redact", secrets.redact_secrets(docs)
    yield "toxicity", toxicity.score_toxicity(docs, toxicity.fit_chain(docs, labels))
    yield "quality", quality.score_quality(docs, quality.fit_ranking(docs, labels))
    yield "language", language.identify(docs, language.fit_profiles(docs, F.lit(True)))
    yield "jaccard", jaccard.similar(docs)
    yield "substring", substring.remove_repeats(docs)


def test_every_row_has_a_result(docs, labels):
    for name, out in operators(docs, labels):
        if name == "packing":
            out = out.where("piece = 0")
        check(out, docs)


def test_empty_tables(docs, labels):
    for _, out in operators(docs.limit(0), labels.limit(0)):
        assert out.collect() == []
    bench = docs.limit(0).select("doc_id", "text").withColumnRenamed("doc_id", "item_id")
    assert decontaminate.matches(docs, bench).collect() == []
    check(decontaminate.drop_contaminated(docs, bench), docs)


def test_filters_keep_columns_and_rows(docs, labels):
    kept = toxicity.drop_toxic(docs, toxicity.fit_chain(docs, labels))
    assert kept.columns == docs.columns
    first = jaccard.first_of_each(docs)
    assert first.columns == docs.columns
    assert [r.doc_id for r in first.where("doc_id IN (1, 2)").collect()] == [1]
    assert first.where("doc_id IS NULL").count() == 2


def test_repeated_rows_start_at_the_same_places(docs):
    rows = substring.remove_repeats(docs).where("doc_id IN (1, 2)").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in rows] == [(21, 0), (21, 21), (21, 21)]
    twice = substring.remove_repeats(docs.where("doc_id = 2")).collect()
    assert [(r.n_words, r.n_removed) for r in twice] == [(21, 0), (21, 0)]


def test_benchmark_edges(spark, docs):
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one two", 1), (4, "one two three four five six", 1), (None, "seven eight nine ten eleven", 1)], "item_id long, text string, doc_id long")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert found == {(1, 4), (2, 4), (1, None), (2, None)}


def test_items_without_blanks(spark):
    han, thai, kana = "中国的首都是哪一个城市", "กรุงเทพเป็นเมืองหลวงของไทย", "日本で一番高い山はどれですか"
    bench = spark.createDataFrame([(1, f"{han}？"), (2, thai), (3, kana)], "item_id long, text string")
    rows = [(1, f"问题：请问{han}呢？答案是北京。"), (2, f"ถาม{thai}ตอบ"), (3, f"質問は{kana}。"), (4, "今天天气很好我们去公园"), (5, "plain words of an ordinary text")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.matches(texts, bench).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(texts, bench).collect()) == [4, 5]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "x://"), (5, "http://COM/"), (6, "http://com"), (None, "http://a.net/fr/x?y"), (7, "http://b.example.com/en/?q"), (8, "http://www.example.com/en/a#b"), (8, "http://WWW.Example.com/en/a\n/b")]
    pages = spark.createDataFrame([(p, u, "h", "r") for p, u in rows], "page_id long, url string, host string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(pages).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "com", "/", "com/", "allow"), (6, "com", "", None, "allow"),
            (None, "a.net", "/fr/x", "net/fr/", "block"), (7, "b.example.com", "/en/", "example.com/en/", "block"), (8, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
            (8, "www.example.com", "/en/a\n/b", "www.example.com/en/", "allow"),
        ],
        key=str,
    )
    assert urlrules.judge_urls(pages.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5])]
    table = spark.createDataFrame([(v, e, 1, 0.0) for v, e in rows], "vec_id long, embedding array<float>, cell int, score double")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 8, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.5), (20, 1, 8, 1.0), (20, 2, 0, 0.5), (20, 3, 1, 0.5)]
    assert neighbours.nearest(table.limit(0), F.lit(True)).collect() == []


def test_vectors_of_any_size(spark):
    """Components whose squares leave the range of doubles, and rows that repeat an id with other vectors."""
    for unit in (1e-200, 1e200, 5e-324):
        rows = [(0, [unit, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-unit, 1.0]), (20, [unit, unit]), (21, [1e-3, 1.0])]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
        for q, x in ((0, rows[0][1]), (20, rows[4][1])):
            want = sorted((-(x[0] * e[0] + x[1] * e[1]), v) for v, e in rows if v != q)[:3]
            assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(v, -s) for s, v in want]
    rows = [(0, [3.0, 1.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for parts in (1, 3):
        table = spark.createDataFrame(rows if parts == 1 else rows[::-1], "vec_id long, embedding array<double>").repartition(parts)
        got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=2).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(2, 2.0), (1, 1.0)]


def test_long_urls(spark):
    long = "a/" * 200_000
    pages = spark.createDataFrame([(1, f"http://x.net/fr/{long}?{long}"), (2, f"http://{'b.' * 5_000}com/{long}")], "page_id long, url string")
    got = {r.page_id: (len(r.path), r.rule, r.verdict) for r in urlrules.judge_urls(pages).collect()}
    assert got == {1: (len(long) + 4, "net/fr/", "block"), 2: (len(long) + 1, "com/", "allow")}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session())


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        common.stored(spark.range(3), "gone")
        kept = common.stored(spark.range(4), "stays", keep=True)
    left = [p.split("/")[-1] for p in glob.glob(f"{common.checkpoint_dir(spark).removeprefix('file:')}/*")]
    assert not any(p.startswith("gone-") for p in left)
    assert any(p.startswith("stays-") for p in left)
    assert kept.count() == 4


def test_toxicity_query_returns_every_row(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.op7_toxicity(spark, str(tmp_path))
    check(out, docs)
    assert out.columns == ["doc_id", "p_kind1", "p_kind2", "p_kind3", "p_toxic", "toxic"]
    assert out.where("p_toxic IS NULL OR toxic IS NULL").count() == 0
