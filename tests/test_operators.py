"""Operators of the core on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.functions import vectorized as V
from papyrine.operators import retrieval as R
from papyrine.operators import structure as D
from papyrine.plans.runtime import spread_join
from papyrine.sources import files
from papyrine.streaming import events as E


def test_terms_keep_inner_marks_and_pair_han(spark):
    row = spark.createDataFrame([("Llama-3.1-8B gains 92.5% 对齐模块",), (None,), ("",)], "t string").select(X.retrieval_terms(F.col("t")).alias("x")).collect()
    assert row[0].x == ["llama-3.1-8b", "gains", "92.5", "对", "齐", "模", "块", "对齐", "齐模", "模块"]
    assert row[1].x is None and row[2].x == []
    assert X.query_terms("Llama-3.1-8B 对齐") == ["llama-3.1-8b", "对", "齐", "对齐"]


def test_bm25_statistics_are_those_of_the_scope(spark):
    rows = [("a", "red fox"), ("b", "red red dog"), ("c", "blue cat")]
    scope = R.bm25(spark.createDataFrame(rows, "id string, text string"), "red", None).orderBy("id").collect()
    other = R.bm25(spark.createDataFrame([*rows, ("z", "red red")], "id string, text string").where("id <> 'z'"), "red", None).orderBy("id").collect()
    assert scope == other and [r.id for r in scope] == ["a", "b"]


def test_fusion_is_bounded_and_ties_break_by_id(spark):
    one = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "id string, score double")
    fused = {r.id: r.score for r in R.rrf([one, one, one]).collect()}
    assert fused["a"] > fused["b"] and max(fused.values()) <= 3 / 61 + 1e-9


def test_hybrid_on_nothing(spark):
    assert R.hybrid(spark.createDataFrame([], "id string, text string"), "red fox").count() == 0


def test_packing_resets_and_keeps_oversized_blocks(spark):
    df = spark.createDataFrame([(1, ["a" * 400, "b" * 301, "c" * 900, "d"]), (2, [""])], "k int, b array<string>")
    got = [(r.k, r.chunk_no, r.n_blocks, r.n_chars) for r in D.pack_blocks(df, "k", "b", 700).orderBy("k", "chunk_no").collect()]
    assert got == [(1, 0, 1, 400), (1, 1, 1, 301), (1, 2, 1, 900), (1, 3, 1, 1), (2, 0, 1, 0)]


def test_section_tree_and_closure(spark):
    df = spark.createDataFrame([("f", ["1 A", "1.1 B"]), ("f", ["1 A"]), ("g", None), (None, ["1 A"])], "file_id string, section_path array<string>")
    assert {(r.path, r.parent) for r in D.section_tree(df).collect()} == {("1 A", None), ("1 A / 1.1 B", "1 A")}
    assert {(r.root, r.descendants) for r in D.section_closure(df).collect()} == {("1 A", 1), ("1 A / 1.1 B", 0)}


def test_spread_join_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr("papyrine.plans.runtime.HOT_ROWS", 5)
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, v int")
    lookup = spark.createDataFrame([("hot", "x"), ("cold", "y")], "k string, w string")
    assert spread_join(facts, lookup, "k").count() == 51
    assert spread_join(facts, lookup, "k", "left").count() == 52


def test_percentile_and_seeded_bootstrap():
    assert V.percentile([100, 300], 0.5) == 200 and V.percentile([100, 300], 0.95) == 290
    assert V.bootstrap([0, 1, 1, 0], 17, 200) == V.bootstrap([0, 1, 1, 0], 17, 200)
    lo, hi = V.bootstrap([0, 1, 1, 0], 17, 500)
    assert lo <= 0.5 <= hi


def test_bootstrap_by_group(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, None)], "g string, o int, v double")
    rows = V.bootstrap_by(df, "g", "o", "v", resamples=50).collect()
    assert [r.g for r in rows] == ["a"]


def test_vectorized_text(spark):
    df = spark.createDataFrame([("Ｒesults Straße", "results strasse"), (None, "x")], "a string, b string")
    got = V.with_hash_embedding(df, "a", "h").select(V.nfkc_casefold("a").alias("n"), V.title_similarity("a", "b").alias("s"), "h").collect()
    assert got[0].n == "results strasse" and 0 < got[0].s < 1 and abs(sum(v * v for v in got[0].h) - 1) < 1e-9
    assert got[1].n is None and got[1].s is None and got[1].h is None


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": "x"\n')
    loose = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int", strict=False).collect()
    assert [(r.id, r._corrupt_record is None) for r in loose] == [(1, True), (None, False)]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect()
    extra = files.unknown_keys(spark.createDataFrame([('{"id": 1, "zz": 2}',), ('{"id": 1}',)], "j string"), "j", ["id"])
    assert [r.extra for r in extra.collect()] == [["zz"]]


def test_checked_lines_name_the_first_fault(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    assert sorted(map(tuple, files.read_checked(spark, str(good), "id string, n int", "id").collect())) == [("a", 1), ("b", None)]
    for text, fault in (('{"id": "a"}\n\n{"id": \n', "line 3: no record"), ('{"id": "a"}\n{"id": "a"}\n', "line 2: a key"), ('{"n": 1}', "line 1: no record"), ("\n", "holds no record")):
        (tmp_path / "bad.jsonl").write_text(text)
        with pytest.raises(ValueError, match=fault):
            files.read_checked(spark, str(tmp_path / "bad.jsonl"), "id string, n int", "id")


def test_reports_and_audits(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    for _ in range(2):
        files.write_report(df, str(tmp_path / "r"), "Scores")
    assert (tmp_path / "r" / "report.md").read_text().startswith("# Scores") and "1.5" in (tmp_path / "r" / "report.json").read_text() and not (tmp_path / "r.part").exists()
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "r"), "Scores", 1)
    files.append_audit(df.withColumn("secret", F.lit("x")), str(tmp_path / "audit"), ["value"], "name")
    files.append_audit(df, str(tmp_path / "audit"), ["value"], "name")
    got = spark.read.json(str(tmp_path / "audit"))
    assert got.count() == 4 and set(got.columns) == {"name", "value"}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=i), i % 3, "click" if i % 2 else "view", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = E.read(spark, str(tmp_path / "events"), 10)
    got = E.once(E.windowed(stream), "w", "complete", str(tmp_path / "c1"))
    assert got.agg(F.sum("n")).first()[0] == 60 and got.count() == 6
    numbered = E.once(E.numbered(E.read(spark, str(tmp_path / "events"), 10)), "n", "append", str(tmp_path / "c2"))
    assert numbered.count() == 60 and {(r.user_id, r.top) for r in numbered.groupBy("user_id").agg(F.max("n").alias("top")).collect()} == {(0, 20), (1, 20), (2, 20)}
    assert E.until_terminal(df, "click").count() == 5
