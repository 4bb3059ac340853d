"""The training-data operators on small tables: brute force, round trips and edge cases."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import bpe, consensus, overlap, packing, pieces, quantiles, scans, splits, topn, truncation

# 1


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and np.isfinite(s):
            best[g, i] = max(s, best.get((g, i), -np.inf))
    groups = defaultdict(list)
    for (g, i), s in best.items():
        groups[g].append((-s, i))
    return {(g, i, k + 1) for g, x in groups.items() for k, (_, i) in enumerate(sorted(x)[:n])}


@pytest.mark.parametrize("subgroups", [1, 3, 64])
def test_top_n_equals_brute_force(spark, subgroups):
    source = random.Random(1)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.25, 0.5, 0.75]
    rows = [(source.choice(["a", "b", None]), source.choice([*"pqrstuvw", None]), source.choice(values)) for _ in range(600)]
    rows += [("hot", f"i{k:04d}", float(k % 7)) for k in range(400)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "g string, i string, s double, salt int, rank int")
    got = {(r.g, r.i, r["rank"]) for r in topn.top_n_per_group(df, "g", "i", "s", 5, subgroups).collect()}
    assert got == brute_top(rows, 5)
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s", 5).count() == 0


# 2


def test_automaton_and_trie_find_every_word_within_reach():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    source = random.Random(2)
    words = sorted({"".join(source.choice("abc") for _ in range(source.randint(1, 6))) for _ in range(150)})
    trie = scans.Trie(words)
    for _ in range(150):
        w = "".join(source.choice("abcd") for _ in range(source.randint(0, 7)))
        for edits in (0, 1, 2):
            assert sorted(trie.within(w, edits)) == sorted((x, distance(w, x)) for x in words if distance(w, x) <= edits)


def test_words_within_reach_share_a_segment():
    source = random.Random(14)
    for _ in range(4000):
        word = "".join(source.choice("abcdef") for _ in range(source.randint(3, 14)))
        seen = list(word)
        for _ in range(source.randint(0, scans.EDITS)):
            at, kind = source.randrange(len(seen) + 1), source.randrange(3)
            if kind == 0:
                seen.insert(at, source.choice("abcdef"))
            elif at < len(seen):
                seen[at : at + 1] = [source.choice("abcdef")] if kind == 1 else []
        if len(seen) >= 3:
            assert set(scans.vocabulary_keys(word)) & scans.suspect_keys("".join(seen)), (word, seen)


def test_repairs_equal_brute_force(spark):
    source = random.Random(15)
    true = ["calibration", "claim", "vaccine", "method", "training", "modern", "summary", "clinic", "w" * 45 + "m"]
    seen = {w: 100 for w in true} | {"ca1ibration": 2, "clairn": 3, "dairn": 1, "rnethod": 90, "surnrnary": 4, "zzz": 1, "vvvvvv": 1, "w" * 45 + "rn": 1}
    seen |= {"".join(source.choice("acgt") for _ in range(12)): 1 for _ in range(30)}
    want = {(w, t) for w, n in seen.items() for t in true if w != t and 100 >= scans.RATIO * n and scans.Trie([t]).within(w, scans.EDITS) and (scans.misreading_cost(w, t) or 9) <= scans.EDITS}
    got = {(r.word, r.true) for r in scans.repairs(spark.createDataFrame(list(seen.items()), "word string, n bigint")).collect()}
    assert got == want and len(want) == 3


def test_a_header_in_a_third_of_all_files_and_one_in_lower_case(spark):
    rows = [(f"f{f}", f"c{f:02d}{k}", f"{'Letters on Vaccine Studies, Vol. 3' if f < 10 else 'proceedings of the society for measures'}   {k}\nword{f} word{k} goes on here{k}.", ["1 Results"], k, k) for f in range(30) for k in range(4) if f < 20]
    rows += [(f"f{f}", f"c{f:02d}{k}", f"Results\nother{f} text{k} about it.", ["1 Results"] if k else None, k, k) for f in range(20, 30) for k in range(4)]
    df = spark.createDataFrame(rows, "file_id string, chunk_id string, text string, section_path array<string>, page_start int, page_end int")
    got = {(r.chunk_id, r.idx) for r in scans.headers(df).collect()}
    assert got == {(f"c{f:02d}{k}", 0) for f in range(20) for k in range(4)}


def test_misreadings():
    assert scans.misreading_cost("vaccirie", "vaccine") == 1 and scans.misreading_cost("c1aim", "claim") == 0.5
    assert scans.misreading_cost("claims", "claim") is None and scans.misreading_cost("word", "word") == 0


def test_page_numbers_and_furniture():
    number = scans.page_number
    assert number("— 4 —", 4, 5, False) and number("Page 3 of 9", 3, 3, False) and number("xii", 12, 12, False) and number("[7]", None, 7, False)
    assert not number("431", 4, 5, False) and not number("4.", 4, 4, False) and not number("", 1, 1, False) and not number("第1", 1, 1, False)
    body, header, page = scans.strip_furniture("Kadobex et al.\nOne word is bro-\n7\nken here.", {0}, 7, 8)
    assert (header, page) == (True, True) and body == f"One word is bro{scans.JOINT}-{scans.JOINT}ken here."


def scan_tables(folder):
    good = "the trained model compares several results without any further claim about calibration"
    rows = [(f"c{i:02d}", "f1", f"Lemtinix et al.\n{good} number {i}.", ["1 Results"], i, i) for i in range(1, 13)]
    rows += [
        ("x1", "f2", "the mo-\ndel compares sev-\neral results with a self-\nsupervised c1aim about ca1ibration", ["2 Results"], 3, 3),
        ("x2", "f2", "a self-supervised model, a self-supervised claim", None, None, None),
        ("x3", "f2", None, [], 1, 1), ("x4", "f2", "", ["2"], 1, 1), ("x5", None, "4\n" + good, ["2"], 4, 4), ("x1", "f2", "the mo-\ndel compares sev-\neral results with a self-\nsupervised c1aim about ca1ibration", ["2 Results"], 3, 3),
        ("x6", "f3", " ".join([good] * 400), ["2"], 1, 1),
    ]
    folder("chunks", [(*r, "extra") for r in rows], "chunk_id string, file_id string, text string, section_path array<string>, page_start int, page_end int, key string")
    return folder.path


def test_scan_noise_end_to_end(spark, folder):
    path = scan_tables(folder)
    got = {(r.chunk_id, r.noise_kind) for r in scans.p2_found(spark, path).collect()}
    assert got == {(f"c{i:02d}", "header") for i in range(1, 13)} | {("x1", "hyphen"), ("x1", "chars"), ("x5", "page_number")}
    text = {r.chunk_id: r.text for r in scans.p2_repaired(spark, path).collect()}
    assert text["x1"] == "the model compares several results with a self-supervised claim about calibration"
    assert text["x3"] is None and text["x4"] == "" and text["c01"].startswith("the trained model")


def test_scan_noise_of_nothing(spark, folder):
    folder("chunks", [], "chunk_id string, file_id string, text string, section_path array<string>, page_start int, page_end int")
    assert scans.p2_found(spark, folder.path).count() == 0


# 3


def test_request_forms():
    assert overlap.request_of('{"task": {"request": "a b", "mode": "x"}}') == "a b"
    assert overlap.request_of('{"messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": "no"}]}') == "hi"
    assert all(overlap.request_of(x) is None for x in (None, "", "null", "[]", "{}", '{"request": "cut off', '{"request": " "}'))
    assert overlap.plain("> Ｆind​ évidence\n> hеre") == "Find evidence here"


def test_one_edit():
    assert overlap.one_edit("wheter", "whether") and overlap.one_edit("whteher", "whether") and overlap.one_edit("a", "a")
    assert not overlap.one_edit("whether", "weather1") and not overlap.one_edit("abc", "xyz")


def overlap_tables(folder, samples, cases):
    folder("training_samples", [(*s, 1) for s in samples], "sample_id string, input string, dataset_split string, source string, record_id int")
    folder("eval_cases", cases, "case_id string, prompt string, split string, source_id string")
    return folder.path


def test_cross_split_pairs(spark, folder):
    ask = "Compare how TorquiraRank and Velbennix-QA handle tokens on Ulvo-v2, and report the cost after 1777 runs."
    other = "Compare how LemdoraRank and Hexnix-QA handle tokens on Ulvo-v2, and report the cost after 1777 runs."
    import json

    path = overlap_tables(
        folder,
        [("t1", json.dumps({"request": ask}), "TRAIN ", "s"), ("t1", json.dumps({"request": ask}), "TRAIN ", "s"), ("t2", json.dumps({"request": "Summarise it"}), "train", None), ("t3", None, "train", "s"), ("t4", "{bad", "train", "s"), ("t5", json.dumps({"request": ask}), None, "s")],
        [("e1", ask.lower(), "val", "q"), ("e2", "Please " + ask.replace("tokens", "tokenz"), "Test", "q"), ("e3", other, "test", "q"), ("e4", "  ", "test", "q"), ("e5", None, "dev", "q"), ("e6", "summarise it!", "test", "q"), ("e7", ask, "train", "q")],
    )
    got = {(r.record_a, r.record_b) for r in overlap.p3_found(spark, path).collect()}
    assert got == {("e1", "t1"), ("e2", "t1"), ("e1", "e7"), ("e2", "e7"), ("e6", "t2")}
    report = {(r.split, r.source): (r.records, r.overlapping) for r in overlap.p3_overlap(spark, path).collect()}
    assert report == {("validation", "q"): (1, 1), ("test", "q"): (3, 2)}


def test_a_pair_of_names_in_half_of_all_records(spark, folder, monkeypatch):
    source, words = random.Random(13), [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    asks = [("TorquiraRank and Velbennix-QA " if i % 2 else f"Lem{i}Rank and Hex{i}-QA ") + " ".join(source.sample(words, 14)) + f" {7000 + i}" for i in range(240)]
    samples = [(f"t{i:03d}", '{"request": "%s"}' % a, "train", "s") for i, a in enumerate(asks)]
    cases = [(f"e{i:03d}", "Please do " + asks[i].lower() if i % 6 else asks[i] + " now", "test", "q") for i in range(0, 240, 3)]
    path = overlap_tables(folder, samples, cases)
    want = {(f"e{i:03d}", f"t{i:03d}") for i in range(0, 240, 3)}
    for pairs in (overlap.HOT_PAIRS, 60):
        monkeypatch.setattr(overlap, "HOT_PAIRS", pairs)
        assert {(r.record_a, r.record_b) for r in overlap.p3_found(spark, path).collect()} == want


def test_a_bucket_of_any_size_loses_no_pair_at_the_bar(spark, folder, monkeypatch):
    source = random.Random(17)
    word = lambda: "".join(source.choice("bcdfghklmnprst") for _ in range(9))
    samples, cases, want = [], [], set()
    for i in range(60):
        own = [word() for _ in range(12)]
        slips = [w[:4] + "x" + w[5:] for w in own[:7]] + [word() for _ in range(2)]
        things = "Of Torquira%sRank with Velbennix%s-QA" % (2 * (chr(97 + i // 5),))
        samples.append((f"t{i:02d}", '{"request": "%s %s"}' % (things, " ".join(own)), "train", "s"))
        cases.append((f"e{i:02d}", f"{things} {' '.join(slips)}", "test", "q"))
        want.add((f"e{i:02d}", f"t{i:02d}"))
    path = overlap_tables(folder, samples, cases)
    for pairs in (overlap.HOT_PAIRS, 10):
        monkeypatch.setattr(overlap, "HOT_PAIRS", pairs)
        assert {(r.record_a, r.record_b) for r in overlap.p3_found(spark, path).collect()} == want


def test_marks_rule_out_no_pair_that_is_the_same(spark):
    source, words, names, rows, same = random.Random(19), "read mode modes on in QA 12 v2 v3 Lem Lemm torque torqeu of at".split(), {"qa", "lem", "lemm", "v2"}, [], 0
    for _ in range(1500):
        a, b = ([w.lower() for w in source.sample(words, source.randint(1, 9))] for _ in range(2))
        if source.random() < 0.6:
            b = [*a[: source.randint(1, 9)], *b[: source.randint(0, 2)]]
        hit = overlap.same_request(set(a), names & set(a), set(b), names & set(b))
        rows.append((*overlap.marks_of(" ".join(a), sorted(names & set(a))), *overlap.marks_of(" ".join(b), sorted(names & set(b))), hit is not None and hit >= overlap.SIMILAR))
    df = spark.createDataFrame(rows, ", ".join(f"{x}_{m} bigint" for x in "ab" for m in ("size", "figures", "names", "shorts")) + ", same boolean")
    got = df.select("same", overlap.may_be_same().alias("may")).collect()
    assert all(r.may for r in got if r.same) and sum(r.same for r in got) > 100 and sum(not r.may for r in got) > 300


def test_classes_are_told_apart_by_their_whole_wording(spark):
    df = spark.createDataFrame([("a b",), ("a  b",), ("a b",)], "wording string").select(overlap.class_key(F.col("wording")).alias("k"))
    assert df.distinct().count() == 2 and all(len(r.k) == 32 for r in df.collect())


def test_cross_split_pairs_of_nothing(spark, folder):
    assert overlap.p3_found(spark, overlap_tables(folder, [], [])).count() == 0


def test_minwise_bands_meet_similar_sets():
    source, met = random.Random(3), 0
    for _ in range(200):
        common = [f"w{source.random()}" for _ in range(8)]
        a, b = common + [f"a{source.random()}" for _ in range(3)], common + [f"b{source.random()}" for _ in range(3)]
        met += bool(set(overlap.band_keys(a, overlap.BANDS, overlap.BAND_ROWS, "n")) & set(overlap.band_keys(b, overlap.BANDS, overlap.BAND_ROWS, "n")))
    assert met >= 195


# 4


def test_chi_squared_quantiles():
    assert np.allclose(consensus.chi2_low(np.array([1, 2, 10, 100, 1000]), 0.025), [0.000982069, 0.0506356, 3.2469728, 74.2219275, 914.2571538], rtol=1e-5)


def test_consensus_prefers_reliable_annotators(spark):
    source, truth, rows = random.Random(4), {}, []
    for item in range(300):
        truth[item] = source.choice(consensus.LABELS)
        votes = {w: truth[item] if source.random() < (0.95 if w in "abc" else 0.3) else source.choice(consensus.LABELS) for w in "abcdefg"}
        for x, y in (("a", "d"), ("e", "f"), ("g", source.choice("bc"))):
            rows.append((f"i{item:03d}", f" {votes[x].upper()}.", votes[y], x, y, None, None, "clash"))
    rows += [("adj", "yes", "yes", "a", "b", "adjudicated: No.", None, ""), ("void", "skip", "", None, "a", "pending", None, ""), ("anon", "no", None, None, None, None, None, ""), (None, "no", "no", "a", "b", None, None, "")] * 2
    df = spark.createDataFrame(rows, "case_id string, annotator_a_label string, annotator_b_label string, annotator_a_id string, annotator_b_id string, adjudication string, annotated_at timestamp, votes string")
    items = consensus.votes_of(df).persist()
    weights = consensus.reliabilities(items)
    got = {r.case_id: r.truth for r in consensus.truths(items, weights.select("annotator", "w")).collect()}
    assert got["adj"] == "no" and got["void"] is None and got["anon"] == "no" and None not in got
    right = sum(got[f"i{k:03d}"] == t for k, t in truth.items())
    plain = {r.case_id: r.truth for r in consensus.truths(items, None).collect()}
    assert right > sum(plain[f"i{k:03d}"] == t for k, t in truth.items()) and right >= 280
    assert consensus.votes_of(df.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_the_chosen_weight_finds_more_hidden_adjudications(spark):
    from papyrine.sources.tables import table

    items = consensus.cut(consensus.votes_of(table(spark, "/root/testdata/sf0.1", "annotation_pairs")))
    gold = items.where("fixed is not null and size(votes) > 0").select("case_id", F.col("fixed").alias("gold"))
    hidden = consensus.cut(items.withColumn("fixed", F.lit(None).cast("string")))
    right = []
    for weight in (consensus.log_odds, consensus.inverse, None):
        weights = None if weight is None else consensus.reliabilities(hidden, weight).select("annotator", "w")
        right.append(consensus.truths(hidden, weights).join(gold, "case_id").where("truth = gold").count())
    assert right == sorted(right, reverse=True) and right[0] > right[2]


# 5


def test_components_equal_union_find(spark):
    source = random.Random(5)
    edges = [(f"n{source.randint(0, 250)}", f"n{source.randint(0, 250)}") for _ in range(160)]
    edges += [("hub", f"h{i}") for i in range(300)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("self", "self"), (None, "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def split_tables(folder, samples, cases):
    folder("training_samples", samples, "sample_id string, dataset_split string, paper_ids array<string>, root string")
    folder("eval_cases", cases, "case_id string, split string, paper_ids array<string>")
    folder("split_targets", [("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5), ("never", 0.0)], "split_name string, share double")
    return folder.path


def test_groups_and_splits(spark, folder):
    samples = [("t1", "train", ["korpa:1", " KORPA:2v3"], "x"), ("t1", "train", ["korpa:1", " KORPA:2v3"], "x"), ("t2", "Dev", ["korpa:2"], None), ("t3", "train", ["unknown", "", None], None), ("t4", "test", ["-"], None), ("t5", "train", None, None), ("t6", None, ["korpa:2"], None), ("t7", "train", ["korpa:9"], None)]
    samples += [(f"u{i:04d}", "train", [f"p{i}"], None) for i in range(1500)]
    path = split_tables(folder, samples, [("e1", "test", ["korpa:9 "]), ("e2", "??", ["korpa:8"])])
    got = {(r.group_id, r.record_id) for r in splits.p5_found(spark, path).collect()}
    assert got == {("t1", "t1"), ("t1", "t2"), ("t1", "t6"), ("e1", "e1"), ("e1", "t7")}
    rows = splits.p5_assigned(spark, path).collect()
    assert len(rows) == 1509 and len({(r.group_id, r.split) for r in rows}) == len({r.group_id for r in rows})
    share = Counter(r.split for r in rows)
    assert abs(share["train"] / 1509 - 0.8) < 0.05 and set(share) == {"train", "validation", "test"}


def test_groups_of_nothing(spark, folder):
    path = split_tables(folder, [], [])
    assert splits.p5_found(spark, path).count() == 0 and splits.p5_assigned(spark, path).count() == 0


# 6


def test_codes_keep_order_and_decode_within_bounds():
    source = np.random.default_rng(6)
    values = np.unique(np.concatenate([np.arange(-300, 300), source.normal(0, 1e6, 2000), source.integers(-(2**62), 2**62, 500).astype(float), [0.0, -0.0, 1e-300, -1e300]]))
    codes = quantiles.codes_of(values)
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 2**quantiles.BITS
    back = np.array([quantiles.value_of(c) for c in codes])
    assert (np.abs(back - values) <= np.abs(values) * 2.0**-28).all() and [quantiles.value_of(c) for c in quantiles.codes_of(np.array([-7.0, 0.0, 600000.0]))] == [-7.0, 0.0, 600000.0]


def exact_rank_within(ordered, value, q, slack):
    n = len(ordered)
    return np.searchsorted(ordered, value) - slack * n <= np.ceil(q * n) <= np.searchsorted(ordered, value, side="right") + slack * n


def test_sketch_ranks_merges_and_deletions(spark):
    source = np.random.default_rng(7)
    values = np.concatenate([source.lognormal(9, 1.5, 6000), -source.lognormal(3, 1, 2000), np.full(3000, 777.0)])
    df = spark.createDataFrame([("a", int(i % 3), float(v), 1, "x") for i, v in enumerate(values)] + [("a", 0, None, 1, ""), ("a", 0, float("nan"), 1, ""), ("a", 0, 5.0, None, "")], "k string, day int, v double, w int, sketch string")
    junk = spark.createDataFrame([("a", 0, 1e9 + i) for i in range(4000)], "k string, day int, v double")
    added = quantiles.build(df.drop("sketch").unionByName(junk.withColumn("w", F.lit(1))), ["k", "day"], "v", "w")
    removed = quantiles.build(junk.withColumn("w", F.lit(-1)), ["k", "day"], "v", "w")
    merged = quantiles.merge(added.unionByName(removed), ["k"])
    whole = quantiles.build(df, ["k"], "v", "w")
    ordered = np.sort(values)
    got, direct = (sorted(map(tuple, quantiles.percentiles(s, ["k"], [0.1, 0.5, 0.9, 0.99]).collect())) for s in (merged, whole))
    assert got == direct and all(n == len(values) and exact_rank_within(ordered, v, q, quantiles.EPS) for _, q, n, v in got)
    assert quantiles.percentiles(quantiles.build(df.limit(0), ["k"], "v"), ["k"], [0.5]).count() == 0
    assert quantiles.percentiles(removed, ["k", "day"], [0.5]).count() == 0


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (2, 7)], "k bigint, v int")
    assert sorted((str(r.k), r.n, r.value) for r in quantiles.percentiles(quantiles.build(df, ["k"], "v"), ["k"], [0.5]).collect()) == [("2", 1, 7.0), ("None", 2, 1.0)]


def test_sketches_do_not_grow_with_what_they_hold():
    source = np.random.default_rng(8)
    sizes = []
    for n in (4_000, 40_000, 400_000, 4_000_000):
        values = source.lognormal(9, 1.5, n)
        s = quantiles.Sketch().add(quantiles.codes_of(values), np.ones(n, dtype=np.int64))
        sizes.append(s.cells.nbytes + s.top.nbytes)
        assert all(exact_rank_within(np.sort(values), s.value(q), q, quantiles.EPS) for q in (0.01, 0.5, 0.9, 0.99, 0.999))
        assert np.array_equal(quantiles.Sketch.load(s.dump()).cells, s.cells)
    assert len(set(sizes)) == 1


def test_absurd_token_counts_are_no_measurements(spark, folder):
    rows = [(i, "s", 100 + i, 1000 + 10 * i, "2024-01-01 00:00:00") for i in range(200)]
    rows += [(900, "s", -1, 50_000_000, "2024-01-01 00:00:00"), (901, "s", 0, -5, "2024-01-01 00:00:00"), (902, None, 7, 7, "2024-01-01 00:00:00"), (903, "s", 7, 7, None), (0, "s", 100, 1000, "2024-01-01 00:00:00"), (904, "s", None, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "score_id bigint, system_id string, latency_ms bigint, total_tokens bigint, r string").withColumn("recorded_at", F.col("r").cast("timestamp"))
    df.write.parquet(f"{folder.path}/case_scores.parquet")
    assert {(r.metric, r.n) for r in quantiles.p6_percentiles(spark, folder.path).collect()} == {("latency_ms", 200), ("total_tokens", 200)}


# 7


def brute_ends(text, limit, overlap):
    cuts, ends, start, end = pieces.boundaries(text), [], 0, 0
    while end < len(text):
        reach = min(start + limit, len(text))
        nxt = reach
        if reach < len(text):
            for kind in pieces.KINDS:
                inside = [p for p in cuts[kind].tolist() if end < p <= reach and p - start > overlap]
                if inside:
                    nxt = inside[-1]
                    break
        end = nxt
        ends.append(end)
        start = max(end - overlap, 0)
    return ends


def test_pieces_equal_greedy_cuts():
    source = random.Random(8)
    for _ in range(150):
        text = "".join(source.choice(["word ", "x" * source.randint(1, 60), ". ", "\n\n", "。", "词", " "]) for _ in range(source.randint(1, 120)))
        limit, lap = source.choice([(40, 8), (70, 0), (25, 10)])
        got = pieces.split_text(text, limit, lap)
        if len(text) > limit:
            assert [e for _, e in got] == brute_ends(text, limit, lap)
            assert all(b - a <= limit for a, b in got) and all(nxt[0] == max(cur[1] - lap, 0) for cur, nxt in zip(got, got[1:], strict=False))
        assert "".join(text[max(a, prev):b] for (a, b), prev in zip(got, [0, *(e for _, e in got)], strict=False)) == text
    assert pieces.split_text("") == [] and pieces.split_text("a" * 700) == [(0, 700)] and len(pieces.split_text("a" * 70_000)) == 113


def test_coarsest_boundary():
    assert pieces.coarsest("a" * 10 + "\n\n" + "b" * 10, 10) == "paragraph"
    assert pieces.coarsest("aaaa. bbbb\n\n" + "b" * 3, 6) == "sentence"
    assert pieces.coarsest("aaaa bbbb", 6) == "word" and pieces.coarsest("a" * 9, 6) == "none" and pieces.coarsest("好。" * 9, 6) == "sentence"


def test_successors_agree_with_the_longest_part():
    source = random.Random(11)
    for _ in range(300):
        text = "".join(source.choice(["word ", "x" * source.randint(1, 30), ". ", "\n\n", "。", "  ", "\n \n"]) for _ in range(source.randint(0, 40)))
        cuts, limit = pieces.boundaries(text), source.randint(1, 60)
        fits = [k for k in pieces.KINDS if pieces.longest_part(text, np.concatenate([[0], cuts[k], [len(text)]])) <= limit]
        assert pieces.coarsest(text, limit) == (fits[0] if fits else "none"), (text, limit)


def test_same_text_in_two_places_keeps_the_first(spark, folder):
    rows = [("c", "ab " * 300, ["s2"], 2), ("c", "ab " * 300, ["s1"], 1), ("c", "ab " * 300, None, None), ("d", None, None, 1), ("e", "", None, 1)]
    folder("chunks", rows, "chunk_id string, text string, section_path array<string>, page_start int")
    got = pieces.oversized(spark, folder.path).collect()
    assert len(got) == 1 and {(r.chunk_id, r.boundary) for r in pieces.p7_found(spark, folder.path).collect()} == {("c", "word")}


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (1, "a b", "z")], "id int, text string, k string")
    assert sorted((r.id, r.piece) for r in pieces.cut_pieces(df, "id", "text").collect()) == [(1, "a b"), (1, "a b")]


# 8 and 9


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_tree_encoding_equals_whole_encoding(leaf):
    encoding = bpe.encoding_of(bpe.rank_file())
    tree, source = bpe.TreeEncoder(encoding, leaf), random.Random(9)
    for _ in range(400):
        text = "".join(source.choice(" \n\t'lsvredmaB1é中。<|>😀　 ") for _ in range(source.randint(0, 60)))
        ids = tree.encode(text)
        assert ids == encoding.encode_ordinary(text) and tree.decode(ids) == text


def test_points_of_synchrony_are_met_by_every_scan():
    encoding, source = bpe.encoding_of(bpe.rank_file()), random.Random(12)
    for _ in range(3000):
        text = "".join(source.choice(" \n\t'lsvredmaB1é中。<|>😀　 \x1c\x85,") for _ in range(source.randint(2, 40)))
        for m in bpe.SYNC.finditer(text):
            i = m.start()
            assert encoding.encode_ordinary(text[:i]) + encoding.encode_ordinary(text[i:]) == encoding.encode_ordinary(text)


def test_round_trip_of_rows(spark):
    df = spark.createDataFrame([(1, "a b" * 2000, "x"), (2, "", "x"), (3, None, "x"), (1, "对齐。" * 900, "x")], "doc_id bigint, text string, ids string")
    ids = bpe.encode_column(df.drop("ids"), "doc_id", "text", bpe.rank_file(), leaf=50)
    assert sorted(map(str, bpe.decode_column(ids, "doc_id", "ids", bpe.rank_file()).collect())) == sorted(str(r) for r in df.select("doc_id", "text").collect())


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "hello  world", 0), (2, "", 0), (3, None, 0), (None, "x" * 50_000, 0), (1, "hello  world", 0)], "doc_id bigint, text string, k int")
    rows = bpe.encode_column(df, "doc_id", "text", bpe.rank_file(), leaf=100).collect()
    by = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 5 and by[2] == [] and by[3] is None and by[1] == [31373, 220, 995]
    assert bpe.encode_column(df.limit(0), "doc_id", "text", bpe.rank_file()).count() == 0


def test_plan_places_every_item_once():
    source = random.Random(10)
    for lengths in ((100,), (25, 50, 100)):
        counts = {source.randint(1, 100): source.randint(1, 40) for _ in range(30)}
        plan = packing.plan_packing(counts, lengths)
        used = Counter()
        for size, n in counts.items():
            first = np.array(plan.first[size])
            for k in range(n):
                i = np.searchsorted(first, k, side="right") - 1
                used[plan.base[size][i] + (k - plan.first[size][i]) // plan.each[size][i]] += size
        assert max(used.values()) <= 100 and set(used) == set(range(plan.containers)) and sum(used.values()) == sum(s * n for s, n in counts.items())


def test_lengths_are_chosen_jointly_and_a_frequent_size_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 10)
    df = spark.createDataFrame([(i, 200) for i in range(2000)] + [(5000 + i, 40) for i in range(300)], "id bigint, size bigint")
    for lengths in ((2048,), packing.LENGTHS):
        report = packing.container_report(packing.pack(df, "id", "size", lengths=lengths)).collect()
        assert sum(r.used for r in report) == 412_000 and max(r.used for r in report) <= 2048 and sum(r["items"] for r in report) == 2300
        assert all(r.length >= r.used and r.length in packing.LENGTHS for r in report)


def test_packed_rows(spark):
    df = spark.createDataFrame([(i, (i * 37) % 900 + 1, "c") for i in range(800)] + [(9001, 5000, "c"), (9002, 0, "c"), (9003, None, "c")], "id bigint, size bigint, container_id string")
    rows = packing.pack(df, "id", "size").collect()
    fill = Counter()
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum((i * 37) % 900 + 1 for i in range(800)) + 5000
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.piece) if r.id == 9001] == [2048, 2048, 904]
    assert {r.id for r in rows if r.container_id is None} == {9002, 9003} and Counter(r.id for r in rows if r.id < 9000) == Counter(range(800))
    total = sum(fill.values())
    assert len(fill) * 2048 - total <= 0.02 * total + 2048
    assert packing.pack(df.limit(0), "id", "size").count() == 0


# 10


def test_stack_automaton():
    depth = lambda t: [s for s, _ in truncation.Nesting(t).open]
    assert depth("a (b [c] d") == [")"] and depth("<div><b>x</b>") == ["div"] and depth("```x") == ["```"] and depth("(a) <br> “b”") == [] and depth(")") == []


def corpus(spark, extra):
    whole = "We compare the small models with the large models. The results of the study support the main claim."
    rows = [(i, whole, len(whole), "feed", "abstract") for i in range(40)]
    return spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id bigint, text string, n_chars bigint, source string, doc_kind string, key string")


def test_cut_texts(spark):
    base = "We compare the small models with the large models. "
    extra = [
        (100, base + "The results of the study support the main claim", None, "feed", "abstract"),  # lacks its mark alone
        (101, base + "The results of the study supp", None, "feed", "abstract"), (102, base + "The results of the", None, "feed", "abstract"),
        (103, base + "The results of …", None, "feed", "abstract"), (104, base + "...", None, "feed", "abstract"), (105, base + "The results (of the small models", None, None, None),
        (106, base + "The results �", None, "feed", "abstract"), (107, None, 5, "feed", "abstract"), (108, "", 5, "feed", "abstract"), (109, " \n", 5, "feed", "abstract"),
        (110, base * 500, None, "feed", "full_text"), (101, base + "The results of the study supp", None, "feed", "abstract"),
        (111, base + "The results of the study support the main claim", 5000, "feed", "abstract"),
    ]
    rows = truncation.truncated(corpus(spark, extra)).collect()
    assert {r.doc_id for r in rows if r.cut} == {101, 102, 103, 105, 106, 111}
    assert len(rows) == 40 + 9 and truncation.truncated(corpus(spark, []).limit(0)).count() == 0


def test_ends_are_read_however_long(spark):
    assert all(truncation.ending("It holds." + " [12, p. 3]" * n + " " * n)["closed"] for n in (1, 20, 60, 5000))
    assert truncation.ending("It is " + "w" * 5000)["last_word"] == "w" * 5000 and not truncation.ending("It is")["closed"]
    assert truncation.end_keys("so " + "x " * 3000 + "of the", None) == ["e:w w w of the"]


def test_shares_do_not_change_with_the_amount(spark):
    base = "We compare the small models with the large models. "
    ends = [("The results of the study support the main claim", False), ("The results of the study supp", True), ("The results of the", True)]
    for times in (1, 30):
        extra = [(100_000 + 10 * i + j, f"{base}{'Yes. ' * (i * 3 + j)}{end}", None, "feed", "abstract") for i in range(times) for j, (end, _) in enumerate(ends)]
        rows = [(i, f"{base}{'Yes. ' * (i % 997)}The results of the study support the main claim{'.' if i % 9 else ''}", None, "feed", "abstract") for i in range(40 * times)]
        df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id bigint, text string, n_chars bigint, source string, doc_kind string, key string")
        got = {r.doc_id for r in truncation.truncated(df).collect() if r.cut}
        assert got == {r[0] for r, (_, is_cut) in zip(extra, ends * times, strict=True) if is_cut}


def test_field_limits_stand_out_from_chance(spark):
    rows = [("s", 100 + i, 100 + i, i % 5 == 0) for i in range(200)] + [("s", 256, 256, True)] * 12 + [(None, 9, 9, True)] * 50 + [("t", 5, 5, True), ("t", 7, 7, False)]
    df = spark.createDataFrame([(s, c, b, not o, None) for s, c, b, o in rows], "source string, chars int, bytes int, closed boolean, doc_kind string")
    assert sorted(map(tuple, truncation.field_limits(df).collect())) == [("s", "bytes", 256), ("s", "chars", 256)]
