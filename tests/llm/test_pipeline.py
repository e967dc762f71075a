"""The pipeline stage by stage, each held against what its operator says of its own input."""

import collections

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, packing, simhash_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, None, "s", 0), (9002, "123 456", None, "s", 7), (9003, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))]
    for _, stage in cp.STAGES:
        docs.append(stage(spark, docs[-1], SF).persist())
    return docs


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_stage_drops_what_has_no_language(stages):
    gone = set(ids(stages[0])) - set(ids(stages[1]))
    assert {9001, 9002, 9003} <= gone and len(gone) < 10


def least_of_groups(rows):
    """By brute force: the least id of each row's group of five-word similarity of 0.8 or more."""
    sets = {d: simhash_dedup.shingle_set(t.encode()) for d, t in rows}
    root = {d: d for d in sets}
    near = {x: [y for y in sets if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8] for x in sets}
    while True:
        new = {x: min(root[y] for y in near[x]) for x in sets}
        if new == root:
            return root
        root = new


def test_near_dedup_keeps_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].select("doc_id", "text").collect()]
    assert ids(stages[2]) == sorted(set(least_of_groups(rows).values()))


def test_repeated_passages_are_cut(stages):
    before = {r["doc_id"]: (r["text"] or "").encode() for r in stages[2].select("doc_id", "text").collect()}
    seen = collections.Counter(b[i : i + cp.PASSAGE] for b in before.values() for i in range(len(b) - cp.PASSAGE + 1))
    want = {}
    for d, b in before.items():
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - cp.PASSAGE + 1):
            if seen[b[i : i + cp.PASSAGE]] > 1:
                gone[i] += 1
                gone[i + cp.PASSAGE] -= 1
        kept = np.frombuffer(b, np.uint8)[np.cumsum(gone)[:-1] == 0].tobytes()
        if kept or not b:
            want[d] = kept.decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] for r in stages[3].select("doc_id", "text").collect()} == want
    assert stages[3].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_decontamination_drops_exactly_what_is_found(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = set(ids(decontaminate.contaminated(stages[3], bench)))
    assert ids(stages[4]) == sorted(set(ids(stages[3])) - found)


def test_all_that_is_left_is_packed(stages):
    assert sorted(set(ids(stages[5]))) == ids(stages[4])
    over = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert over.filter(f"n > {packing.SEQUENCE} or n <> m").count() == 0


def test_near_dedup_drops_copies_down_to_the_similarity(spark):
    rng = np.random.default_rng(4)
    rows, want, pick = [], set(), lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    for k in range(60):
        base = pick(int(rng.integers(60, 400)))
        changed = (0.8, 0.85, 0.9, 0.95, 0.75, 0.6)[k % 6]
        # n places far apart change 5n shingles on either side
        shared = len(base) - 4
        n = int(shared * (1 - changed) / (1 + changed) / 5)
        n += changed < 0.8
        copy = list(base)
        for at in range(n):
            copy[4 + at * 5] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy).upper())]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, copy))
        want |= {2 * k} if len(a & b) / len(a | b) >= 0.8 else {2 * k, 2 * k + 1}
    assert len(want) == 80
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = set(ids(cp.near_dedup(spark, docs, SF)))
    # at the least similarity a pair in a thousand may never meet
    assert want <= got and len(got - want) <= 1


def test_chains_of_close_copies_are_one_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        at = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(15):
            rows.append((100 * g + k, " ".join(at)))
            at = list(at)
            at[int(rng.integers(0, 120))] = f"z{k}"
    found = {}
    for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for d, least in least_of_groups(rows).items():
        want.setdefault(least, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def exact_pairs(rows):
    sets = {d: simhash_dedup.shingle_set(t.encode()) for d, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}


def test_prefix_filter_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "COUNTERS", 16)  # counters that very many share
    monkeypatch.setattr(simhash_dedup, "MAP_BITS", 64)
    rng = np.random.default_rng(6)
    rows, at = [], 0
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 40 if g % 2 else 3000, int(rng.integers(4, 60)))]
        for _ in range(int(rng.integers(2, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(copy)))
                copy[k : k + 1] = [[], ["new"], [copy[k], "more"]][int(rng.integers(0, 3))]
            rows.append((at, " ".join(copy)))
            at += 1
    texts = spark.createDataFrame([(d, d, t.encode()) for d, t in rows], "node long, root long, text binary")
    tried = {(r["u"], r["v"]) for r in simhash_dedup.prefix_pairs(texts).collect()}
    want = exact_pairs(rows)
    assert want <= tried and len(want) > 60 and len(tried) < 10 * len(want)


def test_short_texts_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(300):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(8, 32)))]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: -max(1, len(base) // 8)] if g % 3 else base[1:]))]
    root = least_of_groups([r for r in rows])
    found = {}
    for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["root"], set()).add(r["doc_id"])
    want = {}
    for d, least in root.items():
        want.setdefault(least, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and len(want) < 500


def test_a_large_group_just_below_the_similarity_costs_no_square(spark, monkeypatch):
    """2,000 texts that have 88 of 100 shingles in common: each two are 0.78 alike."""
    core = " ".join(f"c{k}" for k in range(92))
    rows = [(d, f"{core} " + " ".join(f"u{d}x{k}" for k in range(12 + d % 2))) for d in range(2000)]
    rows += [(5000 + d, f"{core} " + " ".join(f"u{d}x{k}" for k in range(11 + d % 2))) for d in range(5)]
    tried = []
    write = simhash_dedup.materialize

    def counted(df, tag, keep=False):
        out = write(df, tag, keep)
        if tag == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "materialize", counted)
    roots = [r["root"] for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    # the last five are copies of the first, and three of them are just alike enough
    assert len(set(roots)) == 1998 and sum(tried) < 10_000, (len(set(roots)), tried)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _text int, language int, item int, bin int, at int, t int, node int, text_key int"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that share an id or have none, equal rows, nulls, empty and very long texts, and columns with clashing names."""
    prose = "the cat sat on the mat and saw the dog run away while the sun went down behind the old house near the river"
    other = "a quick brown fox jumps over the lazy dog and then it runs into the deep green woods to find some food for its young"
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(f"word{k % 9973} and the {k}" for k in range(60_000))
    rows = [(1, prose), (1, prose), (1, other), (None, f"{other} with more words behind it so that it is a text of its own entirely, not a copy of any"), (None, None), (2, None), (3, ""), (4, long), (5, f"so they said {benchmark}"), (None, f"and so they said at last {benchmark}"), (5, "a clean text of plain words that shares its number with one that is not clean at all, as may be"), (6, prose)]
    return spark.createDataFrame([(d, t, None if k % 3 else "en", None, len(t or ""), *range(8)) for k, (d, t) in enumerate(rows)], ODD)


@pytest.mark.parametrize("k", range(4))
def test_stages_stand_odd_rows(spark, odd, k):
    empty = cp.STAGES[k][1](spark, odd.limit(0), SF)
    assert empty.columns == odd.columns and empty.count() == 0
    out = cp.STAGES[k][1](spark, odd, SF)
    assert out.dtypes == odd.dtypes
    rows = out.collect()
    # clashing columns come back as they went in
    assert all((r["_text"], r["language"], r["item"], r["bin"], r["at"], r["t"], r["node"], r["text_key"]) == tuple(range(8)) for r in rows)
    got = sorted((r["doc_id"] or -1, (r["text"] or "")[:12]) for r in rows)
    before = sorted((r["doc_id"] or -1, (r["text"] or "")[:12]) for r in odd.collect())
    if cp.STAGES[k][0] == "language_id":
        assert {(-1, ""), (2, ""), (3, "")} <= set(before) - set(got) and (1, "the cat sat ") in got
    if cp.STAGES[k][0] == "simhash_near_dedup":
        assert got.count((1, "the cat sat ")) == 1 and (6, "the cat sat ") not in got and (1, "a quick brow") in got
        assert got.count((2, "")) == 1 and (3, "") not in got and (-1, "") not in got
    if cp.STAGES[k][0] == "suffix_array_dedup":
        # no passage is long enough to be cut; rows without an id and of one id stay apart
        assert got == before
        twice = odd.filter("doc_id = 4").unionByName(odd.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
        kept = cp.STAGES[k][1](spark, twice.unionByName(odd.filter("doc_id = 6")), SF).collect()
        assert [r["doc_id"] for r in kept] == [6]
    if cp.STAGES[k][0] == "benchmark_decontamination":
        assert set(before) - set(got) == {(5, "so they said"), (-1, "and so they ")} and (5, "a clean text") in got


def test_packing_stage_stands_odd_rows(spark, odd):
    assert cp.best_fit_packing(spark, odd.limit(0), SF).count() == 0
    rows = cp.best_fit_packing(spark, odd, SF).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
