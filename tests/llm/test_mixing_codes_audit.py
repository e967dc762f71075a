"""Mixing, vector codes and the filter audit against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import filter_audit, mixing, queries, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11 mixing ------------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """The excess of sources above their bound is shared out again until there is none."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "size", "source_size", "target", "copies").collect()]


def check_mix(rows, texts):
    """``texts``: (doc_id, source, text) of all rows."""
    sizes = Counter()
    for _, s, t in texts:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets_by_hand(sizes), Counter()
    assert Counter((d, s, z) for d, s, z, *_ in rows) == Counter((d, s, len(WORD.findall(t or ""))) for d, s, t in texts)
    for _, s, z, total, target, copies in rows:
        assert total == sizes[s] and target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= copies <= 2
        taken[s] += copies * z
    return want, taken, sizes


def test_mix_meets_the_targets(spark, some_docs):
    texts = [tuple(r) for r in some_docs.select("doc_id", "source", "text").collect()]
    want, taken, sizes = check_mix(rows_of(mixing.mix(some_docs)), texts)
    by_source = {}
    for _, s, t in texts:
        by_source.setdefault(s, []).append(len(WORD.findall(t or "")))
    for s, target in want.items():
        # a source has ten documents; no choice of them comes nearer
        extra = 1 if target >= sizes[s] else 0
        left = round(target - extra * sizes[s])
        sums = {0}
        for z in by_source[s]:
            sums |= {x + z for x in sums}
        if target >= 2 * sizes[s]:
            assert taken[s] == 2 * sizes[s]
        else:
            assert abs(taken[s] - extra * sizes[s] - left) <= max(2 * min(abs(x - left) for x in sums), max(by_source[s]))


@pytest.mark.parametrize("seed", range(30))
def test_small_budgets_are_met_as_near_as_can_be(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 60, 5))
    counts = rng.integers(0, 4, len(sizes))
    sums = {0}
    for z, n in zip(sizes.tolist(), counts.tolist()):
        sums = {x + k * z for x in sums for k in range(n + 1)}
    for wanted in range(0, int((sizes * counts).sum()) + 1, 3):
        taken = mixing.nearest_sum(sizes, counts, wanted)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int(taken @ sizes) - wanted) == min(abs(x - wanted) for x in sums)


@pytest.mark.parametrize("rest", [40, 1 << 16])
def test_large_budgets_are_met_to_the_word(monkeypatch, rest):
    monkeypatch.setattr(mixing, "REST", rest)
    rng = np.random.default_rng(3)
    sizes = np.arange(1, 3000)
    counts = rng.integers(0, 10**6, len(sizes))
    total = int(sizes @ counts)
    for budget in (0, 1, 12345, total // 3, total - 7, total):
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and int(taken @ sizes) == budget
    # a third of the words is a third of each size
    share = mixing.fit(sizes, counts, total // 3) / np.maximum(counts, 1)
    assert np.abs(share[counts > 10**5] - 1 / 3).max() < 0.01


def test_documents_longer_than_the_rest_are_taken_if_nearer(monkeypatch):
    monkeypatch.setattr(mixing, "REST", 10)
    assert mixing.fit(np.array([1000, 3000]), np.array([1, 1]), 600).tolist() == [1, 0]
    assert mixing.fit(np.array([1000, 3000]), np.array([1, 1]), 400).tolist() == [0, 0]


def test_the_least_hashes_of_a_size_are_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    rows = [(k, "s" if k % 3 else None, 7 + k % 2, int(h)) for k, h in enumerate(np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3000))]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, h long")
    n = Counter((s, z) for _, s, z, _ in rows)
    plan = [(s, z, n[s, z], 1, more) for (s, z), more in zip(sorted(n, key=str), (0, 333, 1, n[sorted(n, key=str)[3]]))]
    out = mixing.chosen(df, spark.createDataFrame(plan, "source string, size long, n long, passes long, more long")).collect()
    assert len(out) == len(rows)
    for s, z, _, _, more in plan:
        own = sorted(((r["h"] & (1 << 64) - 1) for r in out if (r["source"], r["size"]) == (s, z)))
        picked = sorted((r["h"] & (1 << 64) - 1) for r in out if (r["source"], r["size"]) == (s, z) and r["taken"] == 2)
        assert len(picked) == more
        # unsigned ranges, signed order within one: whole ranges are taken from the front
        assert set(picked[: max(0, more - 150)]) <= set(own[: more + 100])


def test_mix_is_the_same_however_rows_are_dealt(spark, some_docs):
    a, b = rows_of(mixing.mix(some_docs.repartition(7))), rows_of(mixing.mix(some_docs.orderBy(F.desc("doc_id")).coalesce(1)))
    assert sorted(map(str, a)) == sorted(map(str, b))
    same = some_docs.withColumn("text", F.lit("a b c")).withColumn("source", F.when(F.col("doc_id") < 150, "a").otherwise("b"))
    picked = [sorted(map(str, rows_of(mixing.mix(same, weights=(1, 9), seed=k)))) for k in (1, 1, 2)]
    assert picked[0] == picked[1] != picked[2]


def test_hot_sources_and_sizes(spark):
    """A source with most rows, all of one size, and copies of one row."""
    rng = random.Random(2)
    rows = [(k, "big", "a b c") for k in range(6000)] + [(7, "big", "x y z")] * 500 + [(k, f"s{k % 5}", "w " * rng.randrange(90)) for k in range(9000, 9400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, taken, _ = check_mix(rows_of(mixing.mix(docs)), rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 3


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    texts = [tuple(r) for r in odd_docs.select("doc_id", "source", "text").collect()]
    check_mix(rows_of(mixing.mix(odd_docs)), texts)
    assert mixing.mix(no_docs).count() == 0
    zero = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r["target"] for r in mixing.mix(zero).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, weights=(1, 0))


def test_sources_are_in_order_of_code_points(spark):
    names = ["\U00010000", "￮", "Z", "a", "é", None]
    docs = spark.createDataFrame([(k, s, "w " * 10) for k, s in enumerate(names)], "doc_id long, source string, text string")
    got = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert got == pytest.approx(targets_by_hand(dict.fromkeys(names, 10)))


def test_mixture_has_a_row_for_each_copy(spark, odd_docs):
    mixed = mixing.mix(odd_docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    out = mixing.mixture(odd_docs.withColumn("copy", F.lit("own")))
    assert out.columns == [*odd_docs.columns, "copy", "_copy"] and {r["copy"] for r in out.collect()} == {"own"}
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, mixed.collect()))


# 12 vector codes ------------------------------------------------------------------------------------------------------


def quantized(rows, parts=8, entries=16, rounds=6):
    """(id, code, error) of each row and the books, by plain loops; ``rows``: (id, components)."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * w : (k + 1) * w]
    books = [[cut(v, k) for _, v in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, book: min((far(p, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            at = [best(cut(v, k), books[k])[1] for _, v in kept]
            for e in range(len(books[k])):
                own = [cut(v, k) for (_, v), x in zip(kept, at) if x == e]
                if own:
                    books[k] = [*books[k][:e], [sum(c) // len(own) for c in zip(*own)], *books[k][e + 1 :]]
    out = []
    for i, v in kept:
        found = [best(cut(v, k), books[k]) for k in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("leaves", [1, 5, 4096])
def test_walk_gives_the_distances(monkeypatch, leaves):
    monkeypatch.setattr(vector_codes, "SUBTREE", leaves)
    rng = np.random.default_rng(leaves)
    parts = np.unique(rng.integers(-3, 4, (400, 4)), axis=0)
    book = rng.integers(-3, 4, (6, 4))
    seen = 0
    for first, last, far in vector_codes.walk(parts, book):
        assert first == seen  # depth first: leaves come in order
        seen = last
        assert (far == ((parts[first:last, None, :] - book[None]) ** 2).sum(axis=2)).all()
    assert seen == len(parts)
    rows = rng.integers(-3, 4, (500, 4))
    code, error = vector_codes.assign_all(rows, book)
    want = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == want.argmin(axis=1)).all() and (error == want.min(axis=1)).all()


def test_nodes_share_what_their_prefix_costs(monkeypatch):
    """Parts with long common prefixes cost far fewer squares than parts times dimensions."""
    parts = np.array([[1] * 7 + [k] for k in range(4000)])
    done = []

    class Counted(np.ndarray):
        def __pow__(self, n):
            done.append(self.size)
            return np.asarray(self) ** n

    vector_codes.below(parts.view(Counted), np.zeros((16, 8), np.int64), 0, np.zeros(16, np.int64))
    assert sum(done) == 16 * (7 + 4000)


def test_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(8)
    some = rng.normal(0, 0.2, (300, 16)).astype(np.float32)
    some[50:90] = some[3]  # copies
    some[100:140, :8] = some[4, :8]
    rows = [(int(i), [float(x) for x in v], int(k) if k else None) for i, v, k in zip(rng.permutation(300), some, rng.integers(0, 4, 300))]
    rows += [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [float("nan")] * 16, None), (903, [float("-inf")] + [0.0] * 15, 2), rows[0], (None, [0.25] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit("mine").alias("encoded"), F.lit(1).alias("part"))
    want, sha = quantized([(i, v) for i, v, _ in rows])
    got = vector_codes.compress(df).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["codebooks_sha256"] for r in got} == {sha}
    by_label, label_of = Counter(), {}
    for i, _, k in rows:
        label_of[i] = k
    for i, _, e in want:
        by_label[label_of[i]] += e
    assert all(r["label_error"] == by_label[label_of[r["vec_id"]]] for r in got)
    coded = vector_codes.encode(df, vector_codes.train(df))
    assert coded.columns == [*df.columns, "_encoded"] and {r["encoded"] for r in coded.collect()} == {"mine"}


def test_query_equals_plain_loops(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, sha = quantized(rows)
    got = queries.op12_vector_codes(spark, sf).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(want) and {r["codebooks_sha256"] for r in got} == {sha}


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(5, [0.5] * 8, None), (5, [0.5] * 8, None), (2, [0.75] * 8, None)], kind)
    got = vector_codes.compress(one).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(2, "00" * 8, 0, 0), (5, "01" * 8, 0, 0), (5, "01" * 8, 0, 0)]
    assert vector_codes.compress(one.limit(0)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, None)], kind)).count() == 0
    large = spark.createDataFrame([(1, [3e38, -3e38] * 4, 1), (2, [0.0] * 8, 1)], kind)
    assert [r["error"] for r in vector_codes.compress(large).collect()] == [0, 0]
    for bad in ([(1, [0.5] * 9, None)], [(1, [0.5] * 8, None), (2, [0.5] * 16, None)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, kind))


# 13 filter audit ------------------------------------------------------------------------------------------------------


def counts_by_hand(t):
    words = WORD.findall(t)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)]


HARD = ["", " ", "a", "a a", "A#b  a\tA#b\x0b\x0cé é é", "x" * 40, "abcdefgh abcdefgh abcdefgi abcdefghi abcdefghi abcdefghj", "\U0001f600 \U0001f600x", "a" * 9 + " " + "a" * 8, "  \x85 \x1c", "\x00 \x00\x00 \x00", "|" * 70, "Zz " * 50]


@pytest.mark.parametrize("piece", [1, 3, 8, 61, 1 << 18])
def test_transducer_counts(monkeypatch, piece):
    monkeypatch.setattr(filter_audit, "PIECE", piece)
    rng = random.Random(piece)
    texts = HARD + ["".join(rng.choice("ab AB#é\n\U0001f600") for _ in range(rng.randrange(90))) for _ in range(60)]
    texts += [" ".join(f"word{rng.randrange(300)}" for _ in range(700 if piece > 3 else 60))]
    assert filter_audit.read_texts([t.encode() for t in texts]).tolist() == [counts_by_hand(t) for t in texts]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(filter_audit, "_UP", np.zeros_like(filter_audit._UP))
    texts = HARD + ["the cat saw the dog and the cow and the cat", "cat dog"]
    assert filter_audit.read_texts([t.encode() for t in texts]).tolist() == [counts_by_hand(t) for t in texts]


def test_a_long_text_grows_the_table():
    rng = random.Random(4)
    t = " ".join(f"{rng.randrange(200_000)}x{'y' * rng.randrange(30)}" for _ in range(150_000)) + " " + "é" * 400_000 + " end"
    assert filter_audit.read_texts([b"a", t.encode(), b"b b"]).tolist() == [counts_by_hand(x) for x in ("a", t, "b b")]


def audited(docs, labels):
    """All orders one by one; ``docs``: (doc_id, source, text), ``labels``: (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    least, rows, out = {}, [], {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, s, t in docs:
        t = t or ""
        words, distinct, capitals, points, signs = counts_by_hand(t)
        failed = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": signs > 0, "E": d is not None and least[t] < d}
        rows.append((d, s or "", {f for f, x in failed.items() if x}))
    for part in {s for _, s, _ in rows}:
        own, shares = [(d, f) for d, s, f in rows if s == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d, x in left if f in x]
                left_now = [(d, x) for d, x in left if f not in x]
                redundant = sum(f in x for _, x in own) - len(gone)
                shares[f] += len(gone)
                out[part, "".join(order), step] = [len(left_now), len(gone), redundant, sum(x == {f} for _, x in own), sum(d in good for d in gone), sum(d in toxic for d in gone), f]
                left = left_now
        for key, x in out.items():
            if key[0] == part:
                x[-1] = shares[x[-1]]
    return out


def by_key(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_audit_equals_orders_one_by_one(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = audited([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert by_key(queries.op13_filter_audit(spark, sf)) == want


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = [(1, 1, 1), (1, 0, None), (None, 1, 1), (5, None, 1), (6, 1, 0), (6, 1, 0), (77, 1, 1)]
    found = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = odd_docs.withColumn("mask", F.lit("mine")).withColumn("digest", F.lit(1))
    want = audited([tuple(r) for r in odd_docs.select("doc_id", "source", "text").collect()], labels)
    assert by_key(filter_audit.audit(filter_audit.masks(docs, found))) == want
    assert filter_audit.audit(filter_audit.masks(no_docs, found)).count() == 0
    assert len(by_key(filter_audit.audit(filter_audit.masks(docs, found.limit(0))))) == len(want)
