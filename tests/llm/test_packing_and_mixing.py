"""Containers and mixes: hard limits, fill, shares, and the cases of the docstrings."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing, packing
from tidemill.llm.mixing import Leaf, budget
from tidemill.llm.tokens import VOCABULARY, encoding, token_count


def contents(placements):
    bins, ranks = defaultdict(list), defaultdict(set)
    for p in placements:
        for r in range(p.first, p.first + p.count):
            assert r not in ranks[p.size]
            ranks[p.size].add(r)
            bins[p.container + (r - p.first) // p.each].append(p.size)
    return bins, {s: len(r) for s, r in ranks.items()}


def test_plans_hold_everything_once_and_nothing_twice():
    rng = random.Random(2)
    for _ in range(1500):
        capacity = rng.randint(1, 40)
        histogram = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 12))}
        bins, placed = contents(packing.plan(histogram, capacity))
        assert placed == histogram and all(sum(b) <= capacity for b in bins.values()) and sorted(bins) == list(range(1, len(bins) + 1))
        assert all(sum(3 * s > capacity for s in b) <= 2 for b in bins.values())


def test_plan_fills_well_and_does_not_grow_with_the_data():
    rng = random.Random(3)
    histogram = Counter(min(1000, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(50_000))
    bins, _ = contents(packing.plan(histogram, 1000))
    assert sum(s * n for s, n in histogram.items()) / (len(bins) * 1000) > 0.99
    assert len(packing.plan({s: n * 10**6 for s, n in histogram.items()}, 1000)) < 12 * len(histogram)
    assert packing.plan({6: 3, 5: 2, 4: 4, 1: 2}, 10) and len(contents(packing.plan({6: 3, 4: 3}, 10))[0]) == 3
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ITEMS", 50)  # a frequent size goes through many slices
    rng = random.Random(4)
    rows = [(i, rng.choice([7, 7, 7, 1, 50, 51, 99, 100, 101, 250, 0, None])) for i in range(2000)] + [(5, 7), (5, 7)]
    df = spark.createDataFrame(rows, "doc long, n long").withColumns({"size": F.lit("x"), "item": F.lit("y"), "slice": F.lit(1)})
    packed = packing.pack(df, "doc", "n", 100)
    got = packed.collect()
    filled = Counter()
    for r in got:
        filled[r.container_no] += r.size
    assert max(filled.values()) <= 100 and sorted(filled) == list(range(1, len(filled) + 1))
    assert Counter((r.item, r.piece_no) for r in got if r.n_pieces == 1) == Counter((i, 1) for i, n in rows if n and n <= 100)
    assert {r.item for r in got if r.n_pieces > 1} == {i for i, n in rows if n and n > 100}
    assert sum(r.size for r in got) == sum(n or 0 for _, n in rows)
    report = packing.fill(packed, 100).first()
    assert report.containers == len(filled) and report.fill == pytest.approx(report.tokens / 100 / report.containers) and report.fill > 0.9
    assert sorted(map(tuple, packing.pack(df.repartition(3), "doc", "n", 100).collect())) == sorted(map(tuple, got))


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "doc string, n int")
    packed = packing.pack(empty, "doc", "n", 10)
    assert packed.count() == 0 and tuple(packing.fill(packed, 10).first()) == (0, 0, None)


def test_token_counts(spark):
    texts = ["", None, "Hello world", "<|endoftext|>", "é日本" * 2000, "a" * 1_000_000, " \n\t ", "�"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    plain = encoding(VOCABULARY)
    assert got == [len(plain.encode_ordinary(t or "")) for t in texts] and got[:3] == [0, 0, 2] and got[3] > 1


# --- mixing


def leaf(path, share, repeats, size):
    domain, language, source = path.split("/")
    return Leaf(domain, language, source, share, repeats, size, size // 10, share)


def test_budgets_go_to_siblings_first():
    leaves = budget([leaf("w/en/a", 0.4, 1, 100), leaf("w/en/b", 0.1, 9, 100), leaf("w/de/c", 0.2, 9, 100), leaf("x/en/d", 0.3, 9, 1000)], 1000)
    by = {x.source: x.budget for x in leaves}
    assert by == pytest.approx({"a": 100, "b": 400, "c": 200, "d": 300})  # b takes all that a lacks
    assert [(x.source, x.unmet) for x in leaves if x.unmet] == [("a", pytest.approx(300))]
    leaves = budget([leaf("w/en/a", 0.4, 1, 100), leaf("w/en/b", 0.1, 2, 100), leaf("w/de/c", 0.2, 4, 100), leaf("x/en/d", 0.3, 9, 1000)], 1000)
    assert {x.source: x.budget for x in leaves} == pytest.approx({"a": 100, "b": 200, "c": 400, "d": 300})  # then c, of the same domain
    leaves = budget([leaf("w/en/a", 0.5, 1, 100), leaf("w/en/b", 0.2, 1, 100), leaf("x/en/d", 0.3, 9, 1000), leaf("x/en/e", 0.0, 9, 1000)], 1000)
    assert {x.source: x.budget for x in leaves} == pytest.approx({"a": 100, "b": 100, "d": 800, "e": 0})  # then another domain, never weight 0
    leaves = budget([leaf("w/en/a", 0.5, 1, 10), leaf("w/en/b", 0.5, 1, 0)], 1000)
    assert {x.source: x.budget for x in leaves} == pytest.approx({"a": 10, "b": 0})  # nobody left to take it
    assert budget([], 5) == []


def documents(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big"] * 5 + ["mid", "small", "free", None]), "com", rng.choice(["en", "de", None]), rng.choice([None, 0, *range(1, 40)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, domain string, language string, size long").withColumns({"uses": F.lit(9), "bucket": F.lit(9), "whole": F.lit(9)})


TARGETS = [("big", 0.3, 2), ("mid", 0.4, 9), ("small", 0.3, 1), ("absent", 0.0, 3), ("none", None, None)]


@pytest.mark.parametrize("bucket", [65_536, 16])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", bucket)
    rows, docs = documents(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    m = mixing.mix(docs, targets, seed=3)
    chosen = m.chosen.collect()
    size, repeats = {r[0]: r[4] or 0 for r in rows}, {t[0]: t[2] for t in TARGETS}
    assert m.total == sum(size.values()) and len({r.doc_id for r in chosen}) == len(chosen)
    reached, uses = defaultdict(int), defaultdict(set)
    for r in chosen:
        assert 1 <= r.uses <= repeats[r.source] and r.size == size[r.doc_id]
        reached[r.source, r.language] += r.uses * r.size
    times = {r.doc_id: r.uses for r in chosen}
    for i, s, _, lang, _ in rows:
        uses[s, lang or ""].add(times.get(i, 0)) if s in ("big", "mid", "small") else None
    assert all(max(u) - min(u) <= 1 for u in uses.values())
    assert len(m.leaves) == 11 and {(r.language, r.source): r.reached for r in mixing.leaf_shares(m).where("reached > 0").collect()} == {(b, a): n for (a, b), n in reached.items()}
    for x in m.leaves:
        assert abs(reached[x.source, x.language] - x.budget) <= 20
    assert abs(sum(reached.values()) - m.total) <= 3 * 20  # one leaf of each language is off by itself
    assert {r.source for r in mixing.shortages(m.leaves, docs, m.total).collect()} == {"small"}
    shares = {r.source: r for r in mixing.shares(m).collect()}
    assert sum(r.share for r in shares.values()) == pytest.approx(1) and shares["absent"].reached == 0
    again = {(r.doc_id, r.uses) for r in mixing.mix(docs.repartition(3), targets, seed=3).chosen.collect()}
    assert again == {(r.doc_id, r.uses) for r in chosen} != {(r.doc_id, r.uses) for r in mixing.mix(docs, targets, seed=4).chosen.collect()}


def test_level():
    assert mixing.level(100, [1, 1, 2], [10, 99, 99]) == [10, 30, 60] and mixing.level(100, [1, 1], [5, 6]) == [5, 6] and mixing.level(0, [1], [5]) == [0.0] == mixing.level(9, [0], [5])
    rng = random.Random(4)
    for _ in range(200):
        n, amount = rng.randrange(1, 9), rng.random() * 100
        weights, rooms = [rng.random() for _ in range(n)], [rng.random() * 40 for _ in range(n)]
        got = mixing.level(amount, weights, rooms)
        assert sum(got) == pytest.approx(min(amount, sum(rooms))) and all(g <= r + 1e-9 for g, r in zip(got, rooms))
        rates = [g / w for g, w, r in zip(got, weights, rooms) if g < r - 1e-9]  # the open ones are level, and none of the full ones has more
        assert not rates or (max(rates) - min(rates) < 1e-6 and all(g / w <= rates[0] + 1e-6 for g, w in zip(got, weights)))


def test_prefix_errors_go_to_the_largest_sibling():
    leaves = budget([leaf("w/en/a", 0.2, 9, 100), leaf("w/en/b", 0.3, 9, 900), leaf("w/de/c", 0.5, 9, 500)], 1000)
    mixing.hand_on(leaves, {("w", "en", "a"): 230.0, ("w", "en", "b"): 310.0, ("w", "de", "c"): 490.0})
    assert {x.source: x.budget for x in leaves} == pytest.approx({"a": 200, "b": 280, "c": 500})  # b by what a is off, and by what c is, alone in its language
    assert mixing.hand_on([], {}) == []


def test_the_source_settles_what_fractions_do_not(spark):
    """A share that is reached to the last token is reached, one that lacks a token is not, however many leaves the source has."""
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], "pqrst"[i % 5], 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, domain string, language string, size long")
    for share, short in ((0.5, set()), (0.5 + 1e-9, {"a"})):
        targets = spark.createDataFrame([("a", share, 1), ("b", 1 - share, 1)], "source string, target_share double, max_repeats long")
        _, leaves, total = mixing.measure(docs, targets)
        assert {r.source for r in mixing.shortages(leaves, docs, total).collect()} == short and len(leaves) == 30


def test_mix_of_nothing(spark):
    _, docs = documents(spark, n=5)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    m = mixing.mix(docs.limit(0), targets)
    assert m.chosen.count() == 0 and m.total == 0 and mixing.shares(m).count() == 5 and mixing.shortages(m.leaves, docs, m.total).count() == 0
    m = mixing.mix(docs, targets.limit(0))
    assert m.chosen.count() == 0 and mixing.shares(m).count() == 0
