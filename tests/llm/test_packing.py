import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 4), min_size=1, max_size=6))
def test_fill_is_the_best_multiset(room, counts):
    left = np.array([0, *counts] + [0] * 40)
    sizes = [s for s in range(len(left) - 1, 0, -1) if left[s]]
    got = packing.fill(room, left, sizes)
    best = max(t for t in (sum(s * m for s, m in zip(range(1, 7), pick, strict=False)) for pick in product(*[range(c + 1) for c in counts])) if t <= room)
    assert sum(s * m for s, m in got.items()) == best and all(m <= left[s] for s, m in got.items())


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=80))
def test_plan_uses_each_item_once(capacity, items):
    items = [min(i, capacity) for i in items]
    left = np.bincount(items, minlength=capacity + 1)
    used = np.zeros(capacity + 1, int)
    n = 0
    for times, filling in packing.plan(capacity, left):
        assert sum(s * m for s, m in filling.items()) <= capacity and times > 0
        n += times
        for s, m in filling.items():
            used[s] += m * times
    assert (used == left).all()
    assert n <= max(1, 2 * -(-sum(items) // capacity)) if items else n == 0


def check(got, sizes, capacity):
    pieces = {}
    load = {}
    for r in got:
        pieces.setdefault(r.doc_id, {})[r.piece_no] = r.n_tokens
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert set(pieces) == set(sizes) and all(v <= capacity for v in load.values())
    assert sorted(load) == list(range(1, len(load) + 1))
    for d, n in sizes.items():
        p = pieces[d]
        assert sorted(p) == list(range(len(p))) and sum(p.values()) == n
        assert len(p) == max(1, -(-n // capacity)) and all(p[i] == capacity for i in range(len(p) - 1))
    return len(load)


@pytest.mark.parametrize("ranked", [10**6, 7, 1])
def test_packing(spark, ranked):
    rng = np.random.default_rng(3)
    sizes = {i: int(x) for i, x in enumerate(np.minimum(rng.lognormal(4, 1.2, 600), 5000))} | {1000: 0, 1001: 0, 1002: 256, 1003: 257, 1004: 1024}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").selectExpr("*", "1 size", "2 slice", "3 offset", "4 pack_id")
    got = packing.pack(df, [(1, 256), (2, 1024)], ranked).collect()
    for p, c in ((1, 256), (2, 1024)):
        n = check([r for r in got if r.pack_id == p], sizes, c)
        assert n <= -(-sum(sizes.values()) // c) + 1


def test_a_third_of_all_items_of_one_size(spark):
    sizes = {i: 100 if i % 3 else 30 + i % 50 for i in range(3000)}
    got = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint"), [(1, 512)], 100).collect()
    assert check(got, sizes, 512) <= sum(sizes.values()) / 512 * 1.02 + 1


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty, [(1, 10)]).collect() == []
    zero = spark.createDataFrame([(1, 0), (2, None), (None, 0)], "doc_id bigint, n_tokens bigint")
    assert [(r.container_id, r.n_tokens) for r in packing.pack(zero, [(1, 10)]).collect()] == [(1, 0)] * 3
    twice = spark.createDataFrame([(1, 6), (1, 6), (None, 4)], "doc_id bigint, n_tokens bigint")
    assert sorted(r.container_id for r in packing.pack(twice, [(1, 10)]).collect()) == [1, 1, 2]


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world " * 30), (2, None), (3, ""), (4, "one two three")], "doc_id bigint, text string")
    sizes = spark.createDataFrame([(1, 16, "byte_bpe_50k"), (2, 64, "byte_bpe_50k"), (3, 0, "byte_bpe_50k"), (4, 5, None)], "pack_id int, capacity_tokens int, tokenizer string")
    got = packing.pack_documents(docs, sizes).collect()
    assert {(r.pack_id, r.doc_id) for r in got} == {(p, d) for p in (1, 2) for d in (1, 2, 3, 4)}
    assert packing.pack_documents(docs, sizes.limit(0)).collect() == []


def test_plan_of_a_long_capacity_is_tight_and_quick():
    rng = np.random.default_rng(1)
    capacity = 131_072
    left = np.bincount(np.minimum(rng.lognormal(8, 1.5, 200_000).astype(int) + 1, capacity), minlength=capacity + 1)
    began = time.time()
    found = packing.plan(capacity, left)
    assert time.time() - began < 60
    assert sum(n for n, _ in found) <= -(-int((left * np.arange(capacity + 1)).sum()) // capacity) + 1


def test_checks_of_a_packing(spark):
    docs = spark.createDataFrame([(1, "Hello world " * 30), (1, "Hello world " * 30), (2, None), (4, "one two three"), (5, "a b c d " * 200)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([(1, 16, "byte_bpe_50k"), (2, 64, "byte_bpe_50k")], "pack_id int, capacity_tokens int, tokenizer string")
    got = packing.packing_check(docs, sizes).collect()
    assert sorted((r.pack_id, r.documents, r.rows_of_documents, r.overfull, r.broken, r.tight) for r in got) == [(1, 4, 5, 0, 0, True), (2, 4, 5, 0, 0, True)]
