"""Merge learning and replay against a plain loop over Python lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sidforge.operators import joins, merges


def naive_merge(word, a, b, sym):
    out = list(word)
    at = 0
    while at + 1 < len(out):
        if out[at : at + 2] == [a, b]:
            out[at : at + 2] = [sym]
        at += 1
    return out


def naive_learn(freq, v_mem, min_count):
    words = [(list(w), n) for w, n in freq.items()]
    rules = []
    while len(rules) < v_mem:
        counts = Counter()
        for w, n in words:
            for pair in zip(w, w[1:]):
                counts[pair] += n
        if not counts:
            break
        n, pair = max((n, p) for p, n in counts.items())
        if n < min_count:
            break
        sym = f"<m_{len(rules) + 1}>"
        rules.append((*pair, sym))
        words = [(naive_merge(w, *pair, sym), n) for w, n in words]
    return rules


def naive_replay(word, rules):
    """Always the lowest-ranked pair present, leftmost first."""
    ranks = {(a, b): i for i, (a, b, _) in enumerate(rules)}
    word, made = list(word), []
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks]
        if not found:
            return made
        rank, at = min(found)
        word[at : at + 2] = [rules[rank][2]]
        if rules[rank][2] not in made:
            made.append(rules[rank][2])


def random_corpus(seed, letters, length, words):
    rng = random.Random(seed)
    freq = Counter()
    for _ in range(words):
        size = rng.randint(1, length)
        freq[tuple(rng.choice(letters) for _ in range(size))] += rng.randint(1, 6)
    return dict(freq)


def frame(spark, freq):
    return spark.createDataFrame([(list(w), n) for w, n in freq.items()], "seq array<string>, n bigint")


def merged(spark, words, a, b):
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "k int, seq array<string>")
    rows = df.select("k", merges.merge_pair("seq", f"'{a}'", f"'{b}'", "'M'").alias("s")).orderBy("k")
    return [r.s for r in rows.collect()]


def test_merge_is_greedy_from_the_left(spark):
    words = ["xxx", "xxxx", "x", "", "axxb", "xxxxx"]
    assert merged(spark, words, "x", "x") == [naive_merge(list(w), "x", "x", "M") for w in words]
    rng = random.Random(0)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert merged(spark, words, "a", "b") == [naive_merge(list(w), "a", "b", "M") for w in words]


def test_overlapping_pairs_all_count(spark):
    rows = merges.pair_counts(frame(spark, {("x", "x", "x"): 3, ("y",): 9})).collect()
    assert [tuple(r) for r in rows] == [("x", "x", 6)]


def test_largest_pair_wins_a_tie(spark):
    pairs = merges.pair_counts(frame(spark, {("a", "b"): 5, ("a", "c"): 5, ("b", "a"): 4}))
    assert tuple(merges.best_pair(pairs, 5).first()) == (5, "a", "c")
    assert merges.best_pair(pairs, 6).collect() == []


@pytest.mark.parametrize(
    "seed, letters, length, words, v_mem, least",
    [
        (1, "abcd", 6, 60, 200, 2),
        (2, "ab", 8, 40, 30, 1),
        (3, "abcdefgh", 4, 150, 25, 5),
        (4, ["<a_1>", "<a_2>", "<b_1>", "<b_2>", "<c_1>", "<c_2>", "<n_1>", "<z'\\>"], 4, 200, 40, 3),
    ],
)
@pytest.mark.parametrize("head", [4, 256])
def test_rules_equal_one_merge_at_a_time(spark, seed, letters, length, words, v_mem, least, head):
    freq = random_corpus(seed, letters, length, words)
    wanted = naive_learn(freq, v_mem, least)
    rules, corpus, reason = merges.learn_merges(frame(spark, freq), v_mem, least, head)
    assert rules == wanted
    assert reason == ("v_mem reached" if len(wanted) == v_mem else "no pair >= min_count")
    by_learning = {tuple(r.seq): list(r.produced) for r in corpus.collect()}
    assert by_learning == {w: naive_replay(w, wanted) for w in freq}
    replayed = merges.apply_merges(frame(spark, freq), rules).collect()
    assert {tuple(r.seq): list(r.produced) for r in replayed} == by_learning


def exact_bounds(freq, pairs):
    around = {p: Counter() for p in pairs}
    for w, n in freq.items():
        for i, p in enumerate(zip(w, w[1:])):
            if p in around:
                if i:
                    around[p]["before", w[i - 1]] += n
                if i + 2 < len(w):
                    around[p]["after", w[i + 2]] += n
    return {p: max(c.values()) for p, c in around.items() if c}


def test_bounds_and_batches_hold_on_many_corpora(spark):
    """The pairs taken together are those that single merges would take in turn."""
    taken = 0
    for seed in range(400):
        rng = random.Random(seed)
        letters = [f"<{c}_{i}>" for c in "abc" for i in range(rng.randint(2, 6))]
        freq = random_corpus(seed, letters, rng.randint(2, 6), rng.randint(5, 120))
        counts = Counter()
        for w, n in freq.items():
            for p in zip(w, w[1:]):
                counts[p] += n
        ranked = sorted(((n, *p) for p, n in counts.items()), reverse=True)
        if not ranked:
            continue
        size = rng.choice([3, 10, 256])
        head = ranked[:size]
        last = head[-1][0] if len(ranked) >= size else 0
        chosen = merges.independent_head(
            head, exact_bounds(freq, {p[1:] for p in head}), last, rng.choice([2, 5, 50])
        )
        wanted = naive_learn(freq, len(chosen), 1)
        assert [p[1:] for p in chosen] == [r[:2] for r in wanted]
        taken += len(chosen) > 1
    assert taken > 50
    freq = random_corpus(9, "abcd", 6, 80)
    pairs = [("a", "b"), ("c", "c"), ("d", "a"), ("q", "q")]
    found = merges.neighbour_bounds(frame(spark, freq), pairs).collect()
    assert {(r.a, r.b): r.bound for r in found} == exact_bounds(freq, set(pairs))


def test_expansion():
    rules = [("b", "c", "<m_1>"), ("a", "<m_1>", "<m_2>")]
    assert merges.expand(rules) == {"<m_1>": "bc", "<m_2>": "abc"}


def test_new_sequences_and_lookup(spark):
    freq = {("a", "b", "c"): 20, ("a", "b", "d"): 15, ("e", "f", "g"): 1}
    rules, corpus, _ = merges.learn_merges(frame(spark, freq), 10, 10)
    table = merges.seq_mem_table(corpus, ["code_0", "code_1", "code_2"])
    rows = spark.createDataFrame(
        [("a", "b", "c"), ("a", "b", "d"), ("e", "f", "g"), ("a", "b", "z")],
        "code_0 string, code_1 string, code_2 string",
    )
    looked = {tuple(r)[:3]: r.mem_sid for r in joins.lookup_mem(rows, table, rows.columns).collect()}
    assert looked == {
        ("a", "b", "c"): "<m_1><m_2>", ("a", "b", "d"): "<m_1><m_3>", ("e", "f", "g"): "", ("a", "b", "z"): "",
    }
    # A sequence outside the corpus is not looked up, but it can be replayed.
    fresh = merges.apply_merges(rows.select(F.array(*rows.columns).alias("seq")), rules)
    made = {tuple(r.seq): "".join(r.produced) for r in fresh.collect()}
    assert made["a", "b", "z"] == "<m_1>"
    assert merges.mem_totals(corpus).first() == (36, 35, 1)
    shares = {r.sym: r.items_with for r in merges.mem_coverage(corpus).collect()}
    assert shares == {"<m_1>": 35, "<m_2>": 20, "<m_3>": 15}


def test_one_gen_column_has_no_mem(spark):
    rows = spark.createDataFrame([("a",)], "code_0 string")
    assert joins.lookup_mem(rows, rows, ["code_0"]).first().mem_sid == ""
    rules, corpus, reason = merges.learn_merges(merges.seq_freq(rows, ["code_0"]), 10, 1)
    assert rules == [] and reason == "no pair >= min_count"
    assert merges.rules_table(spark, rules).count() == 0
    assert merges.mem_coverage(corpus).collect() == []
