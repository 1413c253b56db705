"""Frequent neighbours among code tokens, merged into new symbols.

The corpus is one row per distinct token sequence with its number of items, so
a sequence shared by a third of the items costs as much as any other. Only the
head of the pair counts and the merge rules reach the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sidforge.session import materialize

# Form of a merge symbol, numbered from 1, and default limits.
SYMBOL = "<m_{}>"
V_MEM = 200
MIN_COUNT = 10
RULE_SCHEMA = "rank int, a string, b string, sym string, expansion string"
# Pairs read per counting pass. Several of them can be merged at once.
HEAD = 256
# Counting passes between two written corpora.
PASSES_PER_WRITE = 8


def seq_freq(df: DataFrame, gen_cols: list[str]) -> DataFrame:
    """Distinct token sequences and their number of items."""
    counts = df.groupBy(*gen_cols).agg(F.count("*").alias("n"))
    return counts.select(F.array(*gen_cols).alias("seq"), "n")


def pair_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Neighbouring pairs and the items they occur in, every occurrence counted."""
    pairs = (
        f"inline(arrays_zip(slice({seq}, 1, size({seq}) - 1), slice({seq}, 2, size({seq}) - 1))) "
        "as (a, b)"
    )
    return seqs.where(f"size({seq}) > 1").selectExpr(pairs, "n").groupBy("a", "b").agg(
        F.sum("n").alias("n")
    )


def best_pair(pairs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """The most frequent pair, the lexicographically largest on ties; no row when
    it occurs fewer than ``min_count`` times."""
    top = pairs.agg(F.max(F.struct("n", "a", "b")).alias("top")).select("top.*")
    return top.where(F.col("n") >= min_count)


def merge_pair_sql(seq: str, a: str, b: str, sym: str) -> str:
    """One fold over ``seq``: a token that completes the pair replaces the token
    before it. ``sym`` never equals ``a``, so a replaced token starts no pair."""
    completes = f"token = {b} and try_element_at(done, -1) = {a}"
    replaced = f"concat(slice(done, 1, size(done) - 1), array({sym}))"
    fold = f"if({completes}, {replaced}, concat(done, array(token)))"
    return f"aggregate({seq}, cast(array() as array<string>), (done, token) -> {fold})"


def merge_pair(seq: str, a: str, b: str, sym: str) -> Column:
    """Replace the pair by ``sym`` from left to right without overlap.

    ``seq`` and the pair and symbol are column names or SQL literals.
    """
    return F.expr(merge_pair_sql(seq, a, b, sym))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add the rules as one constant array column ``_rules``."""
    text = json.dumps([{"a": a, "b": b, "s": s} for a, b, s in rules])
    kind = "array<struct<a:string,b:string,s:string>>"
    return df.withColumn("_rules", F.from_json(F.lit(text), kind))


def replay(df: DataFrame, seq: str, produced: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``_state``: the sequence after all rules and the symbols made on the way.

    Applying rules in rank order equals always taking the lowest rank present,
    because a merge can enable only later rules.
    """
    merged = merge_pair_sql("st.cur", "r.a", "r.b", "r.s")
    made = "if(array_contains(cur, r.s), concat(st.produced, array(r.s)), st.produced)"
    after = (
        f"transform(array({merged}), cur -> named_struct('cur', cur, 'produced', {made}))[0]"
    )
    present = "array_contains(st.cur, r.a) and array_contains(st.cur, r.b)"
    start = f"named_struct('cur', {seq}, 'produced', {produced})"
    fold = f"aggregate(_rules, {start}, (st, r) -> if({present}, {after}, st))"
    return with_rules(df, rules).withColumn("_state", F.expr(fold)).drop("_rules")


def bounded_pairs(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """``(a, b, n, bound)``: pairs as :func:`pair_counts` counts them, and the most items in which
    one same token stands before, or one same token stands after, the pair.

    After merging the pair no new pair can be more frequent than its bound. One pass gives
    both numbers.
    """
    place = (
        f"struct(element_at({seq}, i) as a, element_at({seq}, i + 1) as b, array("
        "struct('pair' as side, '' as token), "
        f"struct('before' as side, get({seq}, i - 2) as token), "
        f"struct('after' as side, get({seq}, i + 1) as token)) as sides)"
    )
    found = seqs.where(f"size({seq}) > 1").selectExpr(
        f"inline(transform(sequence(1, size({seq}) - 1), i -> {place}))", "n"
    )
    counts = (
        found.selectExpr("a", "b", "inline(sides)", "n")
        .where("token is not null")
        .groupBy("a", "b", "side", "token")
        .agg(F.sum("n").alias("n"))
    )
    whole = F.col("side") == "pair"
    return counts.groupBy("a", "b").agg(
        F.max(F.when(whole, F.col("n"))).alias("n"),
        F.coalesce(F.max(F.when(~whole, F.col("n"))), F.lit(0)).alias("bound"),
    )


def neighbour_bounds(seqs: DataFrame, head: list[tuple[str, str]], seq: str = "seq") -> DataFrame:
    """``(a, b, bound)`` of the pairs in ``head`` that have a neighbour."""
    wanted = seqs.sparkSession.createDataFrame(head, "a string, b string")
    found = bounded_pairs(seqs, seq).where("bound > 0").select("a", "b", "bound")
    return found.join(F.broadcast(wanted), ["a", "b"], "left_semi")


def independent_head(
    head: list[tuple[int, str, str]], bounds: dict[tuple[str, str], int], last: int, room: int
) -> list[tuple[int, str, str]]:
    """The leading pairs that successive single merges would pick in this order.

    ``head`` is sorted best first; pairs outside it count at most ``last``.
    Merging (a, b) leaves the count of (c, d) unchanged when c is not b and d is
    not a, lowers other old pairs, and makes new pairs of at most ``bounds[a, b]``
    items. A candidate therefore comes next if it is untouched by the pairs
    chosen before it and more frequent than any pair they can create.
    """
    chosen: list[tuple[int, str, str]] = []
    firsts: set[str] = set()
    seconds: set[str] = set()
    rival = last
    for n, a, b in head:
        if len(chosen) == room:
            break
        if chosen and (a in seconds or b in firsts or n <= rival):
            break
        chosen.append((n, a, b))
        firsts.add(a)
        seconds.add(b)
        rival = max(rival, bounds.get((a, b), 0))
    return chosen


def learn_merges(
    seqs: DataFrame, v_mem: int = V_MEM, min_count: int = MIN_COUNT, head: int = HEAD
) -> tuple[list[tuple[str, str, str]], DataFrame, str]:
    """Merge rules in rank order, the corpus after them, and why learning stopped.

    The corpus keeps ``seq``, its merged form ``cur``, the symbols ``produced``
    and ``n``.
    """
    base = materialize(
        seqs.selectExpr("seq", "seq as cur", "cast(array() as array<string>) as produced", "n"),
        "corpus",
    )
    rules: list[tuple[str, str, str]] = []
    pending: list[tuple[str, str, str]] = []
    passes = 0
    reason = "v_mem reached"

    def current() -> DataFrame:
        if not pending:
            return base
        state = replay(base, "cur", "produced", pending)
        return state.selectExpr("seq", "_state.cur", "_state.produced", "n")

    while len(rules) < v_mem:
        pairs = bounded_pairs(current(), "cur").where(F.col("n") >= min_count)
        rows = pairs.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(head).collect()
        if not rows:
            reason = "no pair >= min_count"
            break
        ranked = [(r.n, r.a, r.b) for r in rows]
        bounds = {(r.a, r.b): r.bound for r in rows}
        # With room in the head, all other pairs are below min_count.
        last = ranked[-1][0] if len(rows) == head else 0
        for _, a, b in independent_head(ranked, bounds, last, v_mem - len(rules)):
            rule = (a, b, SYMBOL.format(len(rules) + 1))
            rules.append(rule)
            pending.append(rule)
        passes += 1
        if passes % PASSES_PER_WRITE == 0:
            base = materialize(current(), "corpus", replaces=base)
            pending = []
    return rules, current(), reason


def expand(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    """Symbol to the base tokens it stands for."""
    return reduce(
        lambda known, r: {**known, r[2]: known.get(r[0], r[0]) + known.get(r[1], r[1])}, rules, {}
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table with rank and expansion."""
    known = expand(rules)
    rows = [(rank, a, b, sym, known[sym]) for rank, (a, b, sym) in enumerate(rules)]
    return spark.createDataFrame(rows, T._parse_datatype_string(RULE_SCHEMA))


def apply_merges(df: DataFrame, rules: list[tuple[str, str, str]], seq: str = "seq") -> DataFrame:
    """Add ``produced``: every symbol made while replaying the rules on ``seq``."""
    state = replay(df, seq, "cast(array() as array<string>)", rules)
    return state.withColumn("produced", F.col("_state.produced")).drop("_state")


def mem_sid(produced: str = "produced") -> Column:
    """Produced symbols joined, empty when there are none."""
    return F.concat_ws("", produced)


def seq_mem_table(corpus: DataFrame, gen_cols: list[str]) -> DataFrame:
    """Distinct sequences with their ``mem_sid`` and number of items, one column
    per token."""
    tokens = [F.col("seq")[i].alias(c) for i, c in enumerate(gen_cols)]
    return corpus.select(*tokens, mem_sid().alias("mem_sid"), "n")


def mem_coverage(corpus: DataFrame) -> DataFrame:
    """Items per symbol and their share of all items.

    The empty symbol, counted for every sequence, carries the total.
    """
    symbols = F.concat(F.array(F.lit("")), F.col("produced"))
    counts = (
        corpus.select(F.explode(symbols).alias("sym"), "n")
        .groupBy("sym")
        .agg(F.sum("n").alias("items_with"))
    )
    # At most one row per rule from here on.
    items = F.max(F.when(F.col("sym") == "", F.col("items_with"))).over(W.partitionBy(F.lit(0)))
    return counts.withColumn("ratio", F.col("items_with") / items).where("sym <> ''")


def mem_totals(corpus: DataFrame) -> DataFrame:
    """One row: items, items with any symbol, items without."""
    owned = F.coalesce(F.sum(F.when(F.size("produced") > 0, F.col("n"))), F.lit(0))
    return corpus.agg(
        F.sum("n").alias("items"), owned.alias("with_mem"), (F.sum("n") - owned).alias("without_mem")
    )
