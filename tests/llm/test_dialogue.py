"""Conversation repair against a search over all edits."""

import itertools
import random
import re
import zlib

import plain
import pytest

from sidforge.llm import dialogue, queries
from sidforge.llm.common import WHITE

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def exhaustive(rows):
    """(cost, audit, repaired) by trying every edit of every row, with up to two inserts before each."""
    ways = [(0, "", ())]
    for (role, text), fault in [*zip(rows, faults(rows)), ((None, None), None)]:
        put = [(3 * n, "I" * n, tuple((r, "") for r in roles)) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
        own = [(0, "", ())]
        if role is not None:
            own = [(4, "D", ())]
            if fault in ("", "truncated"):
                own += [(3 * (fault != ""), "K", ((role, text),))]
                own += [(3 + 3 * (fault != ""), "R", ((r, text),)) for r in ("user", "assistant")]
        ways = [(a + b + c, x + y + z, p + q + r) for a, x, p in ways for b, y, q in put for c, z, r in own]
        # What cannot become legal any more.
        ways = [w for w in ways if all(r for r, _ in w[2]) and re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in w[2]))]
    legal = [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[2]))]
    return min(legal, key=lambda w: (w[0], w[1]))


def simple(rows):
    """The same by whole strings for each state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    at = {"": (0, "", ())}

    def inserted(at):
        for _ in range(4):
            for state, (cost, audit, out) in list(at.items()):
                for role in ("user", "assistant"):
                    to = step[state].get(role[0])
                    if to:
                        at[to] = min(at.get(to, (1 << 60,)), (cost + 3, audit + "I", (*out, (role, ""))))
        return at

    at = inserted(at)
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(to, way):
            new[to] = min(new.get(to, (1 << 60,)), way)

        for state, (cost, audit, out) in at.items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if role and role[0] in step[state]:
                offer(step[state][role[0]], (cost + extra, audit + "K", (*out, (role, text))))
            for other in ("user", "assistant"):
                if other[0] in step[state]:
                    offer(step[state][other[0]], (cost + extra + 3, audit + "R", (*out, (other, text))))
        at = inserted(new)
    return min((at[s] for s in ("", "a") if s in at), key=lambda w: w[:2])


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, search=simple, hurt=True):
    out = []
    kept = damaged(rows) if hurt else rows
    for conv in {r[0] for r in rows}:
        own = [r for r in kept if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [r[2:] for r in own]
        found = faults(pairs)
        cost, audit, repaired = search(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = plain.sha("\n".join(f"{r}:{t}" for r, t in repaired))
        out.append((conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


TEXTS = ["Yes.", "No!", "So?", "cut off", "", " \t", "Yes.", "one two."]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "Unknown"]


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    return [
        (conv, turn, rng.choice(ROLES), rng.choice(TEXTS) + (str(rng.randrange(9)) + "." if rng.random() < 0.5 else ""))
        for conv in range(conversations)
        for turn in range(rng.randint(1, longest))
    ]


def test_search_equals_trying_all_edits():
    for rows in (random_rows(seed, 1, 3) for seed in range(250)):
        pairs = [r[2:] for r in rows]
        assert exhaustive(pairs) == simple(pairs)


def kinds_of(pairs):
    return "".join(dialogue.kind_of(dialogue.FAULTS.index(f), max(0, dialogue.INITIALS.find(r[:1] or "?"))) for (r, _), f in zip(pairs, faults(pairs)))


def test_survivors_equal_whole_strings():
    for seed in range(400):
        pairs = [r[2:] for r in random_rows(seed, 1, 40)]
        assert dialogue.solve(kinds_of(pairs)) == simple(pairs)[1]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pieces_join_to_the_same_edits(size):
    for seed in range(200):
        kinds = kinds_of([r[2:] for r in random_rows(seed, 1, 30)])
        cut = [(i, kinds[i : i + size], dialogue.transfers(kinds[i : i + size])) for i in range(0, len(kinds), size)]
        joined = list(dialogue.join_pieces(cut))
        assert [j[:2] for j in joined] == [c[:2] for c in cut]
        assert "".join(j[3] for j in joined) == dialogue.solve(kinds)


def test_memory_follows_the_unresolved_stretch():
    rng = random.Random(3)
    search, most = dialogue.Survivors(dialogue.START, True), 0
    for _ in range(30_000):
        search.step(dialogue.MOVES[rng.choice("bcdbcdcdcdfgj")])
        search.drain()
        most = max(most, sum(len(search.path(n)) for _, n in search.at.values()))
    assert most < 400


@pytest.mark.parametrize("block", [3, dialogue.BLOCK_ROWS])
def test_random_conversations(spark, block):
    rows = random_rows(11, 60, 12) + [(900, t, r, f"turn {t // 3}{'.' * (t % 2)}") for t, r in zip(range(500), itertools.cycle(ROLES))]
    script = dialogue.repair(spark.createDataFrame(rows, SCHEMA), block)
    got = dialogue.report(script, spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, hurt=False)


def test_edges(spark):
    rows = [
        (1, None, "user", "b."), (1, None, "user", "a."), (1, 7, None, None), (1, 3, "assistant", "x."),
        (2, 1, None, None), (3, None, "user", None), (None, 1, "user", "Hm?"), (None, 2, "assistant", "Yes."),
        (4, 0, "system", "Be brief. " * 200_000), (4, 1, "user", "long " * 300_000 + "?"), (4, 2, "assistant", "ok."),
        *[(5, 1, "user", "copy.")] * 40, (6, 1, "user", "a\u0085"), (6, 2, "assistant", "b.\u00a0"),
    ]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "2 as edit", "3 as _pos", "4 as Kind", "5 as _salt")
    hurt = dialogue.damage(clash)
    got = dialogue.report(dialogue.repair(hurt, 4), clash)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    none = clash.where("false")
    assert dialogue.report(dialogue.repair(dialogue.damage(none)), none).count() == 0


def test_script_holds_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "b."), (1, 2, "user", ""), (2, 0, "user", "q?")]
    script = dialogue.repair(spark.createDataFrame(rows, SCHEMA)).where("edit <> 'D'").orderBy("start", "step").collect()
    assert [(r.conv_id, r.edit, r.new_role, r.text) for r in script] == [
        (1, "R", "user", "a."), (1, "K", "assistant", "b."), (2, "K", "user", "q?"), (2, "I", "assistant", None),
    ]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversations"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
