"""Conversation repair against dynamic programming over whole audits."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest

from chronoweave.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, seg long, costs string"
GOAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """Rows of one conversation in order -> its result."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by state: the initials matter only by their last one

    def widen(states):
        for _ in range(2):
            for st, (cost, audit, kept) in list(states.items()):
                new = "a" if st == "u" else "u"
                found = (cost + 2, audit + "I", (*kept, ("assistant:" if new == "a" else "user:")))
                if new not in states or found[:2] < states[new][:2]:
                    states[new] = found
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for st, (cost, audit, kept) in widen(best).items():
            options = [("D", 3, st, ())]
            if fault not in ("blank", "duplicate"):
                more, need = fault == "truncated", "a" if st == "u" else "u"
                options.append(("R", 2 + more, need, (("assistant:" if need == "a" else "user:") + text,)))
                if role[:1] == need or (st == "" and role[:1] == "s"):
                    options.append(("K", more, role[:1], (f"{role}:{text}",)))
            for letter, price, to, row in options:
                found = (cost + price, audit + letter, kept + row)
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        best = new
    cost, audit, kept = min((v for st, v in widen(best).items() if st in ("", "a")), key=lambda v: v[:2])
    assert GOAL.fullmatch("".join(x[0] for x in kept))
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def brute(rows):
    left = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        out.append((conv, *repair(own)))
    return sorted(out, key=str)


def talk(rng, conv, n):
    texts = ["Yes.", "No", "Why?", " \t", "", "A longer one!", "cut off, ", "Well. ", "été", None]
    return [(conv, rng.choice([i, i, i, i + 2, None, i // 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Sage"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(60)}.", 0, "") for i in range(n)]


def run(spark, rows, **options):
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("segment", [64, 3])
def test_repairs_are_those_of_dynamic_programming(spark, segment):
    rng = random.Random(segment)
    rows = [r for conv in [*range(300), None] for r in talk(rng, conv, rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
    rows += rows[:40] + [(700, 2, "user", "Same.", 0, "")] * 30
    rng.shuffle(rows)
    assert run(spark, rows, segment=segment) == brute(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(8)
    rows = talk(rng, 5, 900) + [r for conv in range(100, 500) for r in talk(rng, conv, 4)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_empty_and_dropped(spark):
    assert run(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hello.", 0, "")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_auction_prices_are_distances():
    rng = random.Random(2)
    for _ in range(200):
        symbols = "".join(rng.choice("suaSUA-_") for _ in range(rng.randrange(1, 9)))
        arcs, exits = conversations.lattice(symbols), tuple(rng.choice([0, 1, 3, 4, conversations.FAR]) for _ in range(4))
        if min(exits) == conversations.FAR:
            continue
        dist = [conversations.FAR] * (len(arcs) - 4) + list(exits)
        for _ in range(len(arcs)):
            for n in range(len(arcs) - 4):
                dist[n] = min([dist[n], *(c + dist[t] for _, c, t in arcs[n])])
        assert [min(d, conversations.FAR) for d in dist[:4]] == conversations.auction(arcs, exits)[:4]


def test_query_is_its_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = conversations.query(spark, "/root/testdata/sf0.001")
    want = con.execute(conversations.SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
