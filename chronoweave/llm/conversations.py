"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``, by the auction algorithm for
shortest paths.

The lattice has a node for each row still to come and each state of the pattern (start, after system, after user, after assistant);
arcs are Keep, Rerole, Delete and Insert at integer costs. The auction keeps a price a node and one path: the path grows along an arc that
its last node's price pays for exactly, else that price rises to the cheapest arc and the path gives the node up. When it reaches the
end, prices are dual optimal: whatever lies on a shortest path is tight, so the least audit is the first letter, again and
again, of the tight arcs from which tight arcs reach the end.

Rows that must go (blank, duplicate) cost the same wherever edits are inserted, and Delete sorts first, so they stand outside the
lattice. Spark sorts all rows by conversation and turn over ranges, so a conversation of any length lies in many tasks; it is worked
in segments of ``SEGMENT`` rows. A segment's auctions give a matrix of costs from state to state; matrices stream backward to give every
segment the prices of its exits, and segments are traced from all four states, of which the forward pass takes one. Only what the
result itself holds in one cell, the audit and the digest of all texts, passes one task, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_room, write_table

SEGMENT, SEGMENT_BYTES = 64, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a needed role, by the state before; costs of edits; letters in the order of ties.
AFTER = (USER, USER, ASSISTANT, USER)
RENAME, DELETE, INSERT = 2, 3, 2
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Cheapest inserts that complete a conversation, by its last state: their costs and letters.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FAR = 1 << 40
BLANK = " \t\n\x0b\x0c\r"
Arc = tuple[str, int, int]


def lattice(symbols: str) -> list[list[Arc]]:
    """The arcs (letter, cost, target) of each node, in the order of letters; node 4 i + state. symbols: a role's initial a row (``-`` for
    any other), in capitals (``_``) where the text is cut off."""
    arcs: list[list[Arc]] = []
    for i, c in enumerate(symbols):
        cut = int(c in "SUA_")
        for state in range(4):
            here, there = 4 * i, 4 * i + 4
            out = [("D", DELETE, there + state), ("I", INSERT, here + AFTER[state])]
            if (to := KEEPS.get((state, c.lower()))) is not None:
                out.append(("K", cut, there + to))
            arcs.append([*out, ("R", RENAME + cut, there + AFTER[state])])
    return arcs + [[] for _ in range(4)]


def auction(arcs: list[list[Arc]], exits: tuple[int, ...]) -> list[int]:
    """Prices after auctions from the four first nodes to an end that the last four reach at the costs ``exits`` (FAR: not at all).
    The prices of the first four are their distances; every arc of a shortest path from them is tight."""
    last, price = len(arcs) - 4, [0] * len(arcs)
    for k, cost in enumerate(exits):
        price[last + k] = cost  # an exit has one arc, so its price is that arc's
    live = [n for n in range(last, len(arcs)) if price[n] < FAR]
    reach = set(live)
    for n in range(last - 1, -1, -1):  # nodes without a way to the end take no part, else their prices would rise for ever
        if any(t in reach for letter, _, t in arcs[n] if letter != "I"):
            reach.add(n)
        if n % 4 == 0:
            for _ in range(2):
                reach.update(m for m in range(n, n + 4) if any(t in reach for letter, _, t in arcs[m] if letter == "I"))
    ways = [[(cost, t) for _, cost, t in arcs[n] if t in reach] for n in range(last)]
    for origin in range(4):
        if origin not in reach:
            price[origin] = FAR
            continue
        path = [origin]
        while path[-1] < last:
            n = path[-1]
            best, target = min([(cost + price[t], t) for cost, t in ways[n]])
            if price[n] < best:
                price[n] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)
    return price


@lru_cache(maxsize=1 << 15)
def transfer(symbols: str) -> tuple[tuple[int, ...], ...]:
    """Costs of the rows from each state (row) to each state (column), edits before the last row only."""
    if not symbols:
        return tuple(tuple(0 if a == b else FAR for b in range(4)) for a in range(4))
    arcs = lattice(symbols)
    columns = [auction(arcs, tuple(0 if s == end else FAR for s in range(4)))[:4] for end in range(4)]
    return tuple(zip(*columns, strict=True))


@lru_cache(maxsize=1 << 15)
def traced(symbols: str, exits: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state before: the letters of the least cheapest edits, given the costs from the states after, and the state after."""
    arcs = lattice(symbols)
    price, last = auction(arcs, exits), 4 * len(symbols)
    good = [False] * last + [cost < FAR for cost in exits]
    for i in range(last - 4, -1, -4):
        for _ in range(3):  # inserts stay in the layer
            for n in range(i, i + 4):
                good[n] = good[n] or any(good[t] and price[n] == cost + price[t] for _, cost, t in arcs[n])
    out = []
    for state in range(4):
        n, letters = state, []
        while n < last and good[n]:
            letter, _, n = next(a for a in arcs[n] if good[a[2]] and price[n] == a[1] + price[a[2]])
            letters.append(letter)
        out.append(("".join(letters), n - last if n >= last else -1))
    return tuple(out)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> distinct rows after damage with m, how many of them there are, and ``again``, whether
    role and text stand in an earlier turn. A conversation has a row of m 0 where rows were dropped."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    d = d.select("conv_id", F.when(F.col("kind") != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("k"))
    d = write_table(d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("k").alias("m")), "damaged")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = d.where("m > 0").groupBy("conv_id", "role", "text").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    same = same.select(*[F.col(c).alias(f"same_{c}") for c in ("conv_id", "role", "text")], "first")
    equal = d["conv_id"].eqNullSafe(same["same_conv_id"]) & (d["role"] == same["same_role"]) & (d["text"] == same["same_text"])
    d = d.hint("merge").join(same, equal, "left")
    return d.select("conv_id", "turn", "role", "text", "m", F.coalesce(F.col("first") < order, F.lit(False)).alias("again"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("symbols", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("deletes", pa.list_(pa.int64())), *[(c, pa.int64()) for c in _COUNTS], ("initials", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("costs", pa.list_(pa.int64()))])
SEGMENTS = "conv_id long, seg long, symbols string, roles array<string>, texts array<string>, deletes array<long>, blank long, duplicate long, truncated long, illegal long, turns long, initials array<string>, low long, high long, costs array<long>"


class Segment:
    """Rows of one conversation in a row."""

    def __init__(self, conv_id: int | None, most: int) -> None:
        self.conv_id, self.most, self.rows, self.bytes = conv_id, most, 0, 0
        self.symbols, self.roles, self.texts, self.deletes = [], [], [], [0]
        self.count = dict.fromkeys(_COUNTS, 0)
        self.initials, self.low, self.high = None, None, None

    def add(self, turn: int | None, role: str, text: str, m: int, again: bool) -> None:
        self.rows += 1
        if not m:
            return
        c, initial = self.count, role[:1]
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initials:
            c["illegal"] += self.initials[1] + initial not in ("su", "ua", "au")
            self.initials[1] = initial
        else:
            self.initials = [initial, initial]
        c["illegal"] += m - 1
        said = text.rstrip(BLANK)
        if not said or again:
            c["duplicate" if said else "blank"] += m
            self.deletes[-1] += m
            return
        cut = said[-1] not in ".!?"
        c["truncated"] += cut
        c["duplicate"] += m - 1
        symbol = initial if initial and initial in "sua" else "-"
        self.symbols.append({"-": "_"}.get(symbol, symbol.upper()) if cut else symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.deletes.append(m - 1)
        self.bytes += len(text)

    def full(self) -> bool:
        return self.rows >= self.most or self.bytes >= SEGMENT_BYTES

    def row(self, seg: int) -> dict:
        symbols = "".join(self.symbols)
        return {"conv_id": self.conv_id, "seg": seg, "symbols": symbols, "roles": self.roles, "texts": self.texts, "deletes": self.deletes, **self.count, "initials": self.initials or [], "low": self.low, "high": self.high, "costs": [x for r in transfer(symbols) for x in r]}


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Rows of ``damaged`` in order of conversation, turn (nulls first), role and text -> segments of ``most`` rows at
    most, numbered in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        seg, now, out = TaskContext.get().partitionId() << 40, None, []
        for batch in batches:
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and (now.conv_id != conv_id or now.full()):
                    out.append(now.row(seg))
                    seg, now = seg + 1, None
                    if len(out) >= 512 or sum(map(len, out[-1]["texts"])) > SEGMENT_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(out, _SEGMENT)
                        out = []
                now = now or Segment(conv_id, most)
                now.add(*row)
        if now is not None:
            yield pa.RecordBatch.from_pylist([*out, now.row(seg)], _SEGMENT)

    order = ["conv_id", "turn", "role", "text"]
    ranges = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)))
    return ranges.sortWithinPartitions(*order).select(*order, "m", "again").mapInArrow(run, SEGMENTS)


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seg, costs), a conversation's segments last to first -> (seg, exits): costs to the conversation's end from each state after it."""
    make_room()
    before, price = (), np.zeros(4, np.int64)
    for batch in batches:
        exits = []
        for conv_id, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (conv_id,) != before:
                before, price = (conv_id,), np.array([cost for cost, _ in END])
            exits.append(price.tolist())
            price = (np.array(costs).reshape(4, 4) + price[None, :]).min(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(exits, pa.list_(pa.int64()))], ["at", "exits"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their exits, a conversation's first to last -> a row for each conversation."""
    make_room()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    class Conversation:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.state, self.audit, self.hash, self.begun = conv_id, START, [], sha256(), False
            self.count, self.low, self.high, self.last, self.cost = dict.fromkeys(_COUNTS, 0), None, None, None, None

        def say(self, role: str, text: str) -> None:
            self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
            self.begun = True

        def insert(self) -> None:
            self.say("assistant" if self.state == USER else "user", "")
            self.state = AFTER[self.state]

        def add(self, r: dict) -> None:
            for c in _COUNTS:
                self.count[c] += r[c]
            if r["low"] is not None:
                self.count["turns"] -= r["low"] == self.high
                self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
            if r["initials"]:
                self.count["illegal"] += self.last is not None and self.last + r["initials"][0] not in ("su", "ua", "au")
                self.last = r["initials"][1]
            least = min(r["exits"])
            if self.cost is None:
                self.cost = min(r["costs"][s] + r["exits"][s] for s in range(4))
            letters, _ = traced(r["symbols"], tuple(x - least for x in r["exits"]))[self.state]
            self.audit.append("D" * r["deletes"][0])
            k = 0
            for letter in letters:
                self.audit.append(letter)
                if letter == "I":
                    self.insert()
                    continue
                role, text = r["roles"][k], r["texts"][k]
                if letter == "K":
                    self.say(role, text)
                    self.state = KEEPS[self.state, role[0]]
                elif letter == "R":
                    self.say("assistant" if self.state == USER else "user", text)
                    self.state = AFTER[self.state]
                k += 1
                self.audit.append("D" * r["deletes"][k])

        def row(self) -> tuple:
            for letter in END[self.state][1]:
                self.audit.append(letter)
                self.insert()
            c = self.count
            gaps = self.high - self.low + 1 - c["turns"] if self.low is not None else 0
            return (self.conv_id, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost + DELETE * (c["blank"] + c["duplicate"]), "".join(self.audit), self.hash.hexdigest())

    now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is not None and now.conv_id != r["conv_id"]:
                out.append(now.row())
                now = None
            now = now or Conversation(r["conv_id"])
            now.add(r)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds, strict=True)], names)


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row for each conv_id: gaps, faults, the cheapest edits after damage and the digest of
    what they leave.

    Null roles and texts are one space (so such a text is blank); null turns come first and count for no gap; rows of a null conv_id are
    one conversation; rows of one turn are in order of role and text; equal rows lie side by side, all but the first are duplicates.
    A conversation of which damage leaves nothing has zeros, an empty audit and the digest of nothing; an empty table gives no
    row; other columns are ignored; texts and conversations may be of any length."""
    found = write_table(segments(damaged(rows), segment), "segments")
    costs = found.select("conv_id", "seg", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    exits = costs.mapInArrow(_priced, "at long, exits array<long>")
    whole = found.hint("merge").join(exits, F.col("seg") == F.col("at")).drop("at")
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return whole.mapInArrow(_finished, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: A row at a time, the least (cost, audit) of each state: of two audits of one cost that lead to one state none begins the other, so the
#: least stays least.
SQL = """
with recursive crc as (
    select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
    from conversations
), dealt as (
    select conv_id, turn, role, text,
        xor(list_reduce(list_transform(string_split(k, ''), lambda x: cast(ascii(x) as bigint)), lambda a, x: xor(t[cast(xor(a, x) & 255 as integer) + 1], a >> 8), cast(4294967295 as bigint)), 4294967295) % 20 as kind
    from keyed, crc
), rows as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from dealt, range(case when kind = 3 then 2 else 1 end) r(i) where kind <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said
    from rows
), judged as (
    select *, case when said = '' then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
        when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(role[1:1]) over (partition by conv_id order by k) || role[1:1] as pair
    from placed
), ids as (select distinct conv_id from conversations),
nexts(st, ins, cost, st2, role) as (values ('', '', 0, '', ''), ('s', '', 0, 's', ''), ('u', '', 0, 'u', ''), ('a', '', 0, 'a', ''),
    ('', 'I', 2, 'u', 'user:\n'), ('s', 'I', 2, 'u', 'user:\n'), ('u', 'I', 2, 'a', 'assistant:\n'), ('a', 'I', 2, 'u', 'user:\n'),
    ('', 'II', 4, 'a', 'user:\nassistant:\n'), ('s', 'II', 4, 'a', 'user:\nassistant:\n')),
acts(st, act, initial, cost, st2, role) as (values ('', 'K', 's', 0, 's', ''), ('', 'K', 'u', 0, 'u', ''), ('s', 'K', 'u', 0, 'u', ''), ('u', 'K', 'a', 0, 'a', ''), ('a', 'K', 'u', 0, 'u', ''),
    ('', 'R', null, 2, 'u', 'user'), ('s', 'R', null, 2, 'u', 'user'), ('u', 'R', null, 2, 'a', 'assistant'), ('a', 'R', null, 2, 'u', 'user'),
    ('', 'D', null, 3, '', ''), ('s', 'D', null, 3, 's', ''), ('u', 'D', null, 3, 'u', ''), ('a', 'D', null, 3, 'a', '')),
best as (
    select conv_id, 0 as k, '' as st, struct_pack(cost := 0, audit := '', rep := '') as m from ids
    union all
    select b.conv_id, b.k + 1, a.st2, min(struct_pack(cost := b.m.cost + n.cost + a.cost + case when a.act <> 'D' and j.fault = 'truncated' then 1 else 0 end,
        audit := b.m.audit || n.ins || a.act,
        rep := b.m.rep || n.role || case a.act when 'K' then j.role || ':' || j.text || chr(10) when 'R' then a.role || ':' || j.text || chr(10) else '' end))
    from best b join judged j on b.conv_id is not distinct from j.conv_id and j.k = b.k + 1
    join nexts n on n.st = b.st join acts a on a.st = n.st2
    where (a.act <> 'K' or a.initial = j.role[1:1]) and (a.act = 'D' or j.fault not in ('blank', 'duplicate'))
    group by b.conv_id, b.k + 1, a.st2
), ends as (
    select b.conv_id, min(struct_pack(cost := b.m.cost + n.cost, audit := b.m.audit || n.ins, rep := b.m.rep || n.role)) as m
    from best b join nexts n on n.st = b.st
    where n.st2 in ('', 'a') and b.k = (select count(*) from judged j where j.conv_id is not distinct from b.conv_id)
    group by b.conv_id
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
)
select e.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
    coalesce(c.illegal, 0) as illegal, cast(e.m.cost as bigint) as cost, e.m.audit as audit, sha256(e.m.rep[1:len(e.m.rep) - 1]) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""
