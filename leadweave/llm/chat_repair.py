"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in alternation, ending
with the assistant. Dynamic programming over this automaton (states: start, after system, after
user, after assistant) gives every turn the cheapest action: keep it, merge it into the turn
before, relabel it, with empty turns inserted before it where that is cheaper; at the end empty
turns may be added. The repaired sequence is rendered as fragments, one per input row, whose
concatenation in order is the conversation.

A row changes costs by a 4 x 4 table that depends on its role only, and (min, +) products of
such tables are associative, so a conversation of any length is split: rows get a written
number and are range-partitioned by (conv_id, turn, role, text, number) into written parts, so
that rows alike in all but the number are split too. The first and the last conversation of
every part are summed up as one table each, and the driver, with two small rows per part, fixes
the states at which conversations cross from part to part. Parts are then solved on their own,
conversation by conversation: a task holds what a part has of one conversation.

Costs: merging 1, an inserted turn 2, relabelling 3, merging into another role 1 + 3; a role
that is none of the three (NULL included) costs nothing to relabel. Of equal costs the first in
the order keep, relabel, merge, fewer insertions, the role's order, is taken.

Defined results: rows are ordered by turn (NULL first), role, text; repeated rows are merged as
turns of one role. NULL conv_id is a conversation of its own. NULL text is empty. No row is
lost; an empty table gives an empty result. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadweave.llm.common import written

ROLES = ("system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
_NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}  # state -> roles that may follow; role r leads to state r + 1
_STATES = range(4)
_FAR = 10**9


class Action(NamedTuple):
    cost: int
    rank: int
    kind: str
    role: int
    inserted: tuple[int, ...]


def _insertions(state: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Up to two legal empty turns from a state, and where they lead."""
    yield (), state
    for a in _NEXT[state]:
        yield (a,), a + 1
        for b in _NEXT[a + 1]:
            yield (a, b), b + 1


@cache
def actions(role: int) -> list[list[Action | None]]:
    """The best action from state to state for a turn of a role; 3 is any other role."""
    best: list[list[Action | None]] = [[None] * 4 for _ in _STATES]

    def offer(s: int, t: int, action: Action) -> None:
        if best[s][t] is None or action < best[s][t]:
            best[s][t] = action

    for s in _STATES:
        for inserted, at in _insertions(s):
            for x in _NEXT[at]:
                changed = 0 if role in (x, 3) else RELABEL
                offer(s, x + 1, Action(INSERT * len(inserted) + changed, bool(changed), "relabel" if role != x else "keep", x, inserted))
        if s:
            offer(s, s, Action(MERGE + (0 if role in (s - 1, 3) else RELABEL), 2, "merge", s - 1, ()))
    return best


@cache
def endings() -> list[tuple[int, tuple[int, ...]]]:
    """Cost and empty turns from every state to a legal end (after assistant, or nothing)."""
    return [min((INSERT * len(i), i) for i, at in _insertions(s) if at in ((0, 3) if not s else (3,))) for s in _STATES]


def role_number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def advance(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Costs by state after one more turn, and the state each came from."""
    table = actions(role)
    out, back = [_FAR] * 4, [0] * 4
    for t in _STATES:
        for s in _STATES:
            if table[s][t] and costs[s] + table[s][t].cost < out[t]:
                out[t], back[t] = costs[s] + table[s][t].cost, s
    return out, back


def summary(roles: list[int]) -> list[list[int]]:
    """Cost of a stretch of turns from every state to every state."""
    out = []
    for s in _STATES:
        costs = [0 if t == s else _FAR for t in _STATES]
        for role in roles:
            costs, _ = advance(costs, role)
        out.append([min(c, _FAR) for c in costs])
    return out


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> tuple[list[Action], int]:
    """Actions of a stretch entered at ``entry``; left at ``leave``, or ended if None. Also the
    state in which it is left."""
    costs = [0 if t == entry else _FAR for t in _STATES]
    backs = []
    for role in roles:
        costs, back = advance(costs, role)
        backs.append(back)
    state = leave if leave is not None else min(_STATES, key=lambda s: costs[s] + endings()[s][0])
    last, chosen = state, []
    for role, back in zip(reversed(roles), reversed(backs), strict=True):
        chosen.append(actions(role)[back[state]][state])
        state = back[state]
    return chosen[::-1], last


def crossings(parts: list[dict]) -> dict[int, tuple[int, int | None]]:
    """For every part the state in which its first conversation is entered and that in which
    its last one is left (None: it ends there). ``parts``: part, first and last (conversation
    keys), head and tail (their tables), in order; head is the whole part if it holds one."""
    entry = {p["part"]: 0 for p in parts}
    leave: dict[int, int | None] = {p["part"]: None for p in parts}
    start = 0
    while start < len(parts):
        stop = start
        while stop + 1 < len(parts) and parts[stop + 1]["first"] == parts[stop]["last"] and (
            stop == start or parts[stop]["first"] == parts[stop]["last"]):
            stop += 1
        if stop > start:
            costs, backs = [0] + [_FAR] * 3, []
            for k in range(start, stop + 1):
                table = parts[k]["tail"] if k == start else parts[k]["head"]
                after, back = [_FAR] * 4, [0] * 4
                for t in _STATES:
                    for s in _STATES:
                        if costs[s] + table[s][t] < after[t]:
                            after[t], back[t] = costs[s] + table[s][t], s
                costs = after
                backs.append(back)
            state = min(_STATES, key=lambda s: costs[s] + endings()[s][0])
            for k in range(stop, start, -1):
                state = backs[k - start][state]
                entry[parts[k]["part"]] = leave[parts[k - 1]["part"]] = state
        start = max(stop, start + 1)
    return {p: (entry[p], leave[p]) for p in entry}


_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(part, conversation, is it the part's first, its last, rows), over batch borders. The rows
    of two conversations are held at a time."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    before = None
    for (part, key), turns in groupby(rows(), key=lambda r: r[:2]):
        now = (part, key, before is None or before[0] != part, list(turns))
        if before:
            yield *before[:3], now[2], before[3]
        before = now
    if before:
        yield *before[:3], True, before[3]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {}
    for part, conv, is_first, is_last, turns in _stretches(batches, ["part", "conv_id", "role"]):
        if not (is_first or is_last):
            continue
        table = [x for row in summary([role_number(t[2]) for t in turns]) for x in row]
        if is_first:
            found = {"part": part, "first": _key(conv), "head": table}
        if not is_last:
            continue
        yield pa.RecordBatch.from_pylist(
            [{**found, "last": _key(conv), "tail": table}],
            schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]))


def _key(conversation) -> str:
    return "null" if conversation is None else f"={conversation}"


def _solve(borders: dict[int, tuple[int, int | None]], conv_type: pa.DataType, turn_type: pa.DataType):
    schema = pa.schema([
        ("conv_id", conv_type), ("turn", turn_type), ("role", pa.string()), ("action", pa.string()), ("new_role", pa.string()),
        ("inserted_before", pa.list_(pa.string())), ("inserted_after", pa.list_(pa.string())), ("cost", pa.int32()), ("fragment", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, conv, is_first, is_last, turns in _stretches(batches, ["part", "conv_id", "turn", "role", "text"]):
            entry, leave = borders[part]
            state = entry if is_first else 0
            goal = leave if is_last else None
            chosen, last = repair([role_number(t[3]) for t in turns], state, goal)
            for (_, _, turn, role, text), action in zip(turns, chosen, strict=True):
                text = text or ""
                opened = "" if state == 0 else _CLOSE
                if action.kind == "merge":
                    fragment = "\n\n" + text
                else:
                    empty = "".join(f"{_OPEN}{ROLES[i]}\n{_CLOSE}" for i in action.inserted)
                    fragment = f"{opened}{empty}{_OPEN}{ROLES[action.role]}\n{text}"
                out.append({
                    "conv_id": conv, "turn": turn, "role": role, "action": action.kind, "new_role": ROLES[action.role],
                    "inserted_before": [ROLES[i] for i in action.inserted], "inserted_after": [], "cost": action.cost, "fragment": fragment})
                state = action.role + 1
            if goal is None:
                cost, added = endings()[last]
                out[-1]["inserted_after"] = [ROLES[i] for i in added]
                out[-1]["cost"] += cost
                out[-1]["fragment"] += _CLOSE + "".join(f"{_OPEN}{ROLES[i]}\n{_CLOSE}" for i in added)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repair_roles(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, action (keep, relabel, merge), new_role, inserted_before and
    inserted_after (roles of empty turns), cost, fragment: one row per row."""
    order = ["conv_id", "turn", "role", "text"]
    key = [*order, "number"]
    numbered = written(conversations.select(*order, F.monotonically_increasing_id().alias("number")), "numbered-turns")
    ranged = numbered.repartitionByRange(*key).sortWithinPartitions(*key)
    parts = written(ranged.withColumn("part", F.spark_partition_id()), "turns")
    dealt = parts.repartition("part").sortWithinPartitions("part", *key)
    tables = dealt.select("part", "conv_id", "role").mapInArrow(
        _summarise, "part int, first string, last string, head array<long>, tail array<long>").collect()  # two rows' worth a part
    square = lambda x: [x[4 * k : 4 * k + 4] for k in _STATES]
    known = [r.asDict() | {"head": square(r["head"]), "tail": square(r["tail"])} for r in sorted(tables, key=lambda r: r["part"])]
    types = {f.name: to_arrow_type(f.dataType) for f in parts.schema.fields}
    spark_types = dict(parts.dtypes)
    return dealt.mapInArrow(
        _solve(crossings(known), types["conv_id"], types["turn"]),
        f"conv_id {spark_types['conv_id']}, turn {spark_types['turn']}, role string, action string, new_role string, "
        "inserted_before array<string>, inserted_after array<string>, cost int, fragment string")
