"""Repair of conversation structure by the cheapest edits.

A conversation's rows and the state of its roles span a lattice: node (i, q) has i rows behind it and q as the last role kept.  Keeping,
re-roling or deleting row i leads to i + 1, an insertion stays at i; the roles kept must read `(s?(ua)+)?`.  Two
Dijkstra searches, from the first node and back from the ends, meet in the middle.  They go on until the sum of their
least open costs exceeds the best meeting, so that every crossing of that cost is seen, and the least concatenated audit wins.

Two audits of one cost over the same rows are never prefixes of each other (the longer one would have more insertions and cost
more), so the least audit of a path is made of least audits of its parts.  Hence a conversation of more than `LONG`
rows is cut: its rows are ordered over many tasks, pieces of `PIECE` rows are searched once for each pair of states at their ends, and a
fold over the pieces joins them.  Its only per-conversation work is that fold, which holds four audits and one piece at a time.

Given order and faults: rows by turn (nulls first), then role and text; nulls count as one space; the first of blank,
duplicate and truncated is a row's fault.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean
from ledger_spark.session import written

#: Rows from which a conversation is cut, and rows of its pieces.  Neither changes a result.
LONG, PIECE = 1024, 256
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: The state that an inserted or re-roled row leads to, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BEFORE = {START: (), SYSTEM: (), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
_SPACE = " \t\n\v\f\r"
_RESULT = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string()]
_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str


class Way(NamedTuple):
    cost: int
    audit: str


def kept_state(role: str, state: int) -> int | None:
    """Where keeping a row of this role leads to."""
    head = role[:1]
    if head == "s":
        return SYSTEM if state == START else None
    if head == "u":
        return USER if NEXT[state] == USER else None
    return ASSISTANT if head == "a" and state == USER else None


def _onward(rows: list[Turn], i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, i, q) of each edit at a node."""
    yield INSERT, "I", i, NEXT[q]
    if i < len(rows):
        row = rows[i]
        yield DELETE, "D", i + 1, q
        if row.fault in (SOUND, TRUNCATED):
            cut = CUT if row.fault else 0
            to = kept_state(row.role, q)
            if to is not None:
                yield cut, "K", i + 1, to
            yield REROLE + cut, "R", i + 1, NEXT[q]


def _back(rows: list[Turn], i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, i, q) of each edit that leads to a node."""
    for p in BEFORE[q]:
        yield INSERT, "I", i, p
    if i:
        row = rows[i - 1]
        yield DELETE, "D", i - 1, q
        if row.fault in (SOUND, TRUNCATED):
            cut = CUT if row.fault else 0
            for p in (START,) if q == SYSTEM else BEFORE[q]:
                if kept_state(row.role, p) == q:
                    yield cut, "K", i - 1, p
                if q != SYSTEM:
                    yield REROLE + cut, "R", i - 1, p


class _Search:
    """One direction.  A heap is ordered by cost, then by rows passed: free edits lead to more rows only, so a node's
    least audit is known when it is taken off."""

    def __init__(self, starts: Iterable[tuple[int, int]], forward: bool, size: int) -> None:
        self.forward, self.size = forward, size
        self.seen: dict[tuple[int, int], tuple[int, str]] = {node: (0, "") for node in starts}
        self.done: dict[tuple[int, int], tuple[int, str]] = {}
        self.heap = [(0, self._passed(i), i, q) for i, q in self.seen]
        heapq.heapify(self.heap)

    def _passed(self, i: int) -> int:
        return i if self.forward else self.size - i

    def least(self) -> int | None:
        while self.heap and (self.heap[0][2], self.heap[0][3]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[int, int]:
        _, _, i, q = heapq.heappop(self.heap)
        self.done[i, q] = self.seen[i, q]
        return i, q

    def reach(self, node: tuple[int, int], cost: int, audit: str) -> None:
        if node in self.done:
            return
        have = self.seen.get(node)
        if have is None or (cost, audit) < have:
            self.seen[node] = (cost, audit)
            if have is None or cost < have[0]:
                heapq.heappush(self.heap, (cost, self._passed(node[0]), *node))


def cheapest(rows: list[Turn], entry: int = START, ends: Iterable[int] = ENDS) -> Way | None:
    """The cheapest edits that lead from `entry` to one of `ends`, ties by the least audit; None where none do."""
    size = len(rows)
    ahead = _Search([(0, entry)], True, size)
    behind = _Search([(size, q) for q in ends], False, size)
    best: Way | None = None

    def meet(cost: int, *parts: str) -> None:
        nonlocal best
        if best is None or cost <= best.cost:
            way = Way(cost, "".join(parts))
            best = way if best is None else min(best, way)

    while True:
        a, b = ahead.least(), behind.least()
        if a is None and b is None or best is not None and (a or 0) + (b or 0) > best.cost:
            return best
        if b is None or a is not None and a <= b:
            node = ahead.settle()
            cost, audit = ahead.done[node]
            if node in behind.done:
                meet(cost + behind.done[node][0], audit, behind.done[node][1])
            for more, letter, i, q in _onward(rows, *node):
                rest = behind.done.get((i, q))
                if rest:
                    meet(cost + more + rest[0], audit, letter, rest[1])
                ahead.reach((i, q), cost + more, audit + letter)
        else:
            node = behind.settle()
            cost, audit = behind.done[node]
            if node in ahead.done:
                meet(cost + ahead.done[node][0], ahead.done[node][1], audit)
            for more, letter, i, q in _back(rows, *node):
                start = ahead.done.get((i, q))
                if start:
                    meet(cost + more + start[0], start[1], letter, audit)
                behind.reach((i, q), cost + more, letter + audit)


def replayed(rows: list[Turn], entry: int, audit: str) -> list[str]:
    """The lines `role:text` that the edits leave."""
    out, state, at = [], entry, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:")
            continue
        row = rows[at]
        at += 1
        if letter == "K":
            state = kept_state(row.role, state)
            out.append(f"{row.role}:{row.text}")
        elif letter == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{row.text}")
    return out


def fault(role: str, text: str, again: bool) -> str:
    """The first fault of a row; `again`: role and text were seen earlier in its conversation."""
    said = text.strip(_SPACE)
    return BLANK if not said else DUPLICATE if again else SOUND if said[-1] in ".!?" else TRUNCATED


class Tally:
    """Counts over a conversation's rows in order, given at once or in pieces."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.turns = 0
        self.first: int | None = None
        self.last: int | None = None
        self.head: str | None = None

    def add(self, rows: list[Turn]) -> None:
        for row in rows:
            if row.fault:
                self.faults[row.fault] += 1
            if self.head is not None and self.head + row.role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.head = row.role[:1]
            if row.turn is not None and (self.last is None or row.turn != self.last):
                self.turns += 1
                self.first = row.turn if self.first is None else self.first
                self.last = row.turn

    def row(self, conv_id, way: Way, digest: str) -> tuple:
        gaps = 0 if self.last is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return conv_id, gaps, *self.faults.values(), self.illegal, way.cost, way.audit, digest


def whole(conv_id, rows: list[Turn]) -> tuple:
    """The result of a conversation whose rows are all at hand."""
    tally = Tally()
    tally.add(rows)
    way = cheapest(rows)
    return tally.row(conv_id, way, hashlib.sha256("\n".join(replayed(rows, START, way.audit)).encode()).hexdigest())


# -- on Spark ----------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage that crc32 of `conv_id:turn` deals; 0 copies where dropped.

    Nulls of role and text, and in the key of conv_id and turn, count as one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    gone = kind == 0
    return rows.select("conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"), F.when(~gone, role).alias("role"),
                       F.when(~gone, text).alias("text"), F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Each conversation of sorted batches and its rows, without holding them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[0])


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most: int) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _short(rows: DataFrame, schema: str, kind: pa.DataType) -> DataFrame:
    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, members in _groups(batches):
            turns, seen = [], set()
            for _, turn, role, text, copies in members:
                for _ in range(copies):
                    turns.append(Turn(turn, role, text, fault(role, text, (role, text) in seen)))
                    seen.add((role, text))
            yield whole(conv_id, turns)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lean(lambda batches: _batches(results(batches), _NAMES, [kind, *_TYPES], 500)), schema)


_PIECES = ("conv_id {id}, task int, seq int, turns array<long>, roles array<string>, texts array<string>, faults array<string>, "
           "ways array<struct<entry: int, leave: int, cost: long, audit: string>>")
_PIECE_NAMES = ["conv_id", "task", "seq", "turns", "roles", "texts", "faults", "ways"]
_PIECE_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.string())] * 3,
                pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]


def _ways(rows: list[Turn]) -> list[dict]:
    """The cheapest edits of a piece between each pair of states at its ends."""
    found = [(entry, leave, cheapest(rows, entry, (leave,))) for entry in STATES for leave in STATES]
    return [{"entry": entry, "leave": leave, "cost": way.cost, "audit": way.audit} for entry, leave, way in found if way]


def _folded(conv_id, pieces: Iterator[tuple]) -> tuple:
    """The result of a conversation from its pieces in order; a digest per state runs along."""
    tally = Tally()
    at = {START: (Way(0, ""), hashlib.sha256(), False)}
    for _, _, _, *columns, ways in pieces:
        rows = [Turn(*r) for r in zip(*columns)]
        tally.add(rows)
        best: dict[int, tuple[Way, int, str]] = {}
        for way in ways:
            if way["entry"] in at:
                had = at[way["entry"]][0]
                new = Way(had.cost + way["cost"], had.audit + way["audit"])
                if way["leave"] not in best or new < best[way["leave"]][0]:
                    best[way["leave"]] = new, way["entry"], way["audit"]
        after = {}
        for leave, (way, entry, audit) in best.items():
            _, digest, some = at[entry]
            digest = digest.copy()
            for line in replayed(rows, entry, audit):
                digest.update(("\n" + line if some else line).encode())
                some = True
            after[leave] = way, digest, some
        at = after
    way, digest, _ = min((at[q] for q in ENDS if q in at), key=lambda x: x[0])
    return tally.row(conv_id, way, digest.hexdigest())


def _long(rows: DataFrame, schema: str, kind: pa.DataType, kind_name: str) -> DataFrame:
    """The same for conversations of any length: first their pieces, then a fold over them."""
    same = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    # Equal rows become one with a count before anything of a conversation meets.
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    once = written(once.withColumn("same", same), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = once.where("copies > 0").groupBy(F.col("conv_id").alias("of"), F.col("same").alias("key")).agg(
        F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = once.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("key")), "left").select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))
    # Texts by their beginnings, as bounds of ranges pass through the driver.
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, seq = TaskContext.get().partitionId(), 0
        for conv_id, members in _groups(batches):
            turns = (Turn(turn, role, text, fault(role, text, again or n > 0))
                     for _, turn, role, text, copies, again in members for n in range(copies))
            held = list(islice(turns, PIECE))
            while True:  # a conversation without rows has an empty piece
                seq += 1
                yield conv_id, task, seq, *([r[i] for r in held] for i in range(4)), _ways(held)
                held = list(islice(turns, PIECE))
                if not held:
                    break

    pieces = written(dealt.mapInArrow(lean(lambda batches: _batches(
        pieces_of(batches), _PIECE_NAMES, [kind, *_PIECE_TYPES], 1)), _PIECES.format(id=kind_name)), "pieces")
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq")
    return ordered.mapInArrow(lean(lambda batches: _batches(
        (_folded(conv_id, members) for conv_id, members in _groups(batches)), _NAMES, [kind, *_TYPES], 1)), schema)


def repaired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """One result per conversation of `rows` (conv_id, turn, role, text, copies; see `damaged`; other columns are ignored).

    gaps, blank, duplicate, truncated and illegal count the faults before the repair; cost and audit are the cheapest edits' (K keep, R
    re-role, D delete, I insert), ties by the least audit; repaired_sha256 is of the lines `role:text` left.  Rows with no copies
    only name their conversation: one without other rows has zeros and the hash of nothing.  A null conv_id is a
    conversation.  Rows of one turn come by role and text; repeated rows are duplicates.  An empty table gives no
    rows.  Of conversations of at most `long` rows each is searched by one task; longer ones are cut into pieces.
    """
    ship(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    kind_name = rows.schema["conv_id"].dataType.simpleString()
    schema = _RESULT.format(id=kind_name)
    sizes = written(rows.groupBy(F.col("conv_id").alias("of")).agg(F.sum(F.greatest("copies", F.lit(1))).alias("n")).where(
        F.col("n") > long).select("of"), "long")
    held: Column = F.col("conv_id").eqNullSafe(F.col("of"))
    out = _short(rows.join(sizes, held, "left_anti"), schema, kind)
    if sizes.isEmpty():
        return out
    return out.union(_long(rows.join(sizes, held, "left_semi"), schema, kind, kind_name))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _struct_sql(*ways: str) -> str:
    return ways[0] if len(ways) == 1 else f"least({', '.join(ways)})"


def _way_sql(way: str, cost: str, letter: str) -> str:
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}'}}"


def _walk_sql() -> str:
    """The least way to each state after one more row, as four columns t0 to t3, and after insertions, s0 to s3."""
    none = "{'c': 1000000000, 'a': '~'}"

    def step(to: int) -> str:
        from_to = BEFORE[to]
        ways = [_way_sql(f"s{to}", "2", "D")]
        if to == SYSTEM:
            ways.append(f"case when sound and head = 's' then {_way_sql('s0', 'cut', 'K')} else {none} end")
        for p in from_to:
            ways.append(f"case when sound and head = '{ROLE[to][0]}' then {_way_sql(f's{p}', 'cut', 'K')} else {none} end")
            ways.append(f"case when sound then {_way_sql(f's{p}', '1 + cut', 'R')} else {none} end")
        return _struct_sql(*ways)

    steps = ", ".join(f"{step(q)} as t{q}" for q in STATES)
    user = _struct_sql("t2", *[_way_sql(f"t{p}", "5", "I") for p in BEFORE[USER]])
    return f"""select c, n, t0 as s0, t1 as s1, u2 as s2, least(t3, {_way_sql('u2', '5', 'I')}) as s3 from (
  select *, {user} as u2 from (select w.c, w.n + 1 as n, {steps} from walk w join faults f on f.c = w.c and f.n = w.n + 1))"""


SQL13 = rf"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
crc as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * length(k)),
    lambda j: ((ascii(substr(k, (j // 8 + 1)::int, 1)) >> (j % 8)::int) & 1)::bigint)),
    lambda x, b: xor(x >> 1, 3988292384::bigint * (xor(x, b) & 1))), 4294967295::bigint) % 20 as dmg from src),
ids as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
rows_ as (select c, turn, case when dmg = 4 then 'user' else role end as role,
    case dmg when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case dmg when 0 then 0 when 3 then 2 else 1 end)) as copy
  from crc join ids on crc.conv_id is not distinct from ids.conv_id),
ordered as (select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as n from rows_),
marked as (select *, left(role, 1) as head, lag(left(role, 1)) over (partition by c order by n) as prev,
    row_number() over (partition by c, role, text order by n) > 1 as again,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as said from ordered),
faults as (select *, said = '' as blank, said <> '' and again as dup, said <> '' and not again and said not in ('.', '!', '?') as trunc,
    said <> '' and not again as sound, case when said in ('.', '!', '?') then 0 else 5 end as cut from marked),
walk as (select c, 0::bigint as n, {{'c': 0, 'a': ''}} as s0, {{'c': 1000000000, 'a': '~'}} as s1, {{'c': 5, 'a': 'I'}} as s2,
    {{'c': 10, 'a': 'II'}} as s3 from ids
  union all {_walk_sql()}),
best as (select c, arg_max(least(s0, s3), n) as w from walk group by c),
edits as (select c, unnest(range(1, length(w.a) + 1)) as i, w.a as a from best),
letters as (select c, i, substr(a, i::int, 1) as e from edits),
placed as (select *, sum((e <> 'I')::int) over (partition by c order by i) as n, sum((e <> 'D')::int) over (partition by c order by i) as p
  from letters),
kept as (select l.c, i, e, p, case when e <> 'I' then f.role end as role, case when e <> 'I' then f.text else '' end as text,
    max((p = 1 and e = 'K' and f.head = 's')::int) over (partition by l.c) as lead
  from placed l left join faults f on f.c = l.c and f.n = l.n where e <> 'D'),
lines as (select c, sha256(string_agg(case when e = 'K' then role when (p - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || text,
    chr(10) order by i)) as digest from kept group by c),
counts as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum(dup::int) as duplicate,
    sum(trunc::int) as truncated, sum((prev is not null and prev || head not in ('su', 'ua', 'au'))::int) as illegal from faults group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, w.c::bigint as cost, w.a as audit,
  coalesce(digest, sha256('')) as repaired_sha256
from ids join best using (c) left join counts using (c) left join lines using (c)
"""
