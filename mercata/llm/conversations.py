"""Repair of role structure in conversations, by Knuth's lightest-derivation agenda.

A conversation should read ``(s?(ua)+)?`` in its roles' initials. An item
``[i, q]`` says: the turns from ``i`` on can be repaired when ``q`` is the last
role put out (nothing, system, user, assistant). Deductions put one edit in
front of an item: keep, rerole, delete, or insert a turn. Items carry (cost,
audit), where the audit lists the edits' initials, and are popped from the
agenda by (cost, turns covered, audit). Every deduction is monotone in that
order (putting the same edit in front keeps it) and superior (an edit costs
something, or it covers one more turn), so a popped item is final, and the
search stops when its goals are.

A long conversation is cut into segments of ``SPAN`` turns. A segment's goals
are its lightest derivations from each state it may start in to each state it
may end in; inserts go in front of a turn, so two derivations of a segment
from one state never are prefixes of each other and their order inside the
segment decides whole audits. Segments are joined from the last one back, with
one small row a segment. What a task holds of a conversation grows by four
characters of audit a turn there; texts only stream through.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mercata.llm.streams import emit, number_rows, rows
from mercata.session import write_table

SPAN = 256
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # the last role put out
STATES = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs
_CACHED = 20_000
_GOOD_PAIRS = ("su", "ua", "au")
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""
_END = "end"


def spoken(state: int) -> int:
    """The role that is put out next, user or assistant."""
    return ASSISTANT if state == USER else USER


def _kept(symbol: str, state: int) -> int | None:
    """The state after keeping a turn, None if its role does not fit."""
    if symbol == "s":
        return SYSTEM if state == NOTHING else None
    if symbol == "u":
        return USER if state != USER else None
    if symbol == "a":
        return ASSISTANT if state == USER else None
    return None


def _edits(symbol: str) -> list[list[tuple[int, int, str]]]:
    """By state after the turn: (state before it, cost, initial). ``x``: must go; capitals: truncated."""
    into: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
    for q in STATES:
        into[q].append((q, DELETE, "D"))
        if symbol == "x":
            continue
        extra = TRUNCATED if symbol.isupper() else 0
        into[spoken(q)].append((q, REROLE + extra, "R"))
        kept = _kept(symbol.lower(), q)
        if kept is not None:
            into[kept].append((q, extra, "K"))
    return into


_EDITS = {s: _edits(s) for s in "xsuaoSUAO"}
_BEFORE_INSERT = [[q for q in STATES if spoken(q) == r] for r in STATES]
#: What closes a conversation that ends in a state: (cost, audit).
_CLOSINGS = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def lightest(turns: str, axioms: dict[int, tuple[int, str]], starts: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation from each start state over ``turns`` (one symbol a turn).

    ``axioms``: what the states behind the last turn cost. A start state
    without a derivation is left out.
    """
    n = len(turns)
    agenda = [(cost, 0, audit, q) for q, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final: list[set[int]] = [set() for _ in range(n + 1)]  # by turns covered
    goals, open_ = {}, set(starts)
    while agenda and open_:
        cost, covered, audit, q = heapq.heappop(agenda)
        if q in final[covered]:
            continue
        final[covered].add(q)
        if covered == n:
            if q in open_:
                goals[q] = (cost, audit)
                open_.discard(q)
        else:
            done = final[covered + 1]
            for before, more, letter in _EDITS[turns[n - covered - 1]][q]:
                if before not in done:
                    heapq.heappush(agenda, (cost + more, covered + 1, letter + audit, before))
        if covered:  # in front of a turn; the axioms hold what may stand behind the last one
            for before in _BEFORE_INSERT[q]:
                if before not in final[covered]:
                    heapq.heappush(agenda, (cost + INSERT, covered, "I" + audit, before))
    return goals


# ---------------------------------------------------------------- segments

_NO_TURN = None
_SEG_DDL = ("conv {kind}, seg long, costs array<long>, audits array<string>, ranks array<int>, last boolean, blank long, duplicate long, truncated long, "
            "illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long")


def _segment(turns: str, last: bool, alone: bool) -> tuple[list, list, list]:
    """Costs, audits and ranks of a segment: by start state if it is the last one, else by start and end state."""
    if last:
        found = lightest(turns, _CLOSINGS, (NOTHING,) if alone else tuple(STATES))
        pairs = [found.get(q) for q in STATES]
    else:
        pairs = [None] * 16
        for end in STATES:
            for start, weight in lightest(turns, {end: (0, "")}, tuple(STATES)).items():
                pairs[4 * start + end] = weight
    ranks = [0] * len(pairs)
    if not last:
        for start in STATES:
            order = sorted((pairs[4 * start + e][1], e) for e in STATES if pairs[4 * start + e])
            for k, (_, e) in enumerate(order):
                ranks[4 * start + e] = k
    return [p and p[0] for p in pairs], [p and p[1] for p in pairs], ranks


def _segments(schema: pa.Schema):
    known: dict[tuple, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (conv, seg), group in groupby(rows(batches), key=lambda r: r[:2]):
                turns, seen, last = [], {BLANK: 0, DUPLICATE: 0, CUT: 0}, False
                held = None  # the turn read, whose marker (first of its kind) may still follow
                roles, numbers = [], []

                def settle(first):
                    role, fault = held
                    if fault != BLANK and not first:
                        fault = DUPLICATE
                    if fault:
                        seen[fault] += 1
                    symbol = role if role in ("s", "u", "a") else "o"
                    turns.append("x" if fault in (BLANK, DUPLICATE) else symbol.upper() if fault == CUT else symbol)

                for _, _, _, kind, role, fault, turn in group:
                    if kind == 0:
                        if held:
                            settle(False)
                        held = (role, fault)
                        roles.append(role)
                        numbers.append(turn)
                    elif kind == 1:
                        settle(True)
                        held = None
                    else:
                        last = True
                if held:
                    settle(False)
                text = "".join(turns)
                what = (text, last, seg == 0)
                if what not in known:
                    if len(known) >= _CACHED:
                        known.clear()
                    known[what] = _segment(*what)
                illegal = sum(a + b not in _GOOD_PAIRS for a, b in zip(roles, roles[1:]))
                given = [t for t in numbers if t is not None]
                distinct = sum(a != b for a, b in zip(given, given[1:])) + bool(given)
                yield (conv, seg, *known[what], last, seen[BLANK], seen[DUPLICATE], seen[CUT], illegal, roles[0], roles[-1],
                       given[0] if given else None, given[-1] if given else None, distinct)
        yield from emit(found(), schema)
    return run


# ---------------------------------------------------------------- joining segments

_WAY_DDL = ("conv {kind}, seg long, state int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _join(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv, group in groupby(rows(batches), key=lambda r: r[0]):
                best: list[int | None] = [None] * 4
                chosen = []  # from the last segment back: by start state (end state, audit)
                totals = [0, 0, 0, 0, 0]  # blank, duplicate, truncated, illegal, distinct turns
                role_after = low = high = None
                for _, seg, costs, audits, ranks, last, *counts, first_role, last_role, first_turn, last_turn, distinct in group:
                    if last:
                        best = list(costs)
                        chosen.append([(None, a) for a in audits])
                    else:
                        nxt, way = [None] * 4, [(None, None)] * 4
                        for q in STATES:
                            ends = [(costs[4 * q + e] + best[e], ranks[4 * q + e], e) for e in STATES
                                    if costs[4 * q + e] is not None and best[e] is not None]
                            if ends:
                                cost, _, e = min(ends)
                                nxt[q], way[q] = cost, (e, audits[4 * q + e])
                        best = nxt
                        chosen.append(way)
                        totals[3] += last_role + role_after not in _GOOD_PAIRS
                    for k, c in enumerate((*counts, distinct)):
                        totals[k] += c
                    if first_turn is not None:
                        totals[4] -= low is not None and last_turn == low  # one turn number on both sides of the cut
                        low, high = first_turn, last_turn if high is None else high
                    role_after = first_role
                gaps = 0 if low is None else high - low + 1 - totals[4]
                q, whole = NOTHING, []
                for seg in range(len(chosen)):
                    end, audit = chosen[-1 - seg][q]
                    yield conv, seg, q, audit, None, None, None, None, None, None
                    whole.append(audit)
                    q = end
                yield conv, -1, None, "".join(whole), gaps, *totals[:4], best[NOTHING]
        yield from emit(found(), schema)
    return run


# ---------------------------------------------------------------- putting edits to turns

_ROLES = {USER: "user", ASSISTANT: "assistant", SYSTEM: "system"}


def _apply(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (conv, seg), group in groupby(rows(batches), key=lambda r: r[:2]):
                _, _, _, _, _, q, audit = next(group)  # the segment's audit stands ahead of its turns
                line = seg * SPAN * 4  # a turn makes at most three lines: itself and two inserts; the end two more
                turn = None
                for letter in audit:
                    if letter == "I":
                        q = spoken(q)
                        yield conv, line, _ROLES[q], "", letter
                    else:
                        turn = next(group)
                        role, text = turn[3], turn[4]
                        if letter == "D":
                            continue
                        if letter == "R":
                            q = spoken(q)
                            role = _ROLES[q]
                        else:
                            q = _kept(role[0], q)
                        yield conv, line, role, text, letter
                    line += 1
        yield from emit(found(), schema)
    return run


_LINES_DDL = "conv {kind}, line long, role string, text string, edit string"


def _typed(ddl: str, kind: str) -> tuple[str, pa.Schema]:
    ddl = ddl.format(kind=kind)
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def repair(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(report, lines): the faults and cheapest repair of every conversation, and the repaired turns.

    Turns follow one another by ``turn``, nulls first, equal ones by role and
    text. ``report`` has one row a conversation: conv, gaps (turn numbers
    missing between the smallest and the largest; 0 if all are null), blank,
    duplicate, truncated (each turn counts for its first fault), illegal
    (neighbours whose roles' initials are none of su, ua, au), cost, audit.
    ``lines``: conv, line (ascending, not dense), role, text, edit, for the
    turns kept (K), reroled (R) and inserted (I).

    A null role or text is one space, so the turn is deleted as blank or its
    role replaced; an empty role fits nowhere. A null conversation id is a
    conversation of its own. Repeated rows are duplicates. Texts of any length
    are only streamed; turn numbers are taken as 64-bit integers. An empty
    table gives two empty ones. Only the four columns are read, so other
    columns may have any name.
    """
    kind = conversations.select(conv).schema.fields[0].dataType.simpleString()
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), or_space(role).alias("role"),
                                 or_space(text).alias("text"))
    placed = number_rows(plain, ["conv"], ["turn", "role", "text"], "turns")
    seg = F.floor(F.col("at") / SPAN)

    # Faults: a turn is the first of its kind if its place is the smallest one.
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND))
    none = F.lit(None).cast("string")
    no_turn = F.lit(None).cast("long")
    thin = placed.select("conv", seg.alias("seg"), "at", F.lit(0).alias("kind"), F.substring("role", 1, 1).alias("role"), fault.alias("fault"), "turn")
    says = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    firsts = placed.groupBy("conv", says.alias("says")).agg(F.min("at").alias("at")).select(
        "conv", seg.alias("seg"), "at", F.lit(1).alias("kind"), none.alias("role"), none.alias("fault"), no_turn.alias("turn"))
    ends = placed.groupBy("conv").agg(F.max("at").alias("at")).select(
        "conv", seg.alias("seg"), "at", F.lit(2).alias("kind"), none.alias("role"), none.alias("fault"), no_turn.alias("turn"))
    ddl, schema = _typed(_SEG_DDL, kind)
    dealt = thin.unionByName(firsts).unionByName(ends).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "at", "kind")
    segments = write_table(dealt.mapInArrow(_segments(schema), ddl), "conversation-segments")

    ddl, schema = _typed(_WAY_DDL, kind)
    order = segments.select("conv", "seg", "costs", "audits", "ranks", "last", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role",
                            "first_turn", "last_turn", "turns").repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    ways = write_table(order.mapInArrow(_join(schema), ddl), "conversation-ways")

    head = ways.filter("seg >= 0").select("conv", "seg", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), "state", "audit")
    body = placed.select("conv", seg.alias("seg"), "at", "role", "text", F.lit(None).cast("int").alias("state"), none.alias("audit"))
    ddl, schema = _typed(_LINES_DDL, kind)
    lines = (head.unionByName(body).repartition("conv", "seg").sortWithinPartitions("conv", "seg", "at").mapInArrow(_apply(schema), ddl))
    report = ways.filter("seg = -1").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, lines


# ---------------------------------------------------------------- digests of transcripts, damage

_DIGEST_DDL = ("conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _digest(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for conv, group in groupby(rows(batches), key=lambda r: r[0]):
                report, sha, between = (0, 0, 0, 0, 0, 0, ""), hashlib.sha256(), b""
                for _, line, *given, role, text in group:
                    if line >= 0:
                        sha.update(between + f"{role}:{text}".encode())
                        between = b"\n"
                    elif line == -1:
                        report = given
                yield conv, *report, sha.hexdigest()
        yield from emit(found(), schema)
    return run


def with_digests(report: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """``report`` for every id of ``ids`` (one column; zeros and an empty audit where there is no conversation),
    with the SHA-256 of its lines ``role:text``, joined by newlines.

    A digest runs over a conversation from start to end, so its lines stream
    through one task, in order and without being held.
    """
    kind = report.schema.fields[0].dataType.simpleString()
    kinds = {f.name: f.dataType for f in report.schema.fields}
    none = {c: F.lit(None).cast(kinds[c]) for c in kinds}
    names = list(kinds)[1:]
    no_text = F.lit(None).cast("string")
    every = ids.distinct().toDF("conv").select("conv", F.lit(-2).cast("long").alias("line"), *[none[c].alias(c) for c in names],
                                               no_text.alias("role"), no_text.alias("text"))
    heads = report.select("conv", F.lit(-1).cast("long").alias("line"), *names, no_text.alias("role"), no_text.alias("text"))
    body = lines.select("conv", "line", *[none[c].alias(c) for c in names], "role", "text")
    ddl, schema = _typed(_DIGEST_DDL, kind)
    return (every.unionByName(heads).unionByName(body).repartition("conv").sortWithinPartitions("conv", "line")
            .mapInArrow(_digest(schema), ddl))


def damage(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) with about a quarter of the rows dropped, emptied, stripped of stops, repeated or given
    to the user, by CRC-32 of ``conv:turn``; nulls are one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn)).cast("binary")) % 20
    rows_ = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"),
                                 how.alias("how")).filter("how <> 0")
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows_.select("conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
                        _damaged(F.col("text"), F.col("how")).alias("text"), copies.alias("copy")).drop("copy")


def _damaged(text: Column, how: Column) -> Column:
    return F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
