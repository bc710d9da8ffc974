"""Conversation repair against a plain search over whole audits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from mercata.llm import conversations as c
from mercata.llm.queries import QUERIES

from llm.helpers import CLASH, SF, sf_rows

GOAL = re.compile(r"(s?(ua)+)?")


def _brute(turns):
    """(cost, audit, lines) of the cheapest repair of (role, text, symbol) turns: Dijkstra over (turns done, roles out).

    Every edit is tried: both rerolings and both inserts; whole audits are compared.
    """
    heap, seen, best = [(0, "", 0, "", ())], set(), []
    limit = None
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        tail = roles[-1:] if roles else ""
        if i == len(turns) and GOAL.fullmatch(roles):
            limit = cost
            best.append((audit, lines))
            continue
        if (i, tail, audit) in seen:
            continue
        seen.add((i, tail, audit))
        options = []
        if i < len(turns):
            role, text, fault = turns[i]
            options.append((c.DELETE, "D", 1, "", None))
            if fault not in ("blank", "duplicate"):
                add = 5 if fault == "truncated" else 0
                options.append((add, "K", 1, role[:1], (role, text)))
                options += [(1 + add, "R", 1, r[0], (r, text)) for r in ("user", "assistant")]
        options += [(c.INSERT, "I", 0, r[0], (r, "")) for r in ("user", "assistant")]
        for more, letter, step, initial, line in options:
            if line is not None:
                if not initial or (tail, initial) not in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    continue
            heapq.heappush(heap, (cost + more, audit + letter, i + step, roles + initial, lines + ((line,) if line else ())))
    audit, lines = min(best)
    return limit, audit, lines


def _expect(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    seen, turns = set(), []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            fault = "truncated"
        else:
            fault = ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role, text, fault))
    given = [t for t, _, _ in rows if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = _brute(turns)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *count.values(), illegal, cost, audit, sha


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def _all(rows, damaged):
    by = {r[0]: [] for r in rows}
    for r in damaged:
        by[r[0]].append(r[1:])
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((k, *(_expect(sorted(v, key=order)) if v else none)) for k, v in by.items()), key=repr)


COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query_equals_plain_search(spark):
    rows = sf_rows(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'")
    got = sorted((tuple(r) for r in QUERIES["op11_repair"](spark, SF).select(*COLS).collect()), key=repr)
    assert got == _all(rows, _damage(rows))
    assert len({r[7] for r in got}) > 3


def _random_rows(r, convs, longest):
    out = []
    for k in range(convs):
        for t in range(r.randint(1, longest)):
            out.append((k, r.choice([t, t, t, None, t * 2]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
                        r.choice(["A.", "B!", "C", "", " ", None, f"d{t}?", f"e{t}"])))
    return out


def _cheap_inserts(monkeypatch):
    """At the usual costs a delete always beats an insert; here it does not."""
    monkeypatch.setattr(c, "INSERT", 1)
    monkeypatch.setattr(c, "DELETE", 3)
    monkeypatch.setattr(c, "_EDITS", {s: c._edits(s) for s in "xsuaoSUAO"})
    monkeypatch.setattr(c, "_CLOSINGS", {c.NOTHING: (0, ""), c.ASSISTANT: (0, ""), c.USER: (1, "I"), c.SYSTEM: (2, "II")})


@pytest.mark.parametrize("span,cheap", [(256, False), (256, True), (2, True), (3, False)])
def test_random_conversations_and_segments(spark, monkeypatch, span, cheap):
    """Short segments give what one long one gives; nulls, ties, repeats, unknown roles and clashing columns included."""
    monkeypatch.setattr(c, "SPAN", span)
    if cheap:
        _cheap_inserts(monkeypatch)
    rows = _random_rows(random.Random(span), 40, 8) + [(None, 1, "user", "x."), (None, 1, "user", "x."), (99, None, None, None)]
    rows += [(500, t, "assistant", "same") for t in range(7)]
    schema = f"conv_id long, turn long, role string, text string, {CLASH.replace('conv', 'c')}, seg int, at int, kind int"
    df = spark.createDataFrame([(*r, 1, "f", 2, "s", "0.5", "[]", "i", "t", "n", "b", 1, 2, 3) for r in rows], schema).repartition(4)
    for given, mine in ((c.damage(df, "conv_id", "turn", "role", "text"), _damage(rows)),
                        (df.withColumnRenamed("conv_id", "conv"), [(a, b, d or (" " if d is None else ""), " " if t is None else t) for a, b, d, t in rows])):
        report, lines = c.repair(given, "conv", "turn", "role", "text")
        got = c.with_digests(report, lines, df.select("conv_id")).withColumnRenamed("conv", "conv_id").select(*COLS).collect()
        assert sorted((tuple(r) for r in got), key=repr) == _all(rows, mine)
    assert {r.edit for r in lines.collect()} == {"K", "R"} | ({"I"} if cheap else set())


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, at int")
    report, lines = c.repair(df, "conv_id", "turn", "role", "text")
    assert report.collect() == [] and lines.collect() == []
    assert c.with_digests(report, lines, df.select("conv_id")).collect() == []


def test_agenda_pops_goals_in_order():
    """Known answers, and every way of cutting turns gives the same weight as the whole."""
    assert c.lightest("ua", c._CLOSINGS, (c.NOTHING,)) == {c.NOTHING: (0, "KK")}
    assert c.lightest("u", c._CLOSINGS, (c.NOTHING,)) == {c.NOTHING: (2, "D")}
    assert c.lightest("sua", c._CLOSINGS, (c.NOTHING,)) == {c.NOTHING: (0, "KKK")}
    assert c.lightest("uu", c._CLOSINGS, (c.NOTHING,)) == {c.NOTHING: (1, "KR")}
    assert c.lightest("", c._CLOSINGS, (c.NOTHING,)) == {c.NOTHING: (0, "")}
    r = random.Random(5)
    for _ in range(300):
        turns = "".join(r.choices("xsuaoSUAO", [2, 1, 4, 4, 1, 1, 1, 1, 1], k=r.randint(2, 12)))
        cut = r.randint(1, len(turns) - 1)
        rest = c.lightest(turns[cut:], c._CLOSINGS, tuple(c.STATES))
        assert c.lightest(turns[:cut], rest, (c.NOTHING,)) == c.lightest(turns, c._CLOSINGS, (c.NOTHING,))
