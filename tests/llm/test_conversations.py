"""Conversation repair against a search over all edits, against SQL, and cut into parts against whole."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from barwright.llm import conversations as cv
from barwright.llm import queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def search(rows):
    """Dijkstra over (rows read, roles so far) with whole audits: the least (cost, audit) whose roles are legal."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if k == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        state = (k, roles[-1:])
        if state in done:
            continue
        done.add(state)

        def go(price, letter, k, role, line, audit=audit, cost=cost, roles=roles, lines=lines):
            new = roles + role
            # a prefix of a legal string
            if not role or LEGAL.fullmatch(new) or LEGAL.fullmatch(new + "a") or LEGAL.fullmatch(new + "ua"):
                heapq.heappush(heap, (cost + price, audit + letter, k, new, lines + line))

        for name in ("user", "assistant"):
            go(5, "I", k, name[0], (name + ":",))
        if k < len(rows):
            role, text, must_go, extra = rows[k]
            go(2, "D", k + 1, "", ())
            if not must_go:
                if role:
                    go(extra, "K", k + 1, role[0], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    go(1 + extra, "R", k + 1, name[0], (f"{name}:{text}",))
    raise AssertionError


def brute(rows):
    out = []
    for conv, own in damage(rows).items():
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            marked.append((role, text, fault in (0, 1), 5 if fault == 2 else 0))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = search(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def noisy(conversations=60, longest=14, seed=7):
    """Repeats, blanks, truncated texts, wrong and empty and null roles, gaps, equal and null turns."""
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 4])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "agent", "", None])
            text = rng.choice(["Yes.", "No!", "Well", "Well?", " ", "", None, "É bien.\n", " "]) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}" + rng.choice([".", "", ". \t"])
            rows.append((c if c else None, None if rng.random() < 0.04 else turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_search_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(queries.op13_conversation_repair(spark, sf))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({cv.oracle()})").fetchall(), key=str)


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = noisy()
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_noisy_conversations(spark, odd_turns):
    rows, df = odd_turns
    want = brute(rows)
    assert collected(cv.reported(cv.damaged(df))) == want
    con, pdf = duckdb.connect(), df.toPandas()  # noqa: F841  DuckDB finds it by name
    con.execute("CREATE TABLE conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM pdf")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({cv.oracle()})").fetchall(), key=str) == want


def test_long_conversations_in_parts(spark, odd_turns):
    """The same rows with every conversation long: the parts' tables give what the whole gives."""
    rows, df = odd_turns
    hot = [(5, k // 2, ["user", "assistant", "system"][k % 3 if k % 7 else 0], f"Turn {k % 90}" + "." * (k % 3)) for k in range(700)]
    df = spark.createDataFrame(rows + hot, SCHEMA)
    whole = collected(cv.reported(cv.damaged(df)))
    assert collected(cv.reported(cv.damaged(df), most_rows=4)) == whole == collected(cv.reported(cv.damaged(df), most_rows=0)) == collected(cv.reported(cv.damaged(df), most_chars=3))
    turns = lambda most: sorted(map(str, cv.repaired(cv.undamaged(df), most_rows=most).collect()))
    assert turns(4) == turns(10**6)


def test_repaired_turns_are_legal(spark, odd_turns):
    rows, df = odd_turns
    found = {}
    for r in cv.repaired(cv.damaged(df)).orderBy("conv_id", "position").collect():
        found.setdefault(r["conv_id"], []).append(r)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in cv.reported(cv.damaged(df)).collect()}
    for conv, own in found.items():
        assert LEGAL.fullmatch("".join(r["role"][:1] for r in own)) and [r["position"] for r in own] == list(range(len(own)))
        assert cv.digest([(r["role"], r["text"], "") for r in own]) == hashes[conv]


def test_ties_take_the_least_audit():
    """Of equal costs D comes before I, I before K, K before R."""
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.2, rng.choice([0, 0, 5])) for _ in range(rng.randrange(9))]
        p = cv.Prices(cv.NONE)
        for role, _, must_go, extra in rows:
            p.add(role[:1], must_go, extra)
        cost, state = cv.closed(p.table())
        audit, turns = cv.written(rows, p, state, True)
        assert (cost, audit, "\n".join(f"{a}:{b}" for a, b, _ in turns)) == search(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 5), (1, 1, "user", "Hi.", 6)], SCHEMA + ", dropped long").withColumnRenamed("dropped", "cut")
    assert cv.reported(cv.damaged(df)).count() == 1
    assert cv.reported(cv.damaged(df.limit(0))).count() == 0 and cv.repaired(cv.undamaged(df.limit(0))).count() == 0
    assert collected(cv.reported(cv.undamaged(spark.createDataFrame([(1, None, None, None)], SCHEMA)))) == [(1, 0, 1, 0, 0, 0, 2, "D", cv.digest([]))]
