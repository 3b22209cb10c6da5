"""Conversation structure repair by dynamic programming over the retained turns.

A legal conversation is empty, or an optional system turn and then pairs of user and assistant. Repair keeps a turn
(cost 0), gives it the role user or assistant (1), deletes it (2; blank and duplicate turns must go) or inserts an empty
turn of user or assistant anywhere (5); a truncated turn that stays adds 5. The cheapest edits win, of these the ones whose
audit (the edits' initials D, I, K, R in order) is least in ASCII.

States are the role of the last retained turn: none, system, user, assistant. A turn is priced as the next retained one
from the running minimum of each state: costs so far less the prefix sum of deletions, so that a gap of deleted turns
costs the difference of two sums, and the pair of roles says how many turns are to be inserted between. Ties go by the
order of the states' audits, which is carried as a rank: audits of two states are never prefixes of each other (they hold
the same turns and end in no insertion), so that ranks, not strings, decide.

Conversations of up to ``most_rows`` rows and ``most_chars`` characters are repaired whole, one after another, as a task
reads them in order. Longer ones are cut by ranges of their rows: each part gives, for each state that it may begin in, the
cost and rank of each state that it may end in; the parts' tables are joined, which says where each begins and ends, and
each part is then written out by itself. Only the hash of a long conversation reads its text in one task, as a stream.

Order: by turn (nulls first), then role, then text. Nulls: a null in any column is one space, but a null turn counts for
no gap and a null conv_id is a conversation of its own, whose id stays null. A turn whose role is empty has no initial and
isn't kept as it is. Repeated rows are duplicates. Conversations whose rows are all dropped have zeros, an empty audit and
the hash of the empty text. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import ship, shuffle_partitions, sliced, small, staged

MOST_ROWS, MOST_CHARS = 5000, 4_000_000
_BLANKS = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = ("", "s", "u", "a")
_NAMES = ("", "system", "user", "assistant")
#: Turns to insert between the last retained role and the next, and after the last one at the end.
_BETWEEN = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
_CLOSING = (0, 2, 1, 0)
_DELETE, _INSERT, _REROLE, _TRUNCATED = 2, 5, 1, 5
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
REPORT = f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string, edit string"


class Prices:
    """Cheapest ways through turns from one state; turns are (initial, must go, extra cost if retained)."""

    def __init__(self, state: int):
        self.begin = state
        self.low: list[int | None] = [None] * 4  # running minima: cost so far less the deletions before
        self.low[state] = 0
        self.order = [state]  # states by their audits
        self.gone = self.n = 0  # prefix sum of deletions, turns
        self.last: list[tuple | None] = [None] * 4  # (previous, turn, insertions, letter, state)

    def add(self, initial: str, must_go: bool, extra: int) -> None:
        keys = None
        if not must_go:
            best: dict[int, tuple] = {}
            for rank, r in enumerate(self.order):
                for q in (SYSTEM, USER, ASSISTANT):
                    between, keep = _BETWEEN.get((r, q)), _ROLES[q] == initial
                    if between is None or (q == SYSTEM and not keep):
                        continue
                    price = self.low[r] + self.gone + _INSERT * between + (0 if keep else _REROLE) + extra
                    way = (price, rank, "I" * between + ("K" if keep else "R"), r, between)
                    if q not in best or way < best[q]:
                        best[q] = way
            last = list(self.last)
            for q, way in best.items():
                stay = self.low[q]
                if stay is None or way[:3] < (stay + self.gone + _DELETE, self.order.index(q), "D"):
                    keys = keys or {r: (rank, "D") for rank, r in enumerate(self.order)}
                    keys[q] = way[1:3]
                    last[q] = (self.last[way[3]], self.n, way[4], way[2][-1], q)
            if keys:
                for q, way in best.items():
                    if last[q] is not self.last[q]:
                        self.low[q] = way[0] - self.gone - _DELETE
                self.last, self.order = last, sorted(keys, key=keys.__getitem__)
        self.gone += _DELETE
        self.n += 1

    def table(self) -> dict[int, tuple[int, int]]:
        """state at the end: (cost, rank of its audit)."""
        return {r: (self.low[r] + self.gone, rank) for rank, r in enumerate(self.order)}

    def path(self, state: int) -> list[tuple]:
        """(turn, insertions before it, letter, state) of the retained turns that lead to a state."""
        out, at = [], self.last[state]
        while at is not None:
            out.append(at[1:])
            at = at[0]
        return out[::-1]


def closed(table: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost with the closing insertions, state) of the cheapest end."""
    cost, _, state = min((c + _INSERT * _CLOSING[r], rank, r) for r, (c, rank) in table.items())
    return cost, state


def written(rows: list[tuple], prices: Prices, state: int, closing: bool) -> tuple[str, list[tuple[str, str, str]]]:
    """The audit of a way and its turns (role, text, edit). rows: role and text first."""
    audit, out, now, before = [], [], prices.begin, -1

    def insert(n: int) -> None:
        nonlocal now
        for _ in range(n):
            now = ASSISTANT if now == USER else USER
            out.append((_NAMES[now], "", "I"))

    for turn, between, letter, q in prices.path(state):
        audit.append("D" * (turn - before - 1) + "I" * between + letter)
        insert(between)
        now, before = q, turn
        out.append((rows[turn][0] if letter == "K" else _NAMES[q], rows[turn][1], letter))
    audit.append("D" * (prices.n - before - 1))
    if closing:
        audit.append("I" * _CLOSING[state])
        insert(_CLOSING[state])
    return "".join(audit), out


def _faults(rows: list[tuple]) -> tuple[list[tuple[str, bool, int]], int, int, int, int]:
    """Turns as Prices takes them, and the number of blank, duplicate, truncated rows and illegal pairs. rows: (role, text, blank, cut, repeated)."""
    blank = sum(r[2] for r in rows)
    duplicate = sum(not r[2] and r[4] for r in rows)
    truncated = sum(not r[2] and not r[4] and r[3] for r in rows)
    initials = [r[0][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
    return [(i, r[2] or r[4], _TRUNCATED if r[3] else 0) for i, r in zip(initials, rows, strict=True)], blank, duplicate, truncated, illegal


def _whole(rows: list[tuple]) -> tuple[tuple, str, list[tuple[str, str, str]]]:
    """Counts and cost, audit and turns of a conversation. rows: (turn, role, text, blank, cut), in order."""
    seen: set[tuple[str, str]] = set()
    marked = []
    for _, role, text, blank, cut in rows:
        marked.append((role, text, blank, cut, (role, text) in seen))
        seen.add((role, text))
    turns, *counts = _faults(marked)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    prices = Prices(NONE)
    for t in turns:
        prices.add(*t)
    cost, state = closed(prices.table())
    return (gaps, *counts, cost), *written(marked, prices, state, True)


def digest(turns: list[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text, _ in turns).encode()).hexdigest()


_NEW = object()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Each conversation's rows (turn, role, text, blank, cut) without the dropped ones, from rows in order of conv_id."""
    now, rows = _NEW, []
    for b in sliced(batches, "text"):
        cols = [b.column(c).to_pylist() for c in ("conv_id", "dropped", "turn", "role", "text", "blank", "cut")]
        for conv, dropped, *row in zip(*cols, strict=True):
            if now is _NEW or conv != now:
                if now is not _NEW:
                    yield now, rows
                now, rows = conv, []
            if not dropped:
                rows.append(tuple(row))
    if now is not _NEW:
        yield now, rows


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in ddl.split(", ")])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, own in _conversations(batches):
            counts, audit, turns = _whole(own)
            yield conv, *counts, audit, digest(turns)

    return _batched(rows(), _arrow(REPORT))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, own in _conversations(batches):
            for k, turn in enumerate(_whole(own)[2]):
                yield conv, k, *turn

    return _batched(rows(), _arrow(TURNS))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the rows' CRC-32 deals; a dropped row stays with its mark."""
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.pmod(F.crc32(key), F.lit(20)).alias("d"),
    )
    text = F.when(F.col("d") <= 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of damaged()."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    return rows.select("conv_id", "dropped", "turn", "role", "text", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?") & (body != "")).alias("cut"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _split(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the conversations that are repaired whole, and those of the long ones (none: no conversation is long)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    long = staged(sizes.where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("long_id")), "long-conversations")
    if long.isEmpty():
        return rows, None
    return rows.join(small(long), _same("conv_id", "long_id"), "left_anti"), rows.join(small(long), _same("conv_id", "long_id"), "left_semi")


def _in_order(rows: DataFrame) -> DataFrame:
    """Whole conversations a partition, their rows in order."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _part_rows(pdf: pd.DataFrame) -> tuple[list[tuple], tuple]:
    pdf = pdf.sort_values("place")
    rows = list(zip(pdf["role"], pdf["text"], pdf["blank"], pdf["cut"], pdf["repeated"], strict=True))
    return rows, _faults(rows)


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long conversations: their rows by part, and for each part its counts and the state that it begins and ends in."""
    ids = staged(rows.where(~F.col("dropped")).withColumn("tie", F.monotonically_increasing_id()), "long-rows")
    n = shuffle_partitions(rows.sparkSession)
    dealt = ids.repartitionByRange(n, "conv_id", "turn", "role", "text", "tie").sortWithinPartitions("conv_id", "turn", "role", "text", "tie")
    placed = staged(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).drop("tie"), "long-parts")
    # one row a text: the first place where it stands
    first = placed.groupBy("conv_id", F.xxhash64("role", "text").alias("h"), "role", "text").agg(F.min("place").alias("first_place")).select("first_place")
    marked = placed.join(first, F.col("place") == F.col("first_place"), "left").withColumn("repeated", F.col("first_place").isNull()).drop("first_place")
    marked = staged(marked, "long-marked")

    def prices(pdf: pd.DataFrame) -> pd.DataFrame:
        own, (turns, *counts) = _part_rows(pdf)
        out = []
        for begin in range(4):
            p = Prices(begin)
            for t in turns:
                p.add(*t)
            out += [(begin, end, cost, rank) for end, (cost, rank) in p.table().items()]
        conv = pdf["conv_id"].iloc[0]
        head = [None if pd.isna(conv) else int(conv), int(pdf["part"].iloc[0]), *counts, own[0][0][:1], own[-1][0][:1]]
        return pd.DataFrame([(*head, *map(list, zip(*out, strict=True)))], columns=["conv_id", "part", "blank", "duplicate", "truncated", "illegal", "first", "last", "begins", "ends", "costs", "ranks"]).astype({"conv_id": "Int64"})

    tables = marked.groupBy("conv_id", "part").applyInPandas(prices, "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, first string, last string, begins array<long>, ends array<long>, costs array<long>, ranks array<long>")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        now, back = {NONE: (0, 0)}, []
        for r in pdf.itertuples():
            best: dict[int, tuple] = {}
            for begin, end, cost, rank in zip(r.begins, r.ends, r.costs, r.ranks, strict=True):
                if begin in now:
                    way = (now[begin][0] + int(cost), now[begin][1], int(rank), int(begin))
                    if end not in best or way < best[end]:
                        best[int(end)] = way
            order = sorted(best, key=lambda e: best[e][1:3])  # noqa: B023
            now = {e: (best[e][0], k) for k, e in enumerate(order)}
            back.append({e: best[e][3] for e in best})
        cost, state = closed(now)
        ends = []
        for b in back[::-1]:
            ends.append((b[state], state))
            state = b[state]
        out = pdf[["conv_id", "part", "blank", "duplicate", "truncated", "illegal"]].astype({"conv_id": "Int64"})
        out["illegal"] += [0] + [int(a + b not in ("su", "ua", "au")) for a, b in zip(pdf["last"][:-1], pdf["first"][1:], strict=True)]
        out["begin"], out["end"] = [e[0] for e in ends[::-1]], [e[1] for e in ends[::-1]]
        out["closing"] = [False] * (len(pdf) - 1) + [True]
        out["cost"] = [0] * (len(pdf) - 1) + [cost]
        return out

    # a part's table has at most 16 entries, and a conversation no more parts than there are partitions
    ways = tables.groupBy("conv_id").applyInPandas(joined, "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, begin int, end int, closing boolean, cost long")
    return marked, staged(ways, "long-ways")


def _rewritten(marked: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, part, audit, turns (array of role, text, edit) of each part of the long conversations."""

    def write(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own, (turns, *_) = _part_rows(left)
        way = right.iloc[0]
        p = Prices(int(way["begin"]))
        for t in turns:
            p.add(*t)
        audit, out = written(own, p, int(way["end"]), bool(way["closing"]))
        conv = way["conv_id"]
        return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"), "part": [int(way["part"])], "audit": [audit], "turns": [[{"role": a, "text": b, "edit": c} for a, b, c in out]]})

    rows, to = marked.groupBy("conv_id", "part"), ways.groupBy("conv_id", "part")
    return rows.cogroup(to).applyInPandas(write, "conv_id long, part int, audit string, turns array<struct<role:string,text:string,edit:string>>")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, audit and hash, from parts that come in order: the text is hashed as it streams by."""

    def rows() -> Iterator[tuple]:
        now, lines, audit, sha = _NEW, 0, [], hashlib.sha256()
        for b in batches:
            for conv, part, turns in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "turns")), strict=True):
                if now is _NEW or conv != now:
                    if now is not _NEW:
                        yield now, "".join(audit), sha.hexdigest()
                    now, lines, audit, sha = conv, 0, [], hashlib.sha256()
                audit.append(part)
                for t in turns:
                    sha.update(("\n" * (lines > 0) + f"{t['role']}:{t['text']}").encode())
                    lines += 1
        if now is not _NEW:
            yield now, "".join(audit), sha.hexdigest()

    return _batched(rows(), _arrow("conv_id long, audit string, repaired_sha256 string"))


def reported(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row for each conversation of damaged() or undamaged(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ship(rows.sparkSession)
    short, long = _split(_marked(rows), most_rows, most_chars)
    out = _in_order(short).mapInArrow(_reports, REPORT)
    if long is None:
        return out
    marked, ways = _parts(long)
    parts = _rewritten(marked, ways).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    hashes = parts.mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    sums = ways.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    seen = long.where(~F.col("dropped")).groupBy(F.col("conv_id").alias("seen_id")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    named = hashes.withColumnRenamed("conv_id", "hash_id")
    every = long.select(F.col("conv_id").alias("every_id")).distinct()  # a long conversation may have lost all its rows
    found = every.join(sums, _same("every_id", "conv_id"), "left").join(seen, _same("every_id", "seen_id"), "left").join(named, _same("every_id", "hash_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    own = found.select(F.col("every_id").alias("conv_id"), *[zero(c.split()[0]) for c in COUNTS.split(", ")], zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(digest([]))).alias("repaired_sha256"))
    return out.unionByName(own)


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)."""
    ship(rows.sparkSession)
    short, long = _split(_marked(rows), most_rows, most_chars)
    out = _in_order(short).mapInArrow(_turns, TURNS)
    if long is None:
        return out
    parts = staged(_rewritten(*_parts(long)), "long-turns")
    sizes = parts.groupBy(F.col("conv_id").alias("size_id")).agg(F.map_from_entries(F.collect_list(F.struct("part", F.size("turns")))).alias("sizes"))
    before = F.aggregate(F.map_keys("sizes"), F.lit(0).cast("long"), lambda s, k: s + F.when(k < F.col("part"), F.col("sizes")[k]).otherwise(F.lit(0)))
    placed = parts.join(sizes, _same("conv_id", "size_id")).select("conv_id", before.alias("before"), F.posexplode("turns").alias("k", "t"))
    return out.unionByName(placed.select("conv_id", (F.col("before") + F.col("k")).alias("position"), "t.role", "t.text", "t.edit"))


def oracle(conversations: str = "conversations") -> str:
    """DuckDB's SQL for reported(damaged()): every turn is priced for all states with audit and text as strings."""
    cheapest = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))"

    def way(state: str, added: str, letters: str, line: str) -> str:
        return f"{{'c': {state}.c + {added}, 'a': {state}.a || '{letters}', 't': {state}.t || {line}}}"

    gone = lambda s: way(s, "2", "D", "''")
    line = lambda role: f"chr(10) || {role} || ':' || r.text"
    user, assistant = f"chr(10) || '{_NAMES[2]}:'", f"chr(10) || '{_NAMES[3]}:'"

    def kept(initial: str, name: str, ways: list[tuple[str, int, str, str]]) -> list[str]:
        out = []
        for letter, ok, price, role in (("K", f"r.i = '{initial}'", 0, "r.role"), ("R", "true", 1, f"'{name}'")):
            for state, n, letters, inserted in ways:
                w = way(f"p.{state}", f"CASE WHEN r.must_go OR NOT {ok} THEN NULL ELSE {5 * n + price} + r.extra END", letters + letter, f"{inserted} || {line(role)}")
                out.append(w)
        return out

    to_user = [("n", 0, "", "''"), ("s", 0, "", "''"), ("a", 0, "", "''"), ("u", 1, "I", assistant)]
    to_assistant = [("u", 0, "", "''"), ("n", 1, "I", user), ("s", 1, "I", user), ("a", 1, "I", user)]
    keep_system = way("p.n", "CASE WHEN r.must_go OR r.i <> 's' THEN NULL ELSE r.extra END", "K", line("r.role"))
    none = "{'c': CAST(NULL AS BIGINT), 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS id,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM {conversations}),
hashed AS (
  SELECT k.* EXCLUDE (codes), xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), k.codes), lambda c, x: xor(t.crcs[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS d
  FROM keyed k, crc_table t),
hit AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, id, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE d <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hit),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
marked AS (
  SELECT *, role[1] AS i, body = '' AS is_blank, body <> '' AND again AS is_duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS is_truncated,
    body = '' OR again AS must_go, CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra
  FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate, count(*) FILTER (is_truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM marked GROUP BY conv_id),
priced AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS n_, {none} AS s_, {none} AS u_, {none} AS a_ FROM counts
  UNION ALL
  SELECT p.conv_id, r.n, {gone('p.n')}, {cheapest(gone('p.s'), keep_system)}, {cheapest(gone('p.u'), *kept('u', 'user', to_user))}, {cheapest(gone('p.a'), *kept('a', 'assistant', to_assistant))}
  FROM (SELECT conv_id, n AS at, n_ AS n, coalesce(s_, {none}) AS s, coalesce(u_, {none}) AS u, coalesce(a_, {none}) AS a FROM priced) p JOIN marked r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.at + 1),
ended AS (
  SELECT c.*, list_min(list_filter([p.n, p.a, {way('p.u', '5', 'I', assistant)}, {way('p.s', '10', 'II', f'{user} || {assistant}')}], lambda x: x.c IS NOT NULL)) AS best
  FROM counts c JOIN (SELECT conv_id, n AS at, n_ AS n, coalesce(s_, {none}) AS s, coalesce(u_, {none}) AS u, coalesce(a_, {none}) AS a FROM priced) p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.at)
SELECT i.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(e.best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) i LEFT JOIN ended e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
"""
