"""Repair of conversations' structure at the least cost.

A conversation's roles should be ``(s?(ua)+)?`` by their initials. Edits: keep
a row (free), give it the role user or assistant (2), delete it (3; rows that
are blank or said before must go), put an empty turn of the user or assistant
anywhere (2); a truncated row that stays costs 1 more. Of the cheapest edits
those count whose initials (D, I, K, R), in order, are least as ASCII text.

The grammar has four states. What it costs at least to finish from each of them
is a vector; scanned from the last row to the first, a row turns a vector into
the one before it. Vectors less their least entry are few; each becomes a state
of an automaton the first time it is met, and its transitions are kept in a
table, so the scan is one look-up a row and its offsets sum to the cost. A trace
the other way follows the arcs that are tight, those whose cost and rest sum to
the vector's entry, the least letter first; its steps are kept in a table too.

A conversation is scanned in one task, as its audit is one text; of its rows
the scan holds two bytes each. Texts pass by as a stream.

Defined results: rows are in the order of (turn, role, text), nulls first; a
null role or text is one blank (so a null text is blank, and a null role fits
nowhere), a null conv_id is a conversation of its own, written as one blank in
hashes like a null turn; repeated rows are all there, and faults; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .prefix_trie import crc32_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. Where a kept row of each role leads.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
#: Where an inserted or renamed turn leads, and its role there.
GIVEN, GIVEN_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
DONE = (0, 3)
#: A row is one of these: (initial or "" for all others, whether truncated), or None if it must go.
SYMBOLS = (None, *[(i, t) for i in KEPT for t in (0, 1)])
_INFINITE = 1 << 40
#: White space and all else, as classes of a regular expression.
SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


class RepairAutomaton:
    """Cost vectors as states, made when first met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[list] = []  # by state and symbol: the state before that row and the offset, or None
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._state(self._closed([0 if q in DONE else _INFINITE for q in range(4)]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * len(SYMBOLS))
        return self.numbers[vector], least

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs from each state with inserts before the next row."""
        for _ in range(4):
            costs = [min(c, INSERT + costs[GIVEN[q]]) for q, c in enumerate(costs)]
        return costs

    @staticmethod
    def _arcs(vector: tuple[int, ...], symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost to the end, next state) of what can be done with a row, least letter first."""
        arcs = [("D-", DELETE + vector[q], q)]
        if SYMBOLS[symbol]:
            initial, truncated = SYMBOLS[symbol]
            to, extra = KEPT[initial][q], TRUNCATED * truncated
            if to is not None:
                arcs.append(("K-", KEEP + extra + vector[to], to))
            arcs.append(("R" + GIVEN_ROLE[q][0], REROLE + extra + vector[GIVEN[q]], GIVEN[q]))
        return arcs

    def _before(self, state: int, symbol: int) -> list[int]:
        vector = self.vectors[state]
        return self._closed([min(cost for _, cost, _ in self._arcs(vector, symbol, q)) for q in range(4)])

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.table[state][symbol]
        if found is None:
            found = self.table[state][symbol] = self._state(self._before(state, symbol))
        return found

    def scan(self, symbols: bytes) -> tuple[int, array]:
        """The least cost, and the state after each row (the last is the end)."""
        table, step, state, cost = self.table, self.step, self.end, 0
        states = array("H", [state])
        for x in reversed(symbols):
            state, offset = table[state][x] or step(state, x)
            cost += offset
            states.append(state)
        states.reverse()
        return cost + self.vectors[state][0], states[1:] if symbols else states

    def _edits(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """Inserts, and what is done with the row, from state q before it; two letters each: the edit's and its role's."""
        costs, done = self._before(state, symbol), ""
        while True:
            arcs = [*self._arcs(self.vectors[state], symbol, q), ("I" + GIVEN_ROLE[q][0], INSERT + costs[GIVEN[q]], GIVEN[q])]
            letters, _, to = min(a for a in arcs if a[1] == costs[q])
            done, q = done + letters, to
            if letters[0] != "I":
                return done, q

    def trace(self, symbols: bytes, states: array) -> Iterator[str]:
        """Each row's edits, and at last the inserts after all rows."""
        steps, q = self.steps, 0
        for x, state in zip(symbols, states):
            key = (state, x, q)
            if key not in steps:
                steps[key] = self._edits(*key)
            edits, q = steps[key]
            yield edits
        last = ""
        while q not in DONE:
            last, q = last + "I" + GIVEN_ROLE[q][0], GIVEN[q]
        yield last


def _initial() -> Column:
    return F.substring("role", 1, 1)


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; no null role or text) with their place, fault and symbol.

    pos from 1; fault blank, duplicate, truncated or null; symbol a number of
    ``SYMBOLS``; illegal if the roles of this row and the one before can't
    follow each other; new_turn if the turn isn't null nor that of the row before.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    pair = F.concat(F.lag(_initial()).over(order), _initial())
    placed = rows.select(
        "conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))).alias("new_turn"),
    )
    said = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos"))
    fault = (
        F.when(~F.col("text").rlike(OTHER), "blank").when(F.col("_said") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), "truncated")
    )
    symbol = F.lit(len(SYMBOLS) - 2)
    for k, initial in enumerate(list(KEPT)[:-1]):
        symbol = F.when(_initial() == initial, 1 + 2 * k).otherwise(symbol)
    must_go = F.col("fault").isin("blank", "duplicate")
    symbol = F.when(must_go, 0).otherwise(symbol + (F.coalesce(F.col("fault") == "truncated", F.lit(False))).cast("int"))
    return placed.withColumn("_said", said).withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).drop("_said")


_EDITS = "conv_id long, pos int, edits string, cost long"


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each row of conversations (conv_id, pos, symbol) that come one after the other; the row after the last has the cost."""
    automaton = RepairAutomaton()
    name, symbols = None, bytearray()

    def out():
        cost, states = automaton.scan(symbols)
        edits, n = list(automaton.trace(symbols, states)), len(symbols) + 1
        for at in range(0, n, 50_000):
            some = edits[at : at + 50_000]
            costs = [None] * len(some)
            if at + len(some) == n:
                costs[-1] = cost
            columns = ([name] * len(some), range(at + 1, at + len(some) + 1), some, costs)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], ["conv_id", "pos", "edits", "cost"])

    for batch in batches:
        for conv, pos, symbol in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if pos == 1:
                if symbols:
                    yield from out()
                name, symbols = conv, bytearray()
            symbols.append(symbol)
    if symbols:
        yield from out()


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edits, cost) of rows (conv_id, pos, symbol): the edits at each row and, after a conversation's last, its cost."""
    ordered = rows.select("conv_id", "pos", "symbol").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(_decided, _EDITS)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' cost, audit and digest, of their edits and texts (conv_id, edits, cost, role, text), each row's edits before it."""
    found: list = []
    audit, digest, lines, todo = bytearray(), hashlib.sha256(), 0, ""

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1

    def out():
        names = ("conv_id", "cost", "audit", "repaired_sha256")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    roles = {"u": "user", "a": "assistant"}
    for batch in batches:
        for conv, made, cost, role, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if made is not None:
                todo = made
                audit += made[::2].encode()
                for at in range(0, len(made), 2):
                    if made[at] == "I":
                        line(roles[made[at + 1]], "")
            elif todo[-2] != "D":
                line(role if todo[-2] == "K" else roles[todo[-1]], text)
            if cost is not None:
                found.append((conv, cost, audit.decode(), digest.hexdigest()))
                audit, digest, lines = bytearray(), hashlib.sha256(), 0
        if found:
            yield out()
            found = []


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of rows as ``with_faults`` gives, a written table."""
    none = F.lit(None).cast("string")
    made = edits(rows).select("conv_id", "pos", F.lit(0).alias("kind"), "edits", "cost", none.alias("role"), none.alias("text"))
    texts = rows.select("conv_id", "pos", F.lit(1).alias("kind"), none.alias("edits"), F.lit(None).cast("long").alias("cost"), "role", "text")
    ordered = made.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return ordered.select("conv_id", "edits", "cost", "role", "text").mapInArrow(_applied, "conv_id long, cost long, audit string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def repair(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text).

    ``convs`` lists conversations that have a row in any case, zeros if they have none here.
    """
    found = materialise(with_faults(rows))
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in COUNTS[1:4]]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps")
    counts = found.groupBy("conv_id").agg(gaps, *faults, F.count_if("illegal").alias("illegal"))
    both = counts.join(repaired(found).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    if convs is None:
        return both
    asked = convs.select(F.col("conv_id").alias("_conv"))
    whole = asked.join(both, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return whole.select(
        F.col("_conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _filled(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with one of five kinds of damage, by the crc32 of conv_id and turn: gone, emptied, without stops, doubled, of the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = turns.withColumn("_kind", F.crc32(key.cast("binary")) % 20).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _filled(table(spark, sf_dir, "conversations"))
    return repair(damaged(turns), turns.select("conv_id").distinct())


OP13_SQL = rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hit AS (
  SELECT *, {crc32_sql('name')} % 20 AS k FROM filled
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit)
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), said AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM placed
), faulty AS MATERIALIZED (
  SELECT conv_id, turn, role, text, pos, pair, left(role, 1) AS c,
    CASE WHEN NOT regexp_matches(text, '{OTHER}') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?]{SPACE}*$') THEN 'truncated' END AS fault FROM said
), symbol AS MATERIALIZED (
  SELECT conv_id, pos, role, text, c, CAST(coalesce(fault, '') = 'truncated' AS INT) AS t, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS ok FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), costs AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS f FROM counts
  UNION ALL
  SELECT conv_id, i, [least(b[1], 2 + g2), least(b[2], 2 + g2), g2, least(b[4], 2 + b[3])] FROM (
    SELECT *, least(b[3], 2 + b[4]) AS g2 FROM (
      SELECT s.conv_id, s.pos AS i, [
        least(3 + f[1], CASE WHEN ok THEN 2 + t + f[3] END, CASE WHEN ok AND c = 'u' THEN t + f[3] END, CASE WHEN ok AND c = 's' THEN t + f[2] END),
        least(3 + f[2], CASE WHEN ok THEN 2 + t + f[3] END, CASE WHEN ok AND c = 'u' THEN t + f[3] END),
        least(3 + f[3], CASE WHEN ok THEN 2 + t + f[4] END, CASE WHEN ok AND c = 'a' THEN t + f[4] END),
        least(3 + f[4], CASE WHEN ok THEN 2 + t + f[3] END, CASE WHEN ok AND c = 'u' THEN t + f[3] END)] AS b
      FROM costs x JOIN symbol s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.pos = x.i - 1))
), known AS MATERIALIZED (SELECT * FROM costs), arcs AS MATERIALIZED (
  SELECT a.conv_id, a.i, a.f, b.f AS v, role, text, c, t, ok FROM known a LEFT JOIN symbol s ON s.conv_id IS NOT DISTINCT FROM a.conv_id AND s.pos = a.i
    LEFT JOIN known b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1
), trace AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, CAST('' AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS line, 0 AS step FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN op = 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN q WHEN 'K' THEN kept ELSE given END, op,
    CASE op WHEN 'I' THEN given_role || ':' WHEN 'K' THEN role || ':' || text WHEN 'R' THEN given_role || ':' || text END, step FROM (
    SELECT *, CASE WHEN v IS NULL THEN 'I' WHEN 3 + v[q] = f[q] THEN 'D' WHEN 2 + f[given] = f[q] THEN 'I' WHEN ok AND t + v[kept] = f[q] THEN 'K' ELSE 'R' END AS op FROM (
      SELECT a.*, z.q, z.step + 1 AS step, CASE WHEN z.q = 3 THEN 4 ELSE 3 END AS given, CASE WHEN z.q = 3 THEN 'assistant' ELSE 'user' END AS given_role,
        CASE WHEN c = 's' AND z.q = 1 THEN 2 WHEN c = 'u' AND z.q IN (1, 2, 4) THEN 3 WHEN c = 'a' AND z.q = 3 THEN 4 END AS kept
      FROM trace z JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM z.conv_id AND a.i = z.i WHERE a.v IS NOT NULL OR z.q NOT IN (1, 4)))
), audits AS (
  SELECT conv_id, string_agg(op, '' ORDER BY step) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY step) FILTER (line IS NOT NULL), '')) AS repaired_sha256
  FROM trace GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(k.f[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN known k ON k.conv_id IS NOT DISTINCT FROM o.conv_id AND k.i = 1
"""
