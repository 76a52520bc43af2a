"""Conversation structure repair: the cheapest edits that make the turns alternate, by dynamic programming over runs.

A row is a symbol: its role's initial (s, u, a or another) and its fault (none, blank, duplicate, truncated). The states
of ``(s?(ua)+)?`` are 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. The letter that may be inserted or
given by a new role follows from the state, so an audit of edit initials fixes the result.

1. Equal rows are counted before any shuffle; the rows without their texts are dealt by ranges of (conversation, turn), so
   that a very long conversation is shared by many tasks, and each task collapses what it has into runs of one symbol.
2. Per conversation the runs are advanced from the last to the first: a run of n rows is the min-plus product of the
   cached powers 2^k of its symbol's transition. Then the choices are unrolled from the first row on, halving each run with
   the same powers; the least letter that keeps the cost makes the audit.
3. The texts are dealt and sorted once, behind their conversation's audit, and hashed as a stream.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table
from citespark.session import cut_lineage

INF = 1 << 60
LETTERS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
NEXT = (2, 2, 3, 2)  # the state after an inserted turn or a new role: user behind all but user
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
END = (0, 10, 5, 0)  # what insertions at the end cost in each state
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
LEGAL = ("su", "ua", "au")


def steps(code: int, state: int):
    """(letter, cost, next state) of the edits that take the row itself, in the order of their letters."""
    letter, fault = (LETTERS + "x")[code // 4], code % 4
    yield "D", DELETE, state
    if fault in (0, 3):
        extra = TRUNCATED if fault == 3 else 0
        if (letter, state) in KEEP:
            yield "K", extra, KEEP[letter, state]
        yield "R", REROLE + extra, NEXT[state]


@cache
def power(code: int, k: int) -> tuple[tuple[int, ...], ...]:
    """Least costs from state to state over 2^k rows of one symbol, insertions before each row included."""
    if k == 0:
        rows = []
        for state in range(4):
            least, at = [INF] * 4, state
            for inserted in range(3):  # a third insertion would only come back to a state
                for _, cost, to in steps(code, at):
                    least[to] = min(least[to], inserted * INSERT + cost)
                at = NEXT[at]
            rows.append(tuple(least))
        return tuple(rows)
    half = power(code, k - 1)
    return tuple(tuple(min(half[a][m] + half[m][b] for m in range(4)) for b in range(4)) for a in range(4))


def advance(code: int, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end before n rows of one symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            after = tuple(min(row[m] + after[m] for m in range(4)) for row in power(code, k))
        n, k = n >> 1, k + 1
    return after


def unroll(code: int, n: int, state: int, after: tuple[int, ...], audit: list[str]) -> int:
    """Append the least letters of a cheapest way through n rows; the state behind them."""
    if n > 1:
        half = n // 2
        state = unroll(code, half, state, advance(code, n - half, after), audit)
        return unroll(code, n - half, state, after, audit)
    before = advance(code, 1, after)
    while True:
        ways = {letter: (cost, to) for letter, cost, to in steps(code, state)}
        if ways["D"][0] + after[state] == before[state]:
            audit.append("D")
            return state
        if INSERT + before[NEXT[state]] == before[state]:
            audit.append("I")
            state = NEXT[state]
            continue
        for letter in "KR":
            if letter in ways and ways[letter][0] + after[ways[letter][1]] == before[state]:
                audit.append(letter)
                return ways[letter][1]


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, audit) of runs (code, n) in order."""
    behind = [END]
    for code, n in reversed(runs):
        behind.append(advance(code, n, behind[-1]))
    cost, audit, state = behind.pop()[0], [], 0
    for code, n in runs:
        state = unroll(code, n, state, behind.pop(), audit)
    return cost, "".join(audit) + "I" * (END[state] // INSERT)


def illegal(runs: list[tuple[int, int]]) -> int:
    """Neighbouring rows whose initials are no legal pair; inside a run they are alike, so none is."""
    letters = [(LETTERS + "x")[code // 4] for code, _ in runs]
    return sum(n - 1 for _, n in runs) + sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, code, n): equal rows once, with their number; ``code`` of the first and of the others.

    A row beyond the first of its role and text in a conversation is a duplicate.
    """
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("key"), F.lit(1).cast("long").alias("copies"),
                       (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                       (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    slim = cut_lineage(slim.groupBy("conv_id", "turn", "role", "key", "blank", "cut").agg(F.sum("copies").alias("n")))
    first = slim.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"))  # a null turn comes first
    first = first.select(*[F.col(c).alias(f"_{c}") for c in first.columns])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("key") == F.col("_key"))
    both = slim.join(first, same).withColumn("new", F.col("turn").eqNullSafe(F.col("_first.turn")))
    letter = F.when(F.col("role").rlike(f"^[{LETTERS}]"), F.expr(f"instr('{LETTERS}', substring(role, 1, 1))") - 1).otherwise(3)
    code = letter * 4 + F.when(F.col("blank"), 1).when(~F.col("new"), 2).when(F.col("cut"), 3).otherwise(0)
    others = letter * 4 + F.when(F.col("blank"), 1).otherwise(2)
    return both.select("conv_id", "turn", "role", "key", "n", code.cast("int").alias("code"),
                       others.cast("int").alias("others"))


def join_runs(runs: list, code: int, n: int) -> None:
    if n and runs and runs[-1][0] == code:
        runs[-1] = (code, runs[-1][1] + n)
    elif n:
        runs.append((code, n))


def pieces(rows: DataFrame) -> DataFrame:
    """Runs of each conversation's rows in each task, with the first, least and greatest turn and their number."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "key")

    def run(batches):
        import pyarrow as pa

        none = object()
        conv, last, runs, found = none, none, [], []
        least = most = start = None
        turns = 0

        def piece():
            return (conv, start, [c for c, _ in runs], [n for _, n in runs], least, most, turns)

        def made(rows, kind):
            columns = list(zip(*rows)) or [()] * 7
            ids, turn = kind.field(0).type, kind.field(1).type
            types = [ids, turn, pa.list_(pa.int32()), pa.list_(pa.int64()), turn, turn, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["conv_id", "start", "codes", "counts", "least", "most", "turns"])

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in
                       ("conv_id", "turn", "n", "code", "others")]
            for key, turn, n, code, others in zip(*columns):
                if conv is none or key != conv:
                    if conv is not none:
                        found.append(piece())
                    conv, last, runs, start, turns = key, none, [], turn, 0
                    least = most = None
                if turn is not None and (last is none or turn != last):
                    least, most, turns = turn if least is None else least, turn, turns + 1
                last = turn
                join_runs(runs, code, 1)
                join_runs(runs, others, n - 1)
            if found:
                yield made(found, schema)
                found = []
        if conv is not none:
            yield made([piece()], schema)

    return bounded_batches(dealt.select("conv_id", "turn", "n", "code", "others")).mapInArrow(
        run, f"conv_id {kinds['conv_id']}, start {kinds['turn']}, codes array<int>, counts array<long>, "
             f"least {kinds['turn']}, most {kinds['turn']}, turns long")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plans(parts: DataFrame) -> DataFrame:
    """(conv_id, the figures, audit) of the pieces of all conversations."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    # Ranges of turns share no turn, so the pieces of a conversation follow each other by their first one, null first.
    whole = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "codes", "counts"))).alias("parts"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("turns").alias("turns"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.select(["parts", "least", "most", "turns"]).to_pylist():
                runs: list = []
                for part in row["parts"]:
                    for code, n in zip(part["codes"], part["counts"]):
                        join_runs(runs, code, n)
                faults = [sum(n for code, n in runs if code % 4 == f) for f in range(4)]
                gaps = row["most"] - row["least"] + 1 - row["turns"] if row["turns"] else 0
                out.append((gaps, *faults[1:], illegal(runs), *cheapest(runs)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())],
                ["conv_id", *FIGURES, "audit"])

    return bounded_batches(whole).mapInArrow(
        run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string")


class Repaired:
    """The repaired turns of one conversation, fed row by row, as a hash and on wish as lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, 0, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:".encode("utf-8", "surrogatepass"))
        self.hash.update(text.encode("utf-8", "surrogatepass"))
        self.any = True

    def given(self, text: str) -> None:
        self.state = NEXT[self.state]
        self.line("user" if self.state == 2 else "assistant", text)

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.given("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.given(text)
        elif edit == "K":
            self.state = KEEP[role[0], self.state]
            self.line(role, text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repair(rows: DataFrame, asked: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs, cost, audit and the hash of the repaired turns.

    ``asked``: rows with the same id column; conversations of theirs without any row get zeros, an empty audit and the
    hash of the empty string. Null roles and texts are one space; null turns come first; rows of one turn go by role
    and by the hash of their text, so equal rows stand side by side and are duplicates but for the first. Rows with a null
    id are one conversation. An empty table gives no rows; further columns are ignored. Texts of any length are read
    whole. A hash of one conversation is made in one task, as a stream; everything else of it is shared.
    """
    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    own = rows.select(column(conv_col).alias("conv_id"), column(turn_col).alias("turn"),
                      F.coalesce(column(role_col).cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(column(text_col).cast("string"), F.lit(" ")).alias("text"))
    kind = own.schema["conv_id"].dataType.simpleString()
    heads = plans(pieces(cut_lineage(symbols(own))))
    ids = (asked if asked is not None else rows).select(column(conv_col).alias("conv_id")).distinct()
    nothing = {c: F.lit(None).cast("long").alias(c) for c in FIGURES}
    turn, blank = own.schema["turn"].dataType, [F.lit(None).cast("string").alias(c) for c in ("role", "key", "text")]
    # One stream: the id, its audit, its rows.
    stream = ids.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast(turn).alias("turn"), *blank,
                        *nothing.values(), F.lit(None).cast("string").alias("audit")).unionByName(
        heads.select("conv_id", F.lit(1).alias("_kind"), F.lit(None).cast(turn).alias("turn"), *blank, *FIGURES, "audit"))
    stream = stream.unionByName(own.select(
        "conv_id", F.lit(2).alias("_kind"), "turn", "role", F.sha2("text", 256).alias("key"), "text",
        *nothing.values(), F.lit(None).cast("string").alias("audit")))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "key")

    def run(batches):
        import pyarrow as pa

        none = object()
        conv, figures, made, found, schema = none, None, None, [], None

        def batch_of(rows):
            columns = list(zip(*rows))
            types = [schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              ["conv_id", *FIGURES, "audit", "repaired_sha256"])

        for batch in batches:
            schema = batch.schema
            for key, kind, role, text, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if conv is none or key != conv:
                    if conv is not none:
                        found.append((conv, *figures, made.audit, made.digest()))
                    conv, figures, made = key, (0,) * 6, Repaired("")
                if kind == 1:
                    figures, made = rest[:6], Repaired(rest[6])
                elif kind == 2:
                    made.row(role, text)
            if found:
                yield batch_of(found)
                found = []
        if conv is not none:
            yield batch_of([(conv, *figures, made.audit, made.digest())])

    return bounded_batches(stream.select("conv_id", "_kind", "role", "text", *FIGURES, "audit")).mapInArrow(
        run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage of the contract, chosen by the checksum of ``conv_id:turn``."""
    space = F.lit(" ")
    spot = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    chosen = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                         (F.crc32(spot.cast("binary")) % 20).alias("_d")).where("_d != 0")
    return chosen.select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")).drop("_c")


#: The same by a forward search over single rows that carries each state's cheapest cost, audit and lines.
SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' ||
      coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1
      THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS d
  FROM conversations),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
after AS (
  SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS c
  FROM raw JOIN ids ON raw.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE d <> 0),
placed AS (
  SELECT g, turn, role, text,
         row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i FROM after),
known AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS again FROM placed),
named AS (
  SELECT *, left(role, 1) AS letter, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated'
    ELSE '' END AS fault FROM known),
figures AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(letter) OVER (PARTITION BY g ORDER BY i) AS before FROM named) GROUP BY g),
inserts AS (
  SELECT * FROM (VALUES
    (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
    (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])) AS v(s, t, fee, edits, lines)),
edits AS (
  SELECT * FROM (VALUES
    (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
    (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (2, 'R', '', 3, 1), (3, 'R', '', 2, 1)) AS v(t, edit, needs, goal, price)),
ways AS (
  SELECT g, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM ids
  UNION ALL
  SELECT w.g, w.i + 1, e.goal, min({
    'cost': w.best.cost + n.fee + e.price + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': w.best.audit || n.edits || e.edit,
    'lines': w.best.lines || n.lines || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text]
      ELSE [CASE e.goal WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END})
  FROM ways w JOIN named r ON r.g = w.g AND r.i = w.i + 1 JOIN inserts n ON n.s = w.state
  JOIN edits e ON e.t = n.t AND (e.needs = '' OR e.needs = r.letter)
    AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.g, w.i, e.goal),
ended AS (
  SELECT w.g, min({'cost': w.best.cost + n.fee, 'audit': w.best.audit || n.edits, 'lines': w.best.lines || n.lines}) AS best
  FROM ways w JOIN inserts n ON n.s = w.state AND n.t IN (0, 3)
  WHERE w.i = (SELECT count(*) FROM named r WHERE r.g = w.g) GROUP BY w.g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ids JOIN ended USING (g) LEFT JOIN figures USING (g)
"""


@query("op12_structure_repair", SQL)
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)
