import hashlib
import random
import re
from itertools import product

import duckdb
import pytest

from citespark.llm import repair as rp

GOOD = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string, audit string, cost int, _kind int"


def brute(codes):
    """All edit strings with up to three insertions a place, by Dijkstra over (row, state), keeping the least (cost, audit)."""
    best = {(0, 0): (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(3):
            for s in range(4):
                if (i, s) in best:
                    cost, audit = best[i, s]
                    new = (cost + 5, audit + "I")
                    if new < best.get((i, rp.NEXT[s]), (10**9, "")):
                        best[i, rp.NEXT[s]] = new
        if i < len(codes):
            for s in range(4):
                if (i, s) in best:
                    cost, audit = best[i, s]
                    for letter, price, to in rp.steps(codes[i], s):
                        new = (cost + price, audit + letter)
                        if new < best.get((i + 1, to), (10**9, "")):
                            best[i + 1, to] = new
    return min(best[len(codes), s] for s in (0, 3) if (len(codes), s) in best)


def runs_of(codes):
    runs = []
    for c in codes:
        rp.join_runs(runs, c, 1)
    return runs


def test_all_short_and_many_long_sequences_are_brute_force():
    for n in range(4):
        for codes in product(range(16), repeat=n):
            assert rp.cheapest(runs_of(codes)) == brute(codes)
    rng = random.Random(1)
    for _ in range(400):
        codes = [c for _ in range(rng.randint(1, 12)) for c in [rng.choice([0, 4, 4, 8, 8, 12, 5, 7, 11, 6])] * rng.choice([1, 1, 2, 9, 40])]
        assert rp.cheapest(runs_of(codes)) == brute(codes)


def test_long_runs_take_few_products():
    cost, audit = rp.cheapest([(4, 100_000), (8, 100_000)])
    assert cost == 100_000 and len(audit) == 200_000  # every other row of a run gets the other role
    assert rp.advance(4, 1 << 40, rp.END)[0] == 1 << 39


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_are_plain_python(spark, partitions):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["Yes.", "No!", "so", "", " \t", None, "A? ", "Ü…"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles[:3] if rng.random() < .7 else roles), rng.choice(texts))
            for c in [*range(30), None] for _ in range(rng.randint(1, 14))]
    rows += [(99, k // 2, "user", "again.") for k in range(300)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS).repartition(partitions)
    got = {r["conv_id"]: r for r in rp.repair(df, spark.createDataFrame([(c,) for c in [*range(31), None, 99]], "conv_id long")).collect()}
    assert set(got) == {*range(31), None, 99}
    assert tuple(got[30])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for c in [*range(30), None, 99]:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c),
                     key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(q[2].encode()).hexdigest()))
        seen, codes = set(), []
        for _, role, text in own:
            words = text.strip("\t\n\v\f\r ")
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append("suax".index(role[:1] if role[:1] and role[:1] in "sua" else "x") * 4 + fault)
        cost, audit = brute(codes)
        turns = [t for t, _, _ in own if t is not None]
        letters = [(role[:1] or "?") for _, role, _ in own]
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [r[f] for f in rp.FAULTS[1:]] == [sum(k % 4 == f for k in codes) for f in (1, 2, 3)]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        lines, at, letter = [], iter(own), ""
        for edit in audit:
            given = "assistant" if letter.endswith("u") else "user"
            if edit == "I":
                lines.append(f"{given}:")
                letter += given[0]
                continue
            _, role, text = next(at)
            if edit != "D":
                lines.append(f"{given if edit == 'R' else role}:{text}")
                letter += lines[-1][0]
        assert GOOD.fullmatch(letter) and r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_empty_table(spark):
    assert rp.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(rp.SQL).fetchall()
    assert sorted(map(tuple, rp.op12(spark, "/root/testdata/sf0.01").collect())) == sorted(want)
