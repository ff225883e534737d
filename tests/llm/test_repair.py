"""The repair of conversations against a search that carries whole audits, and its parts against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lamella.llm import queries, repair

BLANK = "\x20\t\n\x0b\x0c\r"


def damage(table):
    """table: (conv_id, turn, role, text). Returns the rows of each conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in table:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if how == 4 else role
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(how, 1)
    digest = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:32].encode(), digest(x[2]))) for c, r in out.items()}


def fault_names(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired lines): all ways forward, by the roles' initials so far; equal costs by the audit itself."""
    legal = re.compile(r"(s|s?(ua)*u?|s?(ua)+)")
    best = {"": (0, "", ())}  # key: pattern's state as the last initial

    def better(d, key, value):
        if key not in d or value[:2] < d[key][:2]:
            d[key] = value

    def add(state, initial):
        whole = {"": "", "s": "s", "u": "u", "a": "ua"}[state] + initial
        return initial if legal.fullmatch(whole) else None

    def inserts(d):
        for _ in range(3):
            for state, (cost, said, lines) in list(d.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if (to := add(state, initial)) is not None:
                        better(d, to, (cost + 5, said + "I", (*lines, f"{role}:")))
        return d

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, said, lines) in inserts(best).items():
            better(new, state, (cost + 2, said + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] in ("s", "u", "a") and (to := add(state, role[:1])) is not None:
                better(new, to, (cost + more, said + "K", (*lines, f"{role}:{text}")))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if (to := add(state, initial)) is not None:
                    better(new, to, (cost + 1 + more, said + "R", (*lines, f"{name}:{text}")))
        best = new
    return min(v for k, v in inserts(best).items() if k in ("", "a"))


def expected(table):
    out, convs = {}, damage(table)
    for conv in {r[0] for r in table}:
        rows = convs.get(conv, [])
        faults, turns = fault_names(rows), [r[0] for r in rows if r[0] is not None]
        cost, said, lines = cheapest(rows, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def written(spark, tmp_path, table, extra=True):
    d = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    d = d.withColumns({c: F.lit(1) for c in ("copy", "part", "seq", "how", "kind", "__conv", "code")}) if extra else d
    d.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_whole_table(spark, sf):
    table = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    assert found(queries.op12_repair(spark, sf)) == expected(table)


@pytest.mark.parametrize("segment", [1 << 20, 3])
def test_random_conversations(spark, tmp_path, monkeypatch, segment):
    """All roles and faults, long runs and ties; then in segments of three runs, so that conversations span many."""
    rng = random.Random(3)
    table = []
    for conv in range(150):
        n = rng.choice((1, 2, 3, 8, 20, 60))
        roles, odds = rng.choice((("user",), ("user", "assistant"), ("system", "user", "assistant", "tool", "", None))), rng.random()
        for turn in range(n):
            text = rng.choice(("", " \t", None, "cut off", "Same.")) if rng.random() < odds else f"Text {rng.random()}" + rng.choice((".", "!", "", "? \n"))
            table.append((conv, rng.choice((turn, turn, None, 3)), rng.choice(roles), text))
    monkeypatch.setattr(repair, "SEGMENT", segment)
    where = written(spark, tmp_path, table)
    if segment > 3:
        assert found(queries.op12_repair(spark, where)) == expected(table)
        return
    rows_ = repair.damaged(spark.read.parquet(f"{where}/conversations.parquet"))
    parts = list(repair.faults(rows_).where("copy > 0").orderBy(F.col("conv_id").asc_nulls_first(), *repair._order(), "salt", "row").collect())
    codes = defaultdict(list)
    for r in parts:
        codes[r.conv_id].append(repair.symbol(r.kind, {"blank": 2, "duplicate": 2, "truncated": 1, None: 0}[r.fault]))
    want = expected(table)
    for conv, own in codes.items():  # cut anywhere, the pieces give the same cost and edits
        cuts = [own[i : i + 7] for i in range(0, len(own), 7)]
        behind = [repair.END]
        for c in reversed(cuts):
            flat = repair.summed(bytes(c), [1] * len(c))
            behind.append(repair.applied(tuple(flat[i : i + 4] for i in range(0, 16, 4)), behind[-1]))
        assert behind[-1][repair.EMPTY] == want[conv][5]
        said, q = "", repair.EMPTY
        for c, v in zip(cuts, reversed(behind[:-1]), strict=True):
            text, q = repair.unrolled(bytes(c), [1] * len(c), v, range(4))[q]
            said += text
        assert said + repair.closing(q) == want[conv][6]


def test_one_conversation_over_many_tasks(spark, tmp_path):
    """A conversation that holds most rows is cut into many tasks; equal rows and equal turns too."""
    rng = random.Random(4)
    table = [(7, None if i % 50 == 0 else i // 3, rng.choice(("user", "assistant", "system")), rng.choice(("Hi.", f"Text {i}.", f"open {i}"))) for i in range(3000)]
    table += [(i, 0, "user", f"Ask {i}?") for i in range(20, 40)] + [(8, 1, "user", "again.")] * 500
    where = written(spark, tmp_path, table)
    parts = repair.segments(repair.faults(repair.damaged(spark.read.parquet(f"{where}/conversations.parquet"))))
    assert parts.where("conv_id = 7").count() > 1 and parts.where("conv_id = 8").count() >= 1
    assert found(queries.op12_repair(spark, where)) == expected(table)


def test_runs_by_powers():
    """Long runs of one symbol cost what as many single steps cost."""
    for code in range(12):
        for length in (1, 2, 3, 17, 1000):
            v = repair.END
            for _ in range(length):
                v = repair.applied(repair.power(code, 0), v)
            got, base = repair.before(code, length, repair.END)
            assert tuple(x + base for x in got) == v
            flat = repair.summed(bytes([code]), [length])
            assert repair.applied(tuple(flat[i : i + 4] for i in range(0, 16, 4)), repair.END) == v
            assert len(repair.unrolled(bytes([code]), [length], repair.END, range(1))[0][0].replace("I", "")) == length


def test_cases(spark, tmp_path):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    table = [(5, dropped, "user", "Gone."), (None, None, None, None), (None, 3, "user", "No id."), (6, 1, "user", "long. " * 300_000), (6, 2, "assistant", "Yes."), (6, 2, "assistant", "Yes."), (9, 10**12, "system", "Only."), (9, 1, "", "x.")]
    where = written(spark, tmp_path, table)
    got = found(queries.op12_repair(spark, where))
    assert got == expected(table)
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.read.parquet(f"{where}/conversations.parquet").limit(0).write.parquet(f"{where}/none/conversations.parquet")
    assert queries.op12_repair(spark, f"{where}/none").count() == 0
