import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from marginscope.llm import conversation_repair as cr
from marginscope.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))


def fault_list(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, initial of the edit, role or None) of one row."""
    yield 2, "D", None
    if fault not in ("blank", "duplicate"):
        more = 5 if fault == "truncated" else 0
        yield more, "K", row[2]
        for role in ("user", "assistant"):
            yield 1 + more, "R", role


def by_enumeration(rows, faults):
    """Least (cost, audit) over every choice of edits with up to two insertions in each gap."""
    best = None
    gaps = [list(itertools.chain.from_iterable(itertools.product(("user", "assistant"), repeat=n) for n in range(3)))] * (len(rows) + 1)
    for picks in itertools.product(*[list(choices(r, f)) for r, f in zip(rows, faults)]):
        for fill in itertools.product(*gaps):
            roles, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                roles += fill[k]
                audit += "I" * len(fill[k])
                cost += 5 * len(fill[k])
                if k < len(rows):
                    cost += picks[k][0]
                    audit += picks[k][1]
                    roles += [picks[k][2]] if picks[k][2] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join((r[:1] or "_") for r in roles)) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def by_states(rows, faults):
    """The same row by row, over what the pattern may be waiting for."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def fill(now):
        for _ in range(3):
            for at, (cost, audit) in list(now.items()):
                for c in "ua":
                    if (at, c) in step:
                        new = (cost + 5, audit + "I")
                        now[step[at, c]] = min(new, now.get(step[at, c], new))
        return now

    now = fill({"": (0, "")})
    for row, fault in zip(rows, faults):
        new = {}
        for at, (cost, audit) in now.items():
            for c, edit, role in choices(row, fault):
                to = at if role is None else step.get((at, role[:1]))
                if to is not None:
                    one = (cost + c, audit + edit)
                    new[to] = min(one, new.get(to, one))
        now = fill(new)
    return min(now[x] for x in ("", "a") if x in now)


def slow(rows, everyone, parse=by_states):
    out = {}
    for conv in {r[0] for r in everyone}:
        mine = in_order([r for r in rows if r[0] == conv])
        faults = fault_list(mine)
        turns = {r[1] for r in mine} - {None}
        cost, audit = parse(mine, faults)
        texts, left, last = [], iter(mine), ""
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            role = row[2] if e == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            texts.append(f"{role}:{row[3] if row else ''}")
        seams = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(s not in ("su", "ua", "au") for s in seams), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op11_conversation_repair(spark, sf)
    assert dict(df.dtypes) == {"conv_id": "bigint", **dict.fromkeys(COLUMNS[:6], "bigint"), "audit": "string", "repaired_sha256": "string"}
    assert result(df) == slow(damaged(rows), rows)


def test_cells_equal_enumeration():
    rng = random.Random(3)
    kinds = [0, *range(1, 9)]
    for k in range(20):
        n = 1 + k % 3
        picked = [rng.choice(kinds) for _ in range(n)]
        rows, faults = [], []
        for k in picked:
            initial, cut = divmod(k - 1, 2) if k else (rng.randint(0, 3), 0)
            rows.append((0, 0, ["tool", "system", "user", "assistant"][initial], "x"))
            faults.append("blank" if k == 0 else "truncated" if cut else None)
        want = by_enumeration(rows, faults)
        assert cr.best(cr.parse([cr.row_cells(k) for k in picked])) == want == by_states(rows, faults)


def test_every_split_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(100):
        leaves = [cr.row_cells(rng.randint(0, 8)) for _ in range(rng.randint(2, 12))]
        whole = cr.parse(list(leaves))
        for at in range(1, len(leaves)):
            assert cr.combine(cr.parse(leaves[:at]), cr.parse(leaves[at:])) == whole


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, None, "who?"), (1, 3, "user", "same turn."), (1, 3, "user", "Same turn."),
        (2, None, "user", "no turn."), (2, None, "assistant", "none."), (2, 7, "", "no role."), (3, None, "user", "all null"), (None, 1, "user", "no id."), (None, None, "assistant", "x" * 100_000),
        (4, 0, "user", " ."), (4, 1, "umpire", "漢字😀!"), (4, 5, "assistant", " \t\n "), (-5, -3, "assistant", "late.\n"), (-5, 9, "user", "end? "),
        (6, -(2**63), "user", "a."), (6, 2**63 - 1, "assistant", "b."), (7, 1, "user", "."), (7, 1, "user", "."), (7, 2, "user", "."),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("audit", "place", "edit", "digest", "fault", "o", "n", "first", "kind"):
        df = df.withColumn(c, F.lit("mine"))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = slow(plain, rows)
    want[6] = (None, *want[6][1:])
    got = result(cr.report(df, df))
    assert {k: v for k, v in got.items() if k != 6} == {k: v for k, v in want.items() if k != 6}
    assert got[6][0] in (None, 2**64 - 2) and got[6][1:] == want[6][1:]
    assert result(cr.report(cr.damage(df.where("conv_id != 6 or conv_id is null")), df.where("conv_id != 6 or conv_id is null"))) == slow(damaged([r for r in rows if r[0] != 6]), [r for r in rows if r[0] != 6])
    # no rows left, and an empty table
    assert result(cr.report(df.where("false"), df.where("conv_id = 1"))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert cr.report(df.where("false"), df.where("false")).count() == 0


def test_one_long_conversation_over_many_tasks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "tool"]), rng.choice(["yes.", "no", "", f"turn {k}.", f"cut {k}"])) for k in range(3000)]
    rows += [(c, 0, "user", "hello.") for c in range(2, 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(cr.report(df, df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == slow(rows, rows)


def test_repaired_turns_are_well_formed(spark):
    df = cr.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    found = cr.diagnose(df).collect()
    turns = {}
    for r in sorted(cr.repaired(df, spark.createDataFrame(found)).collect(), key=lambda r: (r["conv_id"], r["place"])):
        turns.setdefault(r["conv_id"], []).append(r)
    for r in found:
        mine = turns.get(r["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in mine))
        assert "".join(t["edit"] for t in mine) == r["audit"].replace("D", "") and all(t["text"] == "" for t in mine if t["edit"] == "I")
