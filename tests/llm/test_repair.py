"""Conversation repair: against all edit sequences on small cases, over several leaves and cells, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from prefmine.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\f\r"


def cheapest_of_all(codes, most=4):
    """Least (cost, audit) over every edit sequence with at most ``most`` insertions."""
    options = []
    for c in codes:
        more, low = int(c.isupper()), c.lower()
        choice = [(3, "D", "")]
        if c not in "xyzw":
            choice += [(2 + more, "R", r) for r in "ua"] + ([(more, "K", low)] if low != "o" else [])
        options.append(choice)
    best = None
    for n in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(codes) + 1), n):
            for roles in itertools.product("ua", repeat=n):
                gaps = [[] for _ in range(len(codes) + 1)]
                for p, r in zip(places, roles):
                    gaps[p].append((2, "I", r))
                for edits in itertools.product(*options):
                    line = [e for i, gap in enumerate(gaps) for e in [*gap, *edits[i : i + 1]]]
                    if PATTERN.match("".join(e[2] for e in line)):
                        found = (sum(e[0] for e in line), "".join(e[1] for e in line))
                        best = found if best is None or found < best else best
    return best


def best(cell):
    return min(cell[x] for x in repair.START if x in cell)


def test_the_chart_finds_the_cheapest_edits():
    rng = random.Random(1)
    cases = ["".join(p) for p in itertools.product("suaoyU", repeat=2)] + ["".join(rng.choice("suaoSUAOxyzw") for _ in range(3)) for _ in range(40)]
    for codes in cases:
        assert best(repair.chart(codes)) == cheapest_of_all(codes), codes
    for codes in ("suau", "aaya", "uuUs"):
        assert best(repair.chart(codes)) == cheapest_of_all(codes, 3), codes


def test_any_split_gives_the_same_cell():
    rng = random.Random(2)
    for n in (5, 8):
        for _ in range(20):
            codes = "".join(rng.choice("suaoSUAOxyzw") for _ in range(n))
            whole = repair.chart(codes)
            for k in range(1, n):
                assert repair.joined(repair.chart(codes[:k]), repair.chart(codes[k:])) == whole
    codes = "".join(rng.choice("suaoUAy") for _ in range(1000))
    assert repair.parsed(codes) == repair.joined(repair.parsed(codes[:333]), repair.parsed(codes[333:]))


def plain_report(rows):
    """The report of (conv_id, turn, role, text) rows, one conversation at a time."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        seen, codes, faults = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in own:
            said = text.rstrip(SPACE)
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += c.translate(str.maketrans("suao", "xyzw")) if fault in ("b", "d") else c.upper() if fault == "t" else c
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = best(repair.parsed(codes))
        lines, i, last = [], 0, ""
        for e in audit:
            if e in "IR":
                last = "a" if last == "u" else "u"
                lines.append(({"u": "user", "a": "assistant"}[last], own[i][3] if e == "R" else ""))
            elif e == "K":
                last = own[i][2][0]
                lines.append(own[i][2:])
            i += e != "I"
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        assert PATTERN.match("".join(r[0] for r, _ in lines)) and i == len(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit, digest)
    return out


def report(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


ODD = [
    (1, None, None, None), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 9, "tool", "x!"), (None, 1, "assistant", "A. \n"), (None, None, "user", "q?"),
    (2, 0, "system", "S."), (3, 5, "", ""), (3, 5, "umpire", "Out!"), (3, 5, "agent", "in"), (4, None, "user", "Z."), (4, None, "assistant", "z" * 100_000 + "."), (5, 2, "user", "　"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, None, 1) for r in ODD], "conv_id long, turn long, role string, text string, at string, cost int").repartition(3)
    assert report(repair.repair_report(df)) == plain_report(ODD)
    none = df.limit(0)
    assert repair.repair_report(none).count() == 0 and repair.damage_report(none).count() == 0


def test_damage_keeps_every_conversation(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Yes. No", "a!", None, "b"])) for c in [*range(150), None] for t in range(rng.choice([1, 2, 5]))]
    left = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        draw = zlib.crc32(f"{' ' if c is None else c}:{t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        left += [(c, t, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    want = plain_report(left)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = report(repair.damage_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}} and len(want) < len(got)


def test_a_long_conversation_over_many_leaves(spark, monkeypatch):
    """One conversation holds most rows; leaves of 4 rows, cells joined two at a time."""
    monkeypatch.setattr(repair, "LEAF_BITS", 2)
    monkeypatch.setattr(repair, "FAN", 2)
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(7, t, rng.choice(roles[: 2 + 2 * (t % 9 == 0)]), rng.choice([f"t{t}.", f"t{t}", "same.", ""])) for t in range(300)] + [(8, t, roles[t % 2], f"{t}.") for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert report(repair.repair_report(df)) == plain_report(rows)
