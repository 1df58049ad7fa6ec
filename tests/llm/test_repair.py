"""Conversation repair: the agenda against exhaustive search, the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm_fixtures import shared_folder  # noqa: F401

from shopcast.llm import repair as R

SF = "/root/testdata/sf0.001"


def all_repairs(rows):
    """Every repair with at most one insertion in a gap (two at the ends): (cost, audit, lines).  Rows: (role, text, fault)."""
    n = len(rows)
    gaps = [[""] + ["u", "a"] + (["ua", "au"] if i in (0, n) else []) for i in range(n + 1)]
    long = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*[("D",) if f == "B" else ("D", "K", "Ru", "Ra") for _, _, f in rows]):
        for added in itertools.product(*gaps):
            cost, audit, out = 0, "", []
            for i in range(n + 1):
                for c in added[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((c, f"{long[c]}:"))
                if i < n:
                    role, text, fault = rows[i]
                    e = edits[i]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if e != "D" and fault == "T" else 0)
                    if e == "K":
                        out.append((role[:1] or "?", f"{role}:{text}"))
                    elif e != "D":
                        out.append((e[1], f"{long[e[1]]}:{text}"))
            if re.fullmatch("(s?(ua)+)?", "".join(c for c, _ in out)):
                yield cost, audit, [x for _, x in out]


@pytest.mark.parametrize("n", range(4))
def test_agenda_equals_exhaustive_search(n):
    rng = random.Random(n)
    kinds = [(role, fault) for role in ("system", "user", "assistant", "tool", "") for fault in "BTK"]
    cases = list(itertools.product(kinds, repeat=n))
    for case in cases if len(cases) < 300 else rng.sample(cases, 120):
        rows = [(role, f"text {i}", fault) for i, (role, fault) in enumerate(case)]
        cost, audit, out = min(all_repairs(rows), key=lambda r: r[:2])
        shape = "".join((role[:1] or "?") + fault for role, _, fault in rows)
        got = R.lightest(shape, (R.START,), R.FINAL)[R.START]
        assert got == (cost, audit)
        assert list(R.lines([(None, role, text) for role, text, _ in rows], audit)) == out


def least(rows):
    """(cost, audit) by plain recursion from the last row, over whole audits, at most two insertions in a gap."""
    after = None
    for i in range(len(rows), -1, -1):
        here = []
        for p in range(4):
            found = [(0, "")] if i == len(rows) and p in R.FINAL else []
            if i < len(rows):
                role, fault = rows[i]
                more = 5 * (fault == "T")
                edits = [(2, "D", p)]
                if fault != "B":
                    edits += [(1 + more, "R", R.NEXT[p])] + [(more, "K", q) for q in [R.STEP.get((p, role))] if q is not None]
                found += [(after[q][0] + c, e + after[q][1]) for c, e, q in edits]
            here.append(min(found, default=(10 ** 9, "")))
        for _ in range(2):
            here = [min(here[p], (here[R.NEXT[p]][0] + 5, "I" + here[R.NEXT[p]][1])) for p in range(4)]
        after = here
    return after[R.START]


@pytest.mark.parametrize("seed", range(40))
def test_agenda_and_pieces_equal_recursion(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ssuuuuaaaa?"), rng.choice("BTKKKKKK")) for _ in range(rng.randint(0, 60))]
    shape = "".join(a + b for a, b in rows)
    want = least(rows)
    assert R.lightest(shape, (R.START,), R.FINAL)[R.START] == want
    # the same conversation in pieces
    cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 5)))
    pieces = []
    for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        pieces += list(R._weigh((1, k, i, i, a, b, b"%d" % (i + 100 * k)) for i, (a, b) in enumerate(rows[lo:hi]))) or [
            (1, k, [0] * 5, [None] * 2, [None] * 2, *piece_of_nothing())]
    got = list(R._combine(iter(pieces)))
    assert got[0][6:8] == want
    assert "".join(r[7] for r in got[1:]) == want[1]


def piece_of_nothing():
    costs, audits = [None] * 16, [None] * 16
    for q in range(4):
        for p, (cost, audit) in R.lightest("", range(4), (q,)).items():
            costs[4 * p + q], audits[4 * p + q] = cost, audit
    return costs, audits


def brute(rows):
    """The contract in plain Python, conversation by conversation."""
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        one = lambda v: " " if v is None else str(v)
        role, text, code = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        mine += [(turn is not None, turn or 0, role, digest, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, mine in found.items():
        mine.sort()
        seen, faults, roles = set(), [], []
        for _, _, role, _, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            roles.append(role[:1])
        code = ["B" if f in ("blank", "duplicate") else "T" if f else "K" for f in faults]
        cost, audit = least([(r or "?", c) for r, c in zip(roles, code, strict=True)])
        turns = [t for has, t, *_ in mine if has]
        text = "\n".join(R.lines([(None, role, text) for _, _, role, _, text in mine], audit))
        out.append((conv, min(max(turns) - min(turns) + 1 - len(set(turns)), R.LONG) if turns else 0, *(faults.count(f) for f in R.COUNTS[1:4]),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    for c in ("id", "part", "at", "digest", "copy", "code", "spread", "state", "audit", "cost", "gaps"):
        df = df.selectExpr("*", f"'{c}' AS {c}")
    got = R.repaired(df)
    assert got.columns == ["conv_id", *R.COUNTS, "audit", "repaired_sha256"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    key = lambda r: r[0]
    assert sorted(map(tuple, R.repaired(docs).collect()), key=key) == sorted(brute(rows), key=key)


def test_awkward_conversations(spark):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ünit"]
    texts = ["Yes.", "No", "", None, " \n\t", "Why? ", "é漢字!", "same.", "same.", "x" * 3000 + "."]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(c, t, r, x) for c in range(10, 60) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Hello.")]]
    rows += [(90, t, "user", "again.") for t in [4] * 30]                  # equal rows
    rows += [(91, -(1 << 63), "user", "a."), (91, (1 << 63) - 1, "assistant", "b.")]
    check(spark, rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rng = random.Random(8)
    text = lambda: rng.choice(["Yes.", "No.", "Well", "Long sentence number %d." % rng.randint(0, 400)])
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), text()) for t in range(700)]
    rows += [(100 + c, t, "user" if t % 2 == 0 else "assistant", text()) for c in range(200) for t in range(7)]
    check(spark, rows)


def test_long_texts_and_blobs(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "word " * 300_000 + ".") for t in range(6)]
    check(spark, rows, 2)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repaired(empty).collect() == []
