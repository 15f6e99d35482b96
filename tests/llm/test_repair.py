"""Conversation repair against trying all edits, and against its DuckDB text."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from countwatch.llm import repair
from oracle import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def tried(initials, faults, most=2):
    """The least (cost, audit) over all edits with up to ``most`` inserts in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(initials)):
        if any(f in "bd" and e != "D" for e, f in zip(edits, faults, strict=True)):
            continue
        price = sum({"K": 0, "D": 2, "R": 1}[e] + (5 if f == "t" and e != "D" else 0) for e, f in zip(edits, faults, strict=True))
        for gaps in itertools.product(range(most + 1), repeat=len(initials) + 1):
            cost = price + 5 * sum(gaps)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, ""), strict=True))
            roles = [r for e, r in zip(("", *edits), ("", *initials), strict=True) if e in ("K", "R")]
            kept = iter(zip([e for e in edits if e != "D"], roles, strict=True))
            marks = ["?" if x == "I" else r if e == "K" else "?" for x in audit if x != "D" for e, r in [next(kept) if x != "I" else ("I", "")]]
            if fits(marks) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def fits(marks):
    """Whether the free places (``?``: user or assistant) can be filled so that the initials are legal."""
    return any(
        LEGAL.fullmatch("".join(fill)) for fill in itertools.product(*[("u", "a") if m == "?" else (m,) for m in marks])
    )


@pytest.mark.parametrize("seed", range(40))
def test_search_against_all_edits(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 3)
    initials = "".join(rng.choice("suao") for _ in range(n))
    faults = "".join(rng.choice("--tbd") for _ in range(n))
    assert cheapest(initials, faults) == tried(initials, faults)
    assert repair.search(initials, faults, repair.START, (repair.START, repair.AFTER_A), True) == tried(initials, faults)


def cheapest(initials, faults):
    """The same by opening ways in the order of (cost, audit): the first whole legal one is the least."""
    heap, closed = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(initials) and last in ("", "a"):
            return cost, audit
        if (i, last) in closed:
            continue
        closed.add((i, last))
        new = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, new))
        if i < len(initials):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if faults[i] not in "bd":
                more = 5 if faults[i] == "t" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new))
                if initials[i] == new or (initials[i], last) == ("s", ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i]))


def shas(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def plain(rows):
    """The contract, row by row."""
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talk += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = "", set()
        for _, role, text in talk:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults += "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[1][:1] for r in talk]
        turns = [t for t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = cheapest(initials, faults)
        fixed = list(repair.spelled(audit, iter([(r, t) for _, r, t in talk])))
        assert LEGAL.fullmatch("".join(r[0] for r, _ in fixed))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, shas(fixed)))
    return sorted(out, key=str)


def fixed(spark, rows, schema=SCHEMA):
    talk = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in repair.repaired(repair.damage(pick(talk)), pick(talk)).collect()), key=str)


def pick(talk):
    from countwatch.llm.ordering import pick

    return pick(talk, "conv_id", "turn", "role", "text")


def test_against_the_contract(spark):
    rng = random.Random(5)
    roles, texts = ("system", "user", "assistant", "user", "assistant", "tool", "", None), ("One.", "Two!", "three", "", " \t", "One.", "four.\n ", None, "Why? ")
    rows = [
        (c if c else None, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 5))
    ]
    assert fixed(spark, rows) == plain(rows)


def test_ties_repeats_extremes_and_long_texts(spark):
    rows = [
        *[(1, 1, "user", "Same.")] * 3, (1, 1, "assistant", "Other."), (2, None, "system", "S."), (2, None, "user", "U."), (3, -5, "user", "far"), (3, 40, "assistant", "away."),
        (4, 1, "user", "Long. " * 100_000), (4, 2, "assistant", "word " * 100_000), (5, -(1 << 62), "user", "Low."), (5, (1 << 62) - 1, "assistant", "High."),
    ]
    assert fixed(spark, rows) == plain(rows)


def test_gaps_beyond_a_long_are_null(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    assert [r[1] for r in fixed(spark, [(1, low + 1, "user", "a."), (1, high, "assistant", "b.")])] == [None]


def test_pieces_give_what_whole_conversations_give(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(("system", "user", "assistant", "user", "assistant")), f"Text {t % 37}{rng.choice(('.', '.', ''))}") for c in range(6) for t in range(90)]
    talk = repair.damage(spark.createDataFrame(rows, SCHEMA))
    codes = repair.coded(repair.ordered(talk))
    whole, cut = (sorted(map(tuple, repair.solved(repair.pieces(codes, n)).collect())) for n in (1 << 20, 3))
    assert whole == cut and len(whole) == 6


def test_a_long_conversation_ends(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(30_000)]
    (got,) = fixed(spark, rows)
    assert len(got[7].replace("I", "")) == sum({0: 0, 3: 2}.get(zlib.crc32(f"1:{t}".encode()) % 20, 1) for t in range(30_000))


def test_no_row_left_empty_table_and_clashing_columns(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert fixed(spark, [(7, gone, "user", "x")]) == [(7, 0, 0, 0, 0, 0, 0, "", shas([]))]
    assert fixed(spark, []) == []
    rows = [(1, t, "user", f"A{t}.") for t in range(4)]
    wide = [(*r, "x", 1, "y") for r in rows]
    assert fixed(spark, wide, f"{SCHEMA}, ROLE string, kind int, at string") == plain(rows)


def test_query(spark, sf_small):
    assert difference(repair.op13_repair(spark, sf_small), connect(sf_small), repair.OP13_SQL) is None


def test_oracle_holds_on_hard_rows(spark):
    con = duckdb.connect()
    rng = random.Random(3)
    rows = [
        (c if c else None, t if rng.random() > 0.1 else None, rng.choice(("system", "user", "assistant", "tool", None)), rng.choice(("One.", "two", "", None, "Three!")))
        for c in range(40) for t in range(rng.randint(1, 8))
    ]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(repair.OP13_SQL).fetchall(), key=str) == fixed(spark, rows)
