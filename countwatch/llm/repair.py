"""Conversation structure repair, by depth-first branch and bound.

The rows of a conversation in order are edited so that the initials of their roles read ``(s?(ua)+)?``: Keep, Rerole (to
user or assistant), Delete, and Insert of an empty-text row, each at a price; blank and duplicate rows must go. The answer is the
least cost and, among the cheapest edits, the audit (the edits' initials in order) that is least in ASCII.

Conversations are put in order over all tasks and cut into pieces of ``PIECE`` rows at most, however long they are. A piece
is a string of codes. Its search keeps an explicit stack; a node is (rows read, state of the pattern). Suffix lower bounds, counted backwards
without audits, tell what a node must still cost. Children are pushed so that letters come off in ASCII order; so
of two ways to a node the later has the greater audit, and the table of the least cost per node, with the
incumbent, cuts every way that cannot win. The stack runs empty once optimality is proved; as the bounds are tight, that takes a number
of steps linear in the rows. Equal code strings in a task are
searched once.

A conversation in several pieces is searched per piece from every state to every state (4 x 4 answers); eight
neighbouring answers at a time are merged, (cost, audit) by (cost, audit), until one is left. Only the last step, a hash over all
repaired rows, follows a conversation from end to end, as a hash must: it streams sorted rows and holds a batch.

Nulls of role and text are one space (so a null text is blank, and a null role has an initial that fits nowhere); a null conv_id is a conversation of its
own; null turns come first. Rows of one turn follow by role and then by the text's sha256, so that repeated rows stand
together. A conversation without rows left has zeros, an empty audit and the hash of the empty text. An empty table
gives an empty result. Further columns are left out and may clash in name. ``gaps`` beyond the range of a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, stage, table
from countwatch.llm.ordering import in_order, pick
from countwatch.llm.sqltext import crc32

#: Rows of a conversation that one search sees.
PIECE = 1024
#: Answers merged at a time.
MERGE = 8
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: States of the pattern: nothing yet, after s, after u, after a. Nothing and after a may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a new user or assistant row, by state.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: The states that keeping a row of an initial leads to, by initial.
KEEP = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
NEVER = 1 << 60
SPACES = r"\x20\x09-\x0D"


def damage(talk: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` modulo 20; nulls but those of ids and turns become one space."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = talk.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind != 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, with ``at`` and ``key``, which equal rows of a conversation share."""
    def sized(c: str) -> Column:
        return F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))

    hashed = rows.withColumn("hash", F.sha2("text", 256)).withColumn(
        "key", F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), sized("role"), sized("text")), 256)
    )
    return in_order(hashed, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")], "talk").drop("hash")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, at, initial, fault) of ordered rows; faults are ``b``, ``d``, ``t`` or ``-``."""
    narrow = rows.select(
        "conv_id", "at", "key",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o").alias("initial"),
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), "b").when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), "t").otherwise("-").alias("fault"),
    )
    repeated = narrow.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = F.col("at") > F.col("first")
    fault = F.when(F.col("fault") == "b", "b").when(again, "d").otherwise(F.col("fault"))
    return narrow.join(repeated, "key", "left").select("conv_id", "at", "initial", fault.alias("fault"))


def pieces(codes: DataFrame, rows: int = PIECE) -> DataFrame:
    """(conv_id, piece, pieces, initials, faults): pieces count from 0 in a conversation and hold ``rows`` rows at most."""
    cut = codes.groupBy("conv_id", F.floor(F.col("at") / rows).alias("cut")).agg(F.sort_array(F.collect_list(F.struct("at", "initial", "fault"))).alias("m"))
    strings = cut.select("conv_id", "cut", F.concat_ws("", "m.initial").alias("initials"), F.concat_ws("", "m.fault").alias("faults"))
    of = Window.partitionBy("conv_id")
    return strings.select(
        "conv_id", (F.row_number().over(of.orderBy("cut")) - 1).cast("long").alias("piece"), F.count("*").over(of).alias("pieces"), "initials", "faults"
    )


def moves(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, price, next state) of the edits of a row in ASCII order of their letters, without inserts."""
    out = [("D", DELETE, state)]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        if (after := KEEP.get(initial, {}).get(state)) is not None:
            out.append(("K", more, after))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def bounds(initials: str, faults: str, ends: tuple[int, ...], tail: bool) -> list[list[int]]:
    """Lower bounds: what reaching one of ``ends`` after the last row costs at least, per rows read and state.

    ``tail``: whether rows may be inserted after the last row.
    """
    last = [0 if q in ends else NEVER for q in range(4)]
    table = [last if not tail else _inserted(last)]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        below = table[-1]
        table.append(_inserted([min(price + below[after] for _, price, after in moves(initial, fault, q)) for q in range(4)]))
    return table[::-1]


def _inserted(costs: list[int]) -> list[int]:
    out = list(costs)
    for _ in range(2):  # a third insert would come back to where the first led
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return out


@lru_cache(maxsize=4096)
def search(initials: str, faults: str, start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """The least (cost, audit) from ``start`` to one of ``ends``; None if there is none."""
    n = len(initials)
    least = bounds(initials, faults, ends, tail)
    if least[0][start] >= NEVER:
        return None
    reached = [[NEVER] * 4 for _ in range(n + 1)]  # the least cost with which each node was opened
    # The root's bound is the cost of a real way, whose audit is not known yet: the first incumbent.
    best, audit = least[0][start], None
    path: list[str] = []
    stack = [(0, start, 0, 0, "")]
    while stack:
        i, q, cost, depth, letter = stack.pop()
        hope = cost + least[i][q]
        # What comes later has a greater audit, so equal cost is not enough.
        if cost >= reached[i][q] or hope > best or (hope == best and audit is not None):
            continue
        reached[i][q] = cost
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        if i == n and q in ends:
            best, audit = cost, "".join(path)
        children = []
        if i < n:
            children = [(i + 1, after, cost + price, depth + 1, x) for x, price, after in moves(initials[i], faults[i], q)]
        if i < n or tail:
            children.append((i, NEXT[q], cost + INSERT, depth + 1, "I"))
        stack.extend(sorted(children, key=lambda c: c[4], reverse=True))
    return best, audit


def merged(left: list[tuple[int, str] | None], right: list[tuple[int, str] | None]) -> list[tuple[int, str] | None]:
    """Answers from state to state (row-wise 4 x 4) of two neighbours as one."""
    out = []
    for p in range(4):
        for r in range(4):
            ways = [(a[0] + b[0], a[1] + b[1]) for q in range(4) if (a := left[4 * p + q]) and (b := right[4 * q + r])]
            out.append(min(ways) if ways else None)
    return out


ANSWERS = "first string, last string, counts array<long>, costs array<long>, audits array<string>"


def _answer(out: dict[str, list], first: str, last: str, counts: list[int], answers: list) -> None:
    out["first"].append(first)
    out["last"].append(last)
    out["counts"].append(counts)
    out["costs"].append([a and a[0] for a in answers])
    out["audits"].append([a and a[1] for a in answers])


def _illegal(pairs: Iterator[str]) -> int:
    return sum(p not in ("su", "ua", "au") for p in pairs)


def _search_pieces(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("first", "last", "counts", "costs", "audits")}
            for piece, of, initials, faults in zip(*(b.column(c).to_pylist() for c in ("piece", "pieces", "initials", "faults")), strict=True):
                tail = piece == of - 1
                starts = (START,) if piece == 0 else range(4)
                answers: list[tuple[int, str] | None] = [None] * 16
                for p in starts:
                    if tail:  # where it ends does not matter any more, so the answer stands at START
                        answers[4 * p] = search(initials, faults, p, (START, AFTER_A), True)
                    else:
                        for q in range(4):
                            answers[4 * p + q] = search(initials, faults, p, (q,), False)
                pairs = (initials[i : i + 2] for i in range(len(initials) - 1))
                counts = [faults.count("b"), faults.count("d"), faults.count("t"), _illegal(pairs)]
                _answer(out, initials[0], initials[-1], counts, answers)
            yield _batch(id_type, b.column("conv_id"), b.column("piece"), out)

    return run


def _merge_pieces(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("first", "last", "counts", "costs", "audits")}
            for parts in b.column("parts").to_pylist():
                whole = None
                for x in parts:
                    answers = [None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True)]
                    if whole is None:
                        whole = (x["first"], x["last"], list(x["counts"]), answers)
                        continue
                    first, last, counts, before = whole
                    counts = [m + n for m, n in zip(counts, x["counts"], strict=True)]
                    counts[3] += _illegal(iter([last + x["first"]]))
                    whole = (first, x["last"], counts, merged(before, answers))
                _answer(out, *whole)
            yield _batch(id_type, b.column("conv_id"), b.column("piece"), out)

    return run


def _batch(id_type: pa.DataType, ids: pa.Array, piece: pa.Array, out: dict[str, list]) -> pa.RecordBatch:
    longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
    columns = [
        ids.cast(id_type), piece.cast(pa.int64()), pa.array(out["first"], pa.string()), pa.array(out["last"], pa.string()), pa.array(out["counts"], longs),
        pa.array(out["costs"], longs), pa.array(out["audits"], strings),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "first", "last", "counts", "costs", "audits"])


def solved(cut: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) from all pieces of each conversation."""
    id_type = cut.schema["conv_id"].dataType.simpleString()
    arrow = _arrow_type(cut)
    schema = f"conv_id {id_type}, piece long, {ANSWERS}"
    cut = stage(cut, "talk-pieces")
    most = cut.agg(F.max("pieces")).first()[0] or 0
    answers = arrow_map(cut, _search_pieces(arrow), schema)
    while most > 1:
        most = -(-most // MERGE)
        part = F.struct("piece", "first", "last", "counts", "costs", "audits")
        groups = answers.groupBy("conv_id", F.floor(F.col("piece") / MERGE).alias("up")).agg(F.sort_array(F.collect_list(part), True).alias("parts"))
        answers = stage(arrow_map(groups.select("conv_id", F.col("up").alias("piece"), "parts"), _merge_pieces(arrow), schema), "talk-merged")
    names = ("blank", "duplicate", "truncated", "illegal")
    return answers.select("conv_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(names)], F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))


def _arrow_type(df: DataFrame) -> pa.DataType:
    return df.select("conv_id").limit(0).toArrow().schema.field(0).type


def spelled(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that an audit makes of ``rows``."""
    state, letters = START, iter(audit)

    def new() -> str:
        nonlocal state
        state = NEXT[state]
        return "user" if state == AFTER_U else "assistant"

    for role, text in rows:
        while (x := next(letters)) == "I":
            yield new(), ""
        if x == "K":
            state = KEEP[role[:1]][state]
            yield role, text
        elif x == "R":
            yield new(), text
    for _ in letters:
        yield new(), ""


def _hash_stream(id_type: pa.DataType):
    """Over rows sorted by (conv_id, at), where the audit comes first: one (conv_id, repaired_sha256) per conversation."""

    def of(group: Iterator[tuple[str | None, str | None]], audit: str) -> str:
        digest, first = hashlib.sha256(), True
        for role, text in spelled(audit, group):
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        return digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True))
        held: list = []  # the first row of the next conversation

        def rest() -> Iterator[tuple[str, str]]:
            for r in rows:
                if r[3] is not None:
                    held.append(r)
                    return
                yield r[1], r[2]

        ids: list = []
        hashes: list[str] = []
        head = next(rows, None)
        while head is not None:
            group = rest()
            ids.append(head[0])
            hashes.append(of(group, head[3]))
            head = held.pop() if held else None
            if len(ids) == 10_000 or head is None:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
                ids, hashes = [], []

    return run


def repaired(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Per conv_id of ``originals``: gaps, faults, cheapest edits and the hash of the repaired rows of ``rows``."""
    rows = ordered(rows)
    answers = stage(solved(pieces(coded(rows))), "talk-answers")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        answers.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    )
    streamed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    hashes = arrow_map(streamed, _hash_stream(_arrow_type(rows)), f"conv_id {id_type}, repaired_sha256 string")
    wide = "decimal(38,0)"
    turns = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("*")).try_cast("long").alias("gaps"), F.count("*").alias("t_rows")
    )
    out = originals.select("conv_id").distinct()
    for part, c in ((answers, "a"), (hashes, "h"), (turns, "t")):
        renamed = part.withColumnRenamed("conv_id", f"{c}_id")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col(f"{c}_id")), "left").drop(f"{c}_id")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("t_rows").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return out.select(
        "conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired."""
    talk = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return repaired(damage(talk), talk)


OP13_SQL = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged
), coded AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM coded GROUP BY conv_id
), inserts(q, q2, k) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)
), moves(q, initial, letter, price, q2) AS (
  VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2),
    (0, NULL, 'R', 1, 2), (1, NULL, 'R', 1, 2), (2, NULL, 'R', 1, 3), (3, NULL, 'R', 1, 2), (0, NULL, 'D', 2, 0), (1, NULL, 'D', 2, 1), (2, NULL, 'D', 2, 2), (3, NULL, 'D', 2, 3)
), best AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT b.conv_id, c.pos, m.q2, min(b.cost + 5 * i.k + m.price + CASE WHEN m.letter <> 'D' AND c.fault = 't' THEN 5 ELSE 0 END),
    arg_min(b.audit || repeat('I', i.k) || m.letter, (b.cost + 5 * i.k + m.price + CASE WHEN m.letter <> 'D' AND c.fault = 't' THEN 5 ELSE 0 END, b.audit || repeat('I', i.k) || m.letter))
  FROM best b JOIN coded c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.pos = b.pos + 1 JOIN inserts i ON i.q = b.q
    JOIN moves m ON m.q = i.q2 AND (m.initial IS NULL OR m.initial = c.initial) AND (m.letter = 'D' OR c.fault IN ('t', '-'))
  GROUP BY b.conv_id, c.pos, m.q2
), chosen AS (
  SELECT b.conv_id, min(b.cost + 5 * i.k) AS cost, arg_min(b.audit || repeat('I', i.k), (b.cost + 5 * i.k, b.audit || repeat('I', i.k))) AS audit
  FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.pos JOIN inserts i ON i.q = b.q AND i.q2 IN (0, 3)
  GROUP BY b.conv_id
), letters AS (
  SELECT conv_id, letter, j, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS j FROM chosen WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), lines AS (
  SELECT l.conv_id, l.letter, l.o, c.role, CASE WHEN l.letter = 'I' THEN '' ELSE c.text END AS text,
    max(CASE WHEN l.o = 1 AND l.letter = 'K' AND c.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.pos = l.pos AND l.letter <> 'I' WHERE l.letter <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS sha
  FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated,
  coalesce(n.illegal, 0) AS illegal, coalesce(c.cost, 0) AS cost, coalesce(c.audit, '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
