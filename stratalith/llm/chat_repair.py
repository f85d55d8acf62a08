"""Repair of conversations: the cheapest edits that give role initials ``(s?(ua)+)?``.

A row of a conversation may be kept (0), given the role user or assistant (1),
or deleted (2); an empty row of user or assistant may be inserted anywhere (5).
A row whose text is blank, or whose role and text an earlier row has, must be
deleted; a truncated row that stays costs 5 more.  Of equally cheap edits those
with the least initials (D, I, K, R) in order are taken.

The dynamic programme runs over symbols, a role's initial with a fault, not
over texts.  Equal consecutive symbols are one run, and a run is advanced by
binary powers of the symbol's min-plus matrix, which are made once.  Matrices
are associative, so a conversation is cut into chunks of at most ``CHUNK``
rows, wherever the range partitions of the sorted symbols end: a chunk's
matrix is made in its own task, the matrices of a conversation (one for each
chunk) give the cost behind each chunk, each chunk unrolls its choices for
every state that it may be entered in, and the chunks' ends are chained.  So a
conversation of any length is worked on by many tasks; only its audit, a letter
for each row, is one value, since the result has it as one.

Texts are shuffled once, for the repaired rows; a task goes through them in
order and holds one row at a time.

Edge cases: a null role or text counts as one blank.  Rows are taken by turn,
nulls first, rows of a turn by role and then by the SHA-256 of their text.
Rows that repeat role and text are duplicates, in whichever turn.  A null
conversation id is a conversation of its own.  A text of any length is read
once.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

#: Rows of a conversation in one chunk.
CHUNK = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet, after s, after u, after a.  From a state the next row must be of the role NEXT leads to.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
S, U, A, OTHER = range(4)
#: Symbols: the class of a role, plus 4 if the row is truncated; DELETE for rows that must go.
DELETE = 8
FAR = 1 << 60
#: Cost behind the last row, with the rows that are still to be inserted.
END = (0, 10, 5, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def moves(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of one row, in the order of their letters."""
    yield "D", state, 2
    if symbol == DELETE:
        return
    kind, more = symbol % 4, 5 * (symbol // 4)
    if (kind == S and state == 0) or (kind == U and state != 2) or (kind == A and state == 2):
        yield "K", kind + 1, more
    yield "R", NEXT[state], 1 + more


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, *(x + v[k] for k, x in enumerate(row))) for row in a)


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else 5 if NEXT[i] == j else FAR for j in range(4)) for i in range(4))
    return times(one, times(one, one))


INSERTS = _inserts()


@cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2**k rows of a symbol, each with what may be inserted before it."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        for _, to, cost in moves(symbol, q):
            row[q][to] = min(row[q][to], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def run_matrix(symbol: int, count: int) -> Matrix:
    out = UNIT
    for k in range(count.bit_length()):
        if count >> k & 1:
            out = times(out, power(symbol, k))
    return out


def chunk_matrix(symbols: list[int], counts: list[int]) -> Matrix:
    out = UNIT
    for symbol, count in zip(symbols, counts):
        out = times(out, run_matrix(symbol, count))
    return out


@cache
def choices(symbol: int, after: Vector) -> tuple[Vector, int, tuple[tuple[str, int, int], ...]]:
    """One row before costs ``after`` (least 0): the costs before it with their least taken off, that least, and for each state (letters, next state, cost)."""
    full = applied(power(symbol, 0), after)

    def cheapest(q: int) -> tuple[str, int, int]:
        letters, spent = "", 0
        while True:
            found = {x: (to, cost) for x, to, cost in moves(symbol, q) if cost + after[to] == full[q]}
            if "D" not in found and 5 + full[NEXT[q]] == full[q]:
                letters, spent, q = letters + "I", spent + 5, NEXT[q]
                continue
            letter = min(found)
            return letters + letter, found[letter][0], spent + found[letter][1]

    least = min(full)
    return tuple(x - least for x in full), least, tuple(cheapest(q) for q in range(4))


def unrolled(symbols: list[int], counts: list[int], after: Vector, starts: tuple[int, ...] = (0, 1, 2, 3)) -> list[tuple[str, int, int]]:
    """(letters, last state, cost) of a chunk's rows for each first state, given the costs behind the chunk."""
    ends, least = [], min(after)
    v = tuple(x - least for x in after)
    for symbol, count in zip(reversed(symbols), reversed(counts)):  # the costs behind each run
        ends.append(v)
        v = applied(run_matrix(symbol, count), v)
        least = min(v)
        v = tuple(x - least for x in v)
    walks = [([], q, 0) for q in starts]
    for symbol, count, v in zip(symbols, counts, reversed(ends)):
        rows = []
        for _ in range(count):
            v, _, row = choices(symbol, v)
            rows.append(row)
        for k, (letters, q, cost) in enumerate(walks):
            for row in reversed(rows):
                piece, q, more = row[q]
                letters.append(piece)
                cost += more
            walks[k] = (letters, q, cost)
    return [("".join(letters), q, cost) for letters, q, cost in walks]


def _plain(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, key of the rows; equal rows have equal keys and stand together in this order."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))


def _marks(turns: DataFrame) -> DataFrame:
    """Rows without their texts: equal rows as one with their number n; fresh: the first of them has no earlier equal."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    rows = _plain(turns).select("conv", "turn", "role", "key", last.alias("last"))
    rows = rows.groupBy("conv", "turn", "role", "key", "last").agg(F.count("*").alias("n"))  # copies are counted before they are shuffled
    first = rows.groupBy("conv", "role", "key").agg(F.min(F.struct("turn")).alias("first"))
    r, f = rows.alias("r"), first.alias("f")
    same = F.col("r.conv").eqNullSafe(F.col("f.conv")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.key") == F.col("f.key"))
    initial = F.substring("r.role", 1, 1)
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    return r.join(f, same).select(
        "r.conv", "r.turn", "r.role", "r.key", kind.alias("kind"), "n", F.col("first.turn").eqNullSafe(F.col("r.turn")).alias("fresh"),
        (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut"))


_CHUNKS = "part int, seq int, symbols array<int>, counts array<long>, matrix array<long>, first int, last int, first_turn long, last_turn long, turns long, illegal long, blank long, duplicate long, truncated long"


def _chunks(marks: DataFrame, size: int) -> DataFrame:
    """The runs of each chunk with its matrix and what its ends need to be joined with the next."""
    kind = marks.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {_CHUNKS}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, out, target = TaskContext.get().partitionId(), 0, None, [], None

        def close() -> None:
            now["matrix"] = [x for row in chunk_matrix(now["symbols"], now["counts"]) for x in row]
            now.pop("rows")
            out.append(now)

        def fresh(conv, kind: int, turn: int | None) -> dict:
            return {"conv": conv, "part": part, "seq": seq, "symbols": [], "counts": [], "first": kind, "last": -1, "first_turn": turn, "last_turn": None, "turns": 0, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "rows": 0}

        for batch in batches:
            target = batch.schema.field("conv").type
            for conv, turn, kind, n, new, blank, cut_off in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "kind", "n", "fresh", "blank", "cut"))):
                first = 0 if blank or not new else 1
                for symbol, count in ((kind + 4 * cut_off, first), (DELETE, n - first)):
                    while count:
                        if now is not None and (now["conv"] != conv or now["rows"] >= size):
                            close()
                            now, seq = None, seq + 1
                        now = now or fresh(conv, kind, turn)
                        take = min(count, size - now["rows"])
                        now["illegal"] += take - (now["last"] < 0 or (now["last"], kind) in ((S, U), (U, A), (A, U)))
                        if turn is not None and turn != now["last_turn"]:
                            now["turns"] += 1
                            now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                        now["last"], now["last_turn"], count, now["rows"] = kind, turn, count - take, now["rows"] + take
                        now["truncated" if symbol >= 4 and symbol != DELETE else "blank" if blank else "duplicate"] += 0 if symbol < 4 else take
                        if now["symbols"] and now["symbols"][-1] == symbol:
                            now["counts"][-1] += take
                        else:
                            now["symbols"].append(symbol)
                            now["counts"].append(take)
            if len(out) >= 4096:
                yield _batch(out, f"{_CHUNKS}", target)
                out = []
        if now is not None:
            close()
        if out:
            yield _batch(out, _CHUNKS, target)

    order = ["conv", "turn", "role", "key"]
    rows = marks.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv", "turn", "kind", "n", "fresh", "blank", "cut").mapInArrow(cut, schema)


def _batch(rows: list[dict], names: str, conv: pa.DataType) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [("conv", conv), *((name, kinds[kind]) for name, kind in (x.split(" ") for x in names.split(", ")))]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in fields], [name for name, _ in fields])


def _behind(chunks: DataFrame) -> DataFrame:
    """after: the costs behind each chunk, of conversations with more than one."""
    many = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "matrix"))).alias("steps")).where("size(steps) > 1")
    names = "part int, seq int, after array<long>"

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = END
                for step in reversed(steps):
                    out.append({"conv": conv, "part": step["part"], "seq": step["seq"], "after": list(v)})
                    m = step["matrix"]
                    v = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), v)
            yield _batch(out, names, batch.column(0).type)

    return many.mapInArrow(back, f"conv {chunks.schema['conv'].dataType.simpleString()}, {names}")


def edits(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text): conv, gaps, blank, duplicate, truncated, illegal, cost and audit, the edits' letters.

    chunk: rows of a conversation that one task may take.
    """
    prepare(turns.sparkSession)
    chunks = table(_chunks(table(_marks(turns), "marks"), chunk), "chunks")
    conv = chunks.schema["conv"].dataType.simpleString()
    c, b = chunks.alias("c"), _behind(chunks).alias("b")
    same = F.col("c.conv").eqNullSafe(F.col("b.conv")) & (F.col("c.part") == F.col("b.part")) & (F.col("c.seq") == F.col("b.seq"))
    # b has a row for each chunk of conversations with more than one chunk; others end behind their only chunk.
    placed = c.join(b, same, "left").select("c.*", "b.after")
    stats = "first int, last int, first_turn long, last_turn long, turns long, illegal long, blank long, duplicate long, truncated long"
    names = f"part int, seq int, pieces array<string>, ends array<int>, costs array<long>, {stats}"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                walks = unrolled(r["symbols"], r["counts"], tuple(r["after"] or END), (0, 1, 2, 3) if r["after"] else (0,))
                r["pieces"], r["ends"], r["costs"] = ([w[k] for w in walks] for k in range(3))
            yield _batch(rows, names, batch.schema.field("conv").type)

    walked = placed.mapInArrow(choose, f"conv {conv}, {names}")
    whole = walked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "pieces", "ends", "costs", *(x.split(" ")[0] for x in stats.split(", "))))).alias("steps"))
    result = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q, cost, pieces, before = 0, 0, [], None
                row = {"conv": conv} | {x: sum(s[x] for s in steps) for x in ("blank", "duplicate", "truncated", "illegal")}
                seen, low = sum(s["turns"] for s in steps), None
                for s in steps:
                    pieces.append(s["pieces"][q])
                    cost, q = cost + s["costs"][q], s["ends"][q]
                    low = s["first_turn"] if low is None else low
                    if before:
                        row["illegal"] += (before["last"], s["first"]) not in ((S, U), (U, A), (A, U))
                        seen -= before["last_turn"] is not None and before["last_turn"] == s["first_turn"]
                    before = s
                row |= {"gaps": 0 if low is None else before["last_turn"] - low + 1 - seen, "cost": cost + END[q], "audit": "".join(pieces) + "I" * (END[q] // 5)}
                out.append(row)
            yield _batch(out, result, batch.column(0).type)

    return whole.mapInArrow(chain, f"conv {conv}, {result}")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv, position, edit (I, K or R), role, text; found is what edits() returned for turns.

    Rows of a conversation stand together and in order in one partition.
    """
    prepare(turns.sparkSession)
    none = F.lit(None)
    rows = _plain(turns).select("conv", F.lit(1).alias("what"), "turn", "role", "key", "text")
    audits = found.select("conv", F.lit(0).alias("what"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("key"), F.col("audit").alias("text"))
    both = audits.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "what", "turn", "role", "key").select("conv", "what", "role", "text")
    names = "position long, edit string, role string, text string"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, kind = [], 0, None
        conv = audit = None
        at = position = q = 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal position, size
            out.append({"conv": conv, "position": position, "edit": edit, "role": role, "text": text})
            position, size = position + 1, size + len(text)

        def insert() -> None:
            nonlocal at, q
            while at < len(audit) and audit[at] == "I":
                at, q = at + 1, NEXT[q]
                put("I", ROLES[q], "")

        for batch in batches:
            kind = batch.schema.field("conv").type
            for k in range(batch.num_rows):
                what, role, text = (batch.column(n)[k].as_py() for n in (1, 2, 3))
                if not what:
                    if audit is not None:
                        insert()
                    conv, audit, at, position, q = batch.column(0)[k].as_py(), text, 0, 0, 0
                else:
                    insert()
                    letter, at = audit[at], at + 1
                    if letter == "R":
                        q = NEXT[q]
                        put(letter, ROLES[q], text)
                    elif letter == "K":
                        q = "sua".index(role[0]) + 1
                        put(letter, role, text)
                if size > 1 << 20 or len(out) > 4096:
                    yield _batch(out, names, kind)
                    out, size = [], 0
        if audit is not None:
            insert()
        if out:
            yield _batch(out, names, kind)

    return both.mapInArrow(follow, f"conv {turns.schema['conv_id'].dataType.simpleString()}, {names}")


def digests(rows: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its ``role:text`` lines; rows as repaired() gives them, so that no row is shuffled."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = running = kind = None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for k in range(batch.num_rows):
                if batch.column(1)[k].as_py() == 0:
                    if running:
                        out.append({"conv": conv, "repaired_sha256": running.hexdigest()})
                    conv, running = batch.column(0)[k].as_py(), sha256()
                else:
                    running.update(b"\n")
                running.update(f"{batch.column(2)[k].as_py()}:{batch.column(3)[k].as_py()}".encode())
            yield _batch(out, "repaired_sha256 string", kind)
        if running:
            yield _batch([{"conv": conv, "repaired_sha256": running.hexdigest()}], "repaired_sha256 string", kind)

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.select("conv", "position", "role", "text").mapInArrow(hashed, f"conv {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Faults for trials, told by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes its role user."""
    def text(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit(" "))

    way = F.crc32(F.concat(text(F.col("conv_id")), F.lit(":"), text(F.col("turn")))) % 20
    rows = turns.select("conv_id", "turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"), way.alias("way")).where("way <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def trial(conversations: DataFrame) -> DataFrame:
    """Damages conversations, repairs them, and returns a row for each conv_id with its counts, cost, audit and the digest of its repaired rows."""
    rows = damaged(conversations)
    found = table(edits(rows), "edits")
    e, d, o = found.alias("e"), digests(repaired(rows, found)).alias("d"), conversations.select("conv_id").distinct().alias("o")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = o.join(e, F.col("o.conv_id").eqNullSafe(F.col("e.conv")), "left").join(d, F.col("o.conv_id").eqNullSafe(F.col("d.conv")), "left")
    return joined.select(
        "conv_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# One step of the programme over a row each: the best (cost, letters) of each state as text, cost first.
_STEP = """
    SELECT conv_id, i, q0, q1, q2, least(q3, {i3}) AS q3 FROM (
    SELECT conv_id, i, q0, q1, least(q2, {i0}, {i1}, {i2}) AS q2, q3 FROM ({rows})
    )"""


def _add(state: str, cost: str, letter: str) -> str:
    return f"(lpad(((left({state}, 12))::BIGINT + {cost})::VARCHAR, 12, '0') || substr({state}, 13) || '{letter}')"


def _closed(rows: str) -> str:
    return _STEP.format(rows=rows, i0=_add("q0", "5", "I"), i1=_add("q1", "5", "I"), i2=_add("q3", "5", "I"), i3=_add("q2", "5", "I"))


def _row(state: str, came: str) -> str:
    """The best way into a state by a row: deleted, kept or given a role."""
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    ways = [_add(f"w.{state}", "2", "D")]
    initial = {"q1": "s", "q2": "u", "q3": "a"}.get(state)
    for q in came.split():
        ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = '{initial}' THEN {_add('w.' + q, more, 'K')} END")
        if state != "q1":
            ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_add('w.' + q, '1 + ' + more, 'R')} END")
    return f"least({', '.join(ways)}) AS {state}"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE = rf"""
WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
b AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS way FROM a),
c AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN way = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM b WHERE way <> 0),
d AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
e AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
        i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong FROM d),
w(conv_id, i, q0, q1, q2, q3) AS (
  {_closed("SELECT DISTINCT conv_id, 0::BIGINT AS i, repeat('0', 12) AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM e")}
  UNION ALL
  {_closed(f"SELECT w.conv_id, e.i, {_row('q0', '')}, {_row('q1', 'q0')}, {_row('q2', 'q0 q1 q3')}, {_row('q3', 'q2')} FROM w JOIN e ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = w.i + 1")}
),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal FROM e GROUP BY conv_id),
best AS (SELECT n.*, least(q0, q3) AS best FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i),
letters AS (SELECT conv_id, p, substr(best, 12 + p, 1) AS x FROM (SELECT conv_id, best, unnest(range(1, length(best) - 11)) AS p FROM best)),
counted AS (SELECT *, count(*) FILTER (x <> 'I') OVER v AS i, count(*) FILTER (x <> 'D') OVER v AS o FROM letters WINDOW v AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT t.conv_id, t.p, t.x, t.o, e.role, e.text, coalesce(max(CASE WHEN t.x = 'K' AND e.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id), 0) AS system
      FROM counted t LEFT JOIN e ON t.x <> 'I' AND e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.i = t.i),
done AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
      FROM lines WHERE x <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 12)::BIGINT, 0) AS cost, coalesce(substr(best, 13), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
"""
