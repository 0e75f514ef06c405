"""Conversation structure repair by a run-length dynamic programme.

A row of a conversation is a symbol: its role's initial (s, u, a or another), a capital where the row is truncated, or b (blank) or d (duplicate), which
must be deleted. The roles of a repaired conversation read ``(s?(ua)+)?``; four states tell how far such a reading has come. A symbol is a min-plus
matrix over these states, insertions before the row included. Equal consecutive symbols collapse to a run, which advances the costs by the
binary powers of its matrix; the powers are cached. The choices are unrolled from the front with the costs of what is left:
of the edits on a cheapest way the letter that comes first in ASCII. Blocks of 2**k equal rows are unrolled once for each state and
relative costs and cached too.

Rows are ordered by conversation, turn (nulls first), role and text in one range shuffle, so a conversation of any length is dealt over tasks. Those that lie
whole in a task are repaired there. The others, at the borders of tasks or longer than ``PIECE_ROWS`` or ``PIECE_BYTES``, are cut into pieces: first
occurrences are found by partial sums, pieces become matrices, the matrices of a conversation (128 bytes for a piece) give the costs behind each
piece, and the states after each piece, for every state before it, give the state that each one begins in; then pieces are unrolled apart.

repaired() gives one row for a conversation, or several ``part`` rows in order for one that was cut, with roles and texts as they are after the
repair: no value holds more than a piece. Only op11's digests (one hash and one audit for a whole conversation) go through the parts in order, in a
stream that holds the audit and the state of the hash.

Nulls in role and text count as one space, a null turn stands first and isn't counted in gaps, rows with a null id are one conversation. Rows with
one turn are ordered by role and text, so copies of a row stand together and the first one isn't a duplicate. Roles other than the three, and the empty
one, can't stay. Texts of any length are handled whole. Columns beside the four aren't used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasswell.llm.common import CHUNK_BYTES, Scratch, table

PIECE_ROWS, PIECE_BYTES = 1 << 12, CHUNK_BYTES
SPACE = " \t\n\v\f\r"

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or renamed turn leads: a user's, or an assistant's after a user's.
TURN = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DELETE, INSERT, RENAME, TRUNCATED = 3, 2, 2, 1
#: What the insertions behind the last row cost.
ENDS = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}


def edits_of(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """The edits of one row by letter: letter, cost, state after it."""
    found = [("D", DELETE, state)]
    if symbol not in "bd":
        extra = TRUNCATED if symbol.isupper() else 0
        if state in KEPT.get(symbol.lower(), ()):
            found.append(("K", extra, KEPT[symbol.lower()][state]))
        found.append(("R", RENAME + extra, TURN[state]))
    return found


def times(m: tuple, v: tuple) -> tuple:
    """The costs before, from those after (min-plus)."""
    return tuple(min(a + b for a, b in zip(row, v, strict=True)) for row in m)


@lru_cache(maxsize=1 << 10)
def power(symbol: str, k: int) -> tuple:
    """The min-plus matrix of 2**k rows of one symbol: least cost from state to state."""
    if k:
        half = power(symbol, k - 1)
        columns = [times(half, c) for c in zip(*half, strict=True)]
        return tuple(tuple(min(x, NEVER) for x in row) for row in zip(*columns, strict=True))
    out = []
    for s in range(4):
        costs, at, paid = [NEVER] * 4, s, 0
        for _ in range(4):  # after four insertions the states come again
            for _, cost, t in edits_of(symbol, at):
                costs[t] = min(costs[t], paid + cost)
            at, paid = TURN[at], paid + INSERT
        out.append(tuple(costs))
    return tuple(out)


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def before(runs: Iterable[tuple[str, int]], v: tuple) -> tuple:
    """The costs before the runs, from those after."""
    for symbol, n in reversed(list(runs)):
        for k in range(n.bit_length()):
            if n >> k & 1:
                v = times(power(symbol, k), v)
    return v


def matrix(symbols: str) -> list[list[int]]:
    runs = runs_of(symbols)
    columns = [before(runs, tuple(0 if s == t else NEVER for s in range(4))) for t in range(4)]
    return [[min(x, NEVER) for x in row] for row in zip(*columns, strict=True)]


def relative(v: tuple) -> tuple:
    return tuple(x - min(v) for x in v)


@lru_cache(maxsize=1 << 14)
def block(symbol: str, k: int, state: int, v: tuple) -> tuple[str, int]:
    """The letters of 2**k rows of one symbol and the state after them; v: relative costs after them."""
    if k:
        first, state = block(symbol, k - 1, state, relative(times(power(symbol, k - 1), v)))
        second, state = block(symbol, k - 1, state, v)
        return first + second, state
    here, letters = times(power(symbol, 0), v), ""
    while True:
        found = [(letter, t) for letter, cost, t in edits_of(symbol, state) if cost + v[t] == here[state]]
        if found[:1] and found[0][0] == "D":
            return letters + "D", state
        if INSERT + here[TURN[state]] == here[state]:
            letters, state = letters + "I", TURN[state]
        else:
            return letters + found[0][0], found[0][1]


def unrolled(symbols: str, state: int, v: tuple) -> tuple[str, int]:
    """The letters of the cheapest edits, least in ASCII, and the state after them; v: costs after the rows."""
    todo = []
    for symbol, n in reversed(runs_of(symbols)):
        for k in range(n.bit_length()):
            if n >> k & 1:
                todo.append((symbol, k, relative(v)))
                v = times(power(symbol, k), v)
    letters = []
    for symbol, k, after in reversed(todo):
        some, state = block(symbol, k, state, after)
        letters.append(some)
    return "".join(letters), state


def closing(state: int) -> str:
    return "I" * (ENDS[state] // INSERT)


def symbol_of(role: str, text: str, seen: bool) -> str:
    bare = text.rstrip(SPACE)
    if not bare or seen:
        return "d" if bare else "b"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if bare[-1] in ".!?" else initial.upper()


def edited(rows: list[tuple], letters: str, state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of the rows (turn, role, text), from a state on."""
    roles, texts, at = [], [], 0
    for letter in letters:
        if letter in "IR":
            state = TURN[state]
            roles.append(NAMES[state])
            texts.append("" if letter == "I" else rows[at][2])
        elif letter == "K":
            state = KEPT[rows[at][1][0]][state]
            roles.append(rows[at][1])
            texts.append(rows[at][2])
        at += letter != "I"
    return roles, texts


PART = "part long, whole boolean, symbols string, edits string, roles array<string>, texts array<string>, illegal long, turns long, low long, high long, first string, last string"


def part_of(rows: list[tuple], symbols: str, letters: str, state: int) -> tuple:
    """What a part tells of its rows (turn, role, text): repaired roles and texts, illegal neighbours, distinct, least and last turn, initials at both ends."""
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    return (symbols, letters, *edited(rows, letters, state), illegal, len(turns), min(turns, default=None), max(turns, default=None), initials[0], initials[-1])


def _told(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(arrow), arrow, strict=True)], schema=arrow)


def _by_conversation(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Parts of the conversations that lie whole in a task, and the rows of all others (place: their order; piece: the place of the first row of theirs)."""
    conv = rows.schema["conv_id"].dataType
    kinds = "turn long, role string, text string, place long, piece long"
    out = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(f"{PART}, {kinds}").fields])
    n_part, n_row = len(T.StructType.fromDDL(PART)), len(T.StructType.fromDDL(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        held, size, cut, now, begun, ready, piece, room, space = [], 0, True, None, False, [], 0, 0, 0

        def opened() -> None:
            """The rows held go to the rows of cut conversations."""
            nonlocal held, size, place, piece, room, space
            for x in held:
                if room <= 0 or space <= 0:
                    piece, room, space = place, PIECE_ROWS, PIECE_BYTES
                ready.append((now, *[None] * n_part, *x, place, piece))
                place, room, space = place + 1, room - 1, space - len(x[2])
            held, size = [], 0

        def closed() -> None:
            nonlocal held, size, place, room
            if cut:
                opened()
            elif held:
                seen: set = set()
                symbols = ""
                for _, role, text in held:
                    symbols += symbol_of(role, text, (role, text) in seen)
                    seen.add((role, text))
                letters, state = unrolled(symbols, START, ENDS)
                ready.append((now, place, True, *part_of(held, symbols, letters + closing(state), START), *[None] * n_row))
                place += 1
            held, size, room = [], 0, 0

        weight = 0
        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != now:
                    closed()
                    now, cut, begun = conv_id, not begun, True
                for _ in range(copies):
                    held.append((turn, role, text))
                    size += len(text)
                    weight += len(text) + 100
                    if cut or len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                        cut = True
                        opened()
                if weight >= CHUNK_BYTES:
                    yield _told(ready, out)
                    ready.clear()
                    weight = 0
        cut = True  # the last one may go on in the next task
        closed()
        yield _told(ready, out)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    both = scratch.keep("conversations", sorted_.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, out))
    names = [f.name for f in T.StructType.fromDDL(PART)]
    return both.where("whole").select("conv_id", *names), both.where("whole is null").select("conv_id", "turn", "role", "text", "place", "piece")


def _in_pieces(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Parts of the conversations that are cut."""
    conv = rows.schema["conv_id"].dataType

    def mapped(df: DataFrame, columns: list[str], made: str, f) -> DataFrame:
        """conv_id and piece with the columns that f(values of the named columns) gives."""
        schema = T.StructType([T.StructField("conv_id", conv), T.StructField("piece", T.LongType()), *T.StructType.fromDDL(made).fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 16):
                    some = batch.slice(a, 16).to_pylist()
                    yield _told([(x["conv_id"], x["piece"], *f(*(x[c] for c in columns))) for x in some], schema)

        return df.select("conv_id", "piece", *columns).mapInArrow(run, schema)

    def along(df: DataFrame, column: str, made: str, f) -> DataFrame:
        """f(the column's values of a conversation's pieces, in order) gives a row for each piece."""
        lists = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", column))).alias("x"))
        schema = T.StructType([T.StructField("conv_id", conv), T.StructField("piece", T.LongType()), *T.StructType.fromDDL(made).fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    yield _told([(x["conv_id"], p["piece"], *y) for p, y in zip(x["x"], f([p[column] for p in x["x"]]), strict=True)], schema)

        return lists.mapInArrow(run, schema)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """By piece alone: no two conversations share one."""
        return a.join(b.drop("conv_id"), "piece")

    same = [F.col("conv_id").eqNullSafe(F.col("c")), F.col("role") == F.col("r"), F.col("digest") == F.col("d")]
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    symbol = F.when(bare == "", "b").when(F.col("place") > F.col("first"), "d").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    marked = rows.join(firsts, same, "left").select("conv_id", "piece", "place", symbol.alias("symbol"))
    symbols = marked.groupBy("conv_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x.symbol), "").alias("symbols"))
    pieces = scratch.keep("pieces", symbols)

    def costs_behind(matrices: list) -> list:
        v, out = ENDS, []
        for m in reversed(matrices):
            out.append((v,))
            v = times(m, v)
        return out[::-1]

    def begins(exits: list) -> list:
        state, out = START, []
        for i, x in enumerate(exits):
            out.append((state, i == len(exits) - 1))
            state = x[state]
        return out

    behind = along(mapped(pieces, ["symbols"], "m array<array<long>>", lambda s: (matrix(s),)), "m", "v array<long>", costs_behind)
    known = scratch.keep("known", met(pieces, behind))
    exits = mapped(known, ["symbols", "v"], "exits array<int>", lambda s, v: ([unrolled(s, state, tuple(v))[1] for state in range(4)],))
    entered = scratch.keep("entered", met(known, along(exits, "exits", "state int, final boolean", begins)))
    whole = rows.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("x"))

    def repaired_piece(symbols: str, v: list, state: int, final: bool, x: list) -> tuple:
        letters, after = unrolled(symbols, state, tuple(v))
        return (False, *part_of([(r["turn"], r["role"], r["text"]) for r in x], symbols, letters + (closing(after) if final else ""), state))

    parts = mapped(entered.join(whole, "piece"), ["symbols", "v", "state", "final", "x"], PART.removeprefix("part long, "), repaired_piece)
    return parts.withColumnRenamed("piece", "part")


def repaired(rows: DataFrame) -> DataFrame:
    """The parts of each conversation of rows (conv_id, turn, role, text and, where there, copies): conv_id and the columns of ``PART``. whole: the
    conversation's only part; symbols: one for each row; edits: K(eep), R(erole), D(elete) for each, and I(nsert); roles, texts: what stands after them."""
    scratch = Scratch(rows.sparkSession)
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    whole, others = _by_conversation(plain.where("copies > 0"), scratch)
    return whole.unionByName(_in_pieces(others, scratch))


def count_of(letters: str) -> Column:
    return sum((F.length("symbols") - F.length(F.replace("symbols", F.lit(x), F.lit(""))) for x in letters), F.lit(0)).cast("long")


def cost() -> Column:
    """Of a part, from its edits and symbols: rows that are truncated and not deleted cost one more."""
    number = lambda x: F.length("edits") - F.length(F.replace("edits", F.lit(x), F.lit("")))
    rowwise = F.replace("edits", F.lit("I"), F.lit(""))
    kept = F.size(F.filter(F.sequence(F.lit(1), F.length("symbols")), lambda i: F.substring("symbols", i, F.lit(1)).isin("S", "U", "A", "O") & (F.substring(rowwise, i, F.lit(1)) != "D")))
    return (DELETE * number("D") + INSERT * number("I") + RENAME * number("R") + TRUNCATED * kept).cast("long")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(parts: DataFrame) -> DataFrame:
    """Digests of the conversations in several parts, which pass in order."""
    schema = T.StructType([parts.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        sums, audit, told, low, high, turns, last, empty = [0] * 5, [], hashlib.sha256(), None, None, 0, None, True

        def digest() -> tuple:
            return now, 0 if low is None else high - low + 1 - turns, *sums, "".join(audit), told.hexdigest()

        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if begun and x["conv_id"] != now:
                    yield _told([digest()], schema)
                if not begun or x["conv_id"] != now:
                    now, begun, sums, audit, told, low, high, turns, last, empty = x["conv_id"], True, [0] * 5, [], hashlib.sha256(), None, None, 0, None, True
                for k, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                    sums[k] += x[c]
                sums[3] += last is not None and last + x["first"] not in ("su", "ua", "au")
                last = x["last"]
                audit.append(x["edits"])
                if x["low"] is not None:
                    turns += x["turns"] - (high == x["low"])
                    low, high = x["low"] if low is None else low, x["high"]
                for role, text in zip(x["roles"], x["texts"], strict=True):
                    told.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
        if begun:
            yield _told([digest()], schema)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of ``DIGEST`` for every conversation of rows; one whose rows all have no copies has none left."""
    parts = repaired(rows).withColumns({"blank": count_of("b"), "duplicate": count_of("d"), "truncated": count_of("SUAO"), "cost": cost()})
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    at_once = parts.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    found = at_once.unionByName(_streamed(parts.where("not whole"))).withColumnRenamed("conv_id", "c")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    ends = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumns(zeros | ends)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as op11's contract damages them, with their copies."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    crc = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        crc.append(i)
    edges = []
    for symbol in "suaoSUAObd":
        for state in range(4):
            at, lines = state, []
            for n in range(4):
                edges += [f"('{symbol}', {state}, {t}, {INSERT * n + c}, '{'I' * n}{letter}', {lines}::VARCHAR[], {dict(D=0, K=1, R=t)[letter]})" for letter, c, t in edits_of(symbol, at)]
                at = TURN[at]
                lines = [*lines, f"{NAMES[at]}:"]
    ends = ", ".join(f"({s}, {ENDS[s]}, '{closing(s)}', {l}::VARCHAR[])" for s, l in enumerate(([], ["user:", "assistant:"], ["assistant:"], [])))
    blank = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
    lambda a, b: xor(a >> 8, ({crc}::BIGINT[])[xor(a & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (
  SELECT *, rtrim(text, {blank}) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    left(role, 1) AS x, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS y FROM d),
q AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN y ELSE upper(y) END AS symbol,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM n),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (symbol = 'b') AS blank,
    count(*) FILTER (symbol = 'd') AS duplicate, count(*) FILTER (symbol IN ('S', 'U', 'A', 'O')) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM q GROUP BY conv_id),
e(symbol, s, t, c, letters, lines, how) AS (VALUES {', '.join(edges)}),
z(s, c, letters, lines) AS (VALUES {ends}),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS lines FROM t
  UNION ALL
  SELECT w.conv_id, q.i, e.t, w.cost + e.c, w.audit || e.letters,
    w.lines || e.lines || CASE e.how WHEN 0 THEN [] WHEN 1 THEN [q.role || ':' || q.text] WHEN 2 THEN ['user:' || q.text] ELSE ['assistant:' || q.text] END
  FROM w JOIN q ON w.conv_id IS NOT DISTINCT FROM q.conv_id AND q.i = w.i + 1 JOIN e ON e.symbol = q.symbol AND e.s = w.s
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, e.t ORDER BY w.cost + e.c, w.audit || e.letters) = 1),
f AS (
  SELECT w.conv_id, w.cost + z.c AS cost, w.audit || z.letters AS audit, w.lines || z.lines AS lines
  FROM w JOIN t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.n JOIN z ON z.s = w.s
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + z.c, w.audit || z.letters) = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
"""


#: The same by a programme over (cost, edits), row by row.
OP11_SQL = _sql()
