"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``: nothing, or an
optional system turn and then user and assistant in turn. An automaton with the
states start, s, u, a reads them. Nodes (place between rows, state) and edits as
arcs make an acyclic graph (an insertion costs something, so no cheapest path runs
in a circle); costs are in ``DELETE`` and the other constants. Forward minimum
costs from the start and backward ones from the end tell which arcs are tight:
forward + cost + backward is the optimum. A walk over frontier sets takes the least
letter of all tight arcs that leave the frontier at every step, and their heads
are the next frontier. (A letter leads from a state to one state, so frontiers
that start with one node keep one.)

No conversation is gathered in one task. Rows are laid out by conversation and
turn in one global order; each stretch of at most 2^``BLOCK_BITS`` rows of a
conversation is a block, of which a string of one character per row is kept.
Blocks become 4 x 4 matrices of minimum costs. One pass over the blocks of each
conversation in order carries the forward costs, one in reverse order the backward
costs, then every block is walked from each state that lies on a cheapest path,
and a last pass picks the walks that meet. Passes stream: they hold one vector.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm._shared import batches, written

# Costs of edits; an undeleted truncated row costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space of texts, and the characters that end a whole one.
SPACE, ENDS = " \t\n\x0b\x0c\r", [".", "!", "?"]
BLOCK_BITS = 12

START, S, U, A = range(4)
#: Where a role's initial leads from each state, and the states that may end a conversation.
NEXT = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
ENDING = (START, A)
ROLE = {"u": "user", "a": "assistant"}
FAULTS = ["", "blank", "duplicate", "truncated"]
INITIALS = "sua?"
FAR = 1 << 50


def _arcs(code: str, state: int):
    """(letter, cost, head) of the edits of a row (by its code) in a state."""
    fault, initial = divmod(ord(code) - ord("A"), 4)
    yield "D", DELETE, state
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if (to := NEXT.get(INITIALS[initial], {}).get(state)) is not None:
            yield "K", more, to
        for role in "ua":
            if (to := NEXT[role].get(state)) is not None:
                yield "R", REROLE + more, to


#: The same for all codes and states, and insertions by state.
ARCS = {c: [list(_arcs(c, s)) for s in range(4)] for c in map(chr, range(ord("A"), ord("A") + 16))}
INSERTS = [[("I", INSERT, NEXT[r][s]) for r in "ua" if s in NEXT[r]] for s in range(4)]


def _inserted(costs: list[int]) -> list[int]:
    """Forward costs of a place, insertions there included."""
    out = list(costs)
    for _ in range(3):
        for s in range(4):
            for _, c, t in INSERTS[s]:
                out[t] = min(out[t], out[s] + c)
    return out


def _forward(costs: list[int], code: str) -> list[int]:
    """Forward costs behind a row from those before it."""
    out = [FAR] * 4
    for s in range(4):
        for _, c, t in ARCS[code][s]:
            out[t] = min(out[t], costs[s] + c)
    return _inserted(out)


def _backward(costs: list[int], code: str) -> list[int]:
    """Backward costs before a row from those behind it."""
    out = [min(costs[t] + c for _, c, t in ARCS[code][s]) for s in range(4)]
    for _ in range(3):
        for s in range(4):
            out[s] = min([out[s], *(out[t] + c for _, c, t in INSERTS[s])])
    return out


#: Backward costs behind the last row: what it takes to insert to an ending state.
LAST = [0, 2 * INSERT, INSERT, 0]


@lru_cache(maxsize=4_096)
def matrix(codes: str) -> tuple[int, ...]:
    """Minimum costs from each state before a block to each state behind it (16 numbers)."""
    rows = []
    for s in range(4):
        costs = _inserted([0 if t == s else FAR for t in range(4)])
        for code in codes:
            costs = _forward(costs, code)
        rows += [min(c, FAR) for c in costs]
    return tuple(rows)


@lru_cache(maxsize=4_096)
def walks(codes: str, before: tuple[int, ...], behind: tuple[int, ...], last: bool) -> tuple:
    """For each state before a block: (edits, state behind it) of the walk along tight arcs, None where no cheapest path is.

    ``before``: forward costs there; ``behind``: backward costs of its end. The
    edits of the last block go on to the end of the conversation.
    """
    ahead, back = [list(before)], [list(behind)]
    for code in codes:
        ahead.append(_forward(ahead[-1], code))
    for code in reversed(codes):
        back.append(_backward(back[-1], code))
    back.reverse()
    best = min(f + b for f, b in zip(ahead[0], back[0]))
    out = []
    for entry in range(4):
        if ahead[0][entry] + back[0][entry] != best:
            out.append(None)
            continue
        at, frontier, letters = 0, {entry}, []
        while at < len(codes) or last:
            tight: dict[tuple[str, int], set[int]] = {}
            for s in frontier:
                for arcs, to in ((INSERTS[s], at), (ARCS[codes[at]][s] if at < len(codes) else [], at + 1)):
                    for letter, cost, t in arcs:
                        if ahead[at][s] + cost + back[to][t] == best:
                            tight.setdefault((letter, to), set()).add(t)
            if not tight:
                break
            (letter, at), frontier = min(tight.items())
            letters.append(letter)
        out.append(("".join(letters), min(frontier)))
    return tuple(out)


# --- Rows and blocks --------------------------------------------------------------------------------------------------


def fault(text: Column) -> Column:
    """0, 1 (blank) or 3 (truncated) of a text that is no duplicate."""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(ENDS), 0).otherwise(3)


def placed_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos, code: rows in one global order by conversation and turn, with their first fault and role.

    The code is a character for 4 * fault (of FAULTS) + role's initial (of INITIALS).
    """
    # Texts take part in the order and in comparisons by their beginning and digest, so that neither moves or samples long ones.
    order = ["turn", "role", F.left("text", F.lit(32)), F.unhex(F.sha2("text", 256))]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.select("*", order[2].alias("head"), order[3].alias("digest"), F.monotonically_increasing_id().alias("salt"))
    rows = written(rows, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "salt")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when)["salt"].alias("first"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    own = fault(F.col("text"))
    number = F.when((own != 1) & (F.col("salt") != F.col("first")), 2).otherwise(own)
    initial = F.left("role", F.lit(1))
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    coded = met.select("conv_id", "turn", "role", "text", "head", "digest", "salt", F.char(4 * number + at + ord("A")).alias("code"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "head", "digest", "salt"]
    laid = coded.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(laid.select("conv_id", "turn", "role", "text", "code", F.monotonically_increasing_id().alias("pos")), "placed")


def blocks_of(placed: DataFrame) -> DataFrame:
    """One row per block: conv_id, block, first (pos), codes, turns (distinct known ones), low and high (turn)."""
    own = F.array_sort(F.collect_list(F.struct("pos", "code")))
    g = placed.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.min("pos").alias("first"), own.alias("rows"), F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high")
    )
    return g.select("conv_id", "block", "first", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"), "turns", "low", "high")


def _streamed(df: DataFrame, added: list[tuple[str, str, pa.DataType]], start, step, order) -> DataFrame:
    """``df`` with columns that a fold over the rows of each conversation, in ``order``, makes.

    ``step(state, row)`` gives the next state and the added columns' values. Rows
    come sorted, so a task holds one state, whatever the conversation's length.
    """
    names, schema = df.columns, ", ".join(f"{n} {t}" for n, t in df.dtypes) + "".join(f", {n} {t}" for n, t, _ in added)

    def run(frames):
        key, state, seen = None, None, False
        for batch in frames:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                if not seen or row["conv_id"] != key:
                    key, state, seen = row["conv_id"], start, True
                state, values = step(state, row)
                out.append(values)
            if rows:
                more = [pa.array(c, t) for c, (_, _, t) in zip(zip(*out), added)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *(n for n, _, _ in added)])

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


COSTS = ("array<bigint>", pa.list_(pa.int64()))


def _enter(state, row):
    """Forward costs before the block, and what of its first row depends on the block before: illegal pairs, a turn counted twice."""
    costs, initial, turn = state
    codes, m = row["codes"], matrix(row["codes"])
    behind = [min(min(costs[s] + m[4 * s + t] for s in range(4)), FAR) for t in range(4)]
    initials = initial + "".join(INITIALS[(ord(c) - 65) % 4] for c in codes)
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    shared = int(row["low"] is not None and row["low"] == turn)
    return (tuple(behind), initials[-1], row["high"] if row["high"] is not None else turn), (list(costs), illegal, row["turns"] - shared)


def _leave(state, row):
    """Backward costs behind the block, and whether it is the last."""
    costs, last = state
    m = matrix(row["codes"])
    before = [min(min(costs[t] + m[4 * s + t] for t in range(4)), FAR) for s in range(4)]
    best = min(f + b for f, b in zip(row["before"], before))
    return (tuple(before), False), (list(costs), last, best)


def _pick(state, row):
    """The walk from the state that the block before ended in."""
    letters, state_behind = _walks(row)[state]
    return state_behind, (letters, state)


def _walks(row) -> tuple:
    """Walks by costs less their least, which repeat between conversations."""
    f, b = row["before"], row["behind"]
    return walks(row["codes"], tuple(min(x - min(f), FAR) for x in f), tuple(min(x - min(b), FAR) for x in b), row["last"])


def edited_blocks(placed: DataFrame) -> DataFrame:
    """Blocks with their edits: conv_id, block, first, codes, illegal, distinct (turns), low, high, cost (of the conversation), letters, entry."""
    blocks = written(blocks_of(placed), "blocks")
    ahead = _streamed(blocks, [("before", *COSTS), ("illegal", "bigint", pa.int64()), ("distinct", "bigint", pa.int64())], (tuple(_inserted([0, FAR, FAR, FAR])), "", None), _enter, "block")
    both = _streamed(ahead, [("behind", *COSTS), ("last", "boolean", pa.bool_()), ("cost", "bigint", pa.int64())], (tuple(LAST), True), _leave, F.desc("block"))
    picked = _streamed(both, [("letters", "string", pa.string()), ("entry", "int", pa.int32())], START, _pick, "block")
    return written(picked.drop("before", "behind", "turns"), "edited")


def edits_of(blocks: DataFrame) -> DataFrame:
    """pos, letter (K, R or D), role (of R), ahead and after (roles inserted before and, at the end, behind the row)."""
    schema = pa.schema([("pos", pa.int64()), ("letter", pa.string()), ("new_role", pa.string()), ("ahead", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])

    def rows(batch):
        for b in batch.to_pylist():
            state, at, held, out = b["entry"], 0, [], []
            for letter in b["letters"]:
                role = None
                if letter in "IR":
                    initial = next(r for r in "ua" if state in NEXT[r])
                    state, role = NEXT[initial][state], ROLE[initial]
                elif letter == "K":
                    state = NEXT[INITIALS[(ord(b["codes"][at]) - 65) % 4]][state]
                if letter == "I":
                    held.append(role)
                else:
                    out.append((b["first"] + at, letter, role, held, []))
                    at, held = at + 1, []
            if out:
                out[-1][4].extend(held)
            yield from out

    def run(frames):
        for batch in frames:
            yield from batches(schema, rows(batch))

    return blocks.select("first", "codes", "letters", "entry").mapInArrow(run, "pos bigint, letter string, new_role string, ahead array<string>, after array<string>")


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repair of all conversations of rows conv_id, turn, role, text, as two tables.

    * Of conversations: conv_id, gaps (turns missing between the least and the
      largest), blank, duplicate, truncated (rows by their first fault), illegal
      (adjacent roles), cost, audit (the edits' initials, in order).
    * Of repaired rows: conv_id, pos, sub (order), role, text, edit (K, R or I).

    Rows go by turn, null first, ties by role and text (by its first 32
    characters and digest). A null role or text is one blank; rows with a null
    conv_id are one conversation; repeated rows are duplicates of the first; an
    empty role cannot be kept; other columns are ignored; an empty table has no
    conversations. Insertions of a conversation all of whose rows go are not
    possible, as nothing costs less.
    """
    placed = placed_rows(turns)
    blocks = edited_blocks(placed)
    spread = F.max("high") - F.min("low") + 1 - F.sum("distinct")
    count = lambda k: F.sum(F.length("codes") - F.length(F.translate("codes", "".join(chr(65 + 4 * k + i) for i in range(4)), ""))).cast("long").alias(FAULTS[k])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "")
    conversations = blocks.groupBy("conv_id").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), count(1), count(2), count(3), F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), audit.alias("audit"))
    met = placed.join(edits_of(blocks), "pos")
    line = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    inserted = lambda roles: F.transform(roles, lambda r: line(r, F.lit(""), "I"))
    own = F.when(F.col("letter") == "K", F.array(line(F.col("role"), F.col("text"), "K"))).when(F.col("letter") == "R", F.array(line(F.col("new_role"), F.col("text"), "R"))).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    rows = met.select("conv_id", "pos", F.posexplode(F.concat(inserted(F.col("ahead")), own, inserted(F.col("after")))).alias("sub", "line"))
    return conversations, rows.select("conv_id", "pos", "sub", "line.*")


def digests(rows: DataFrame, name: str) -> DataFrame:
    """conv_id and the SHA-256 (hex) of ``role:text`` of its rows, by pos and sub, joined by line feeds.

    A digest is one stream by nature, so each conversation's lines pass one task;
    they come sorted and are not held.
    """
    kind = rows.schema["conv_id"].dataType
    lines = rows.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(frames):
        key, h, ids, found = None, None, [], []
        for batch in frames:
            column = batch.column("conv_id")
            for conv_id, line in zip(column.to_pylist(), batch.column("line")):
                if h is None or conv_id != key:
                    if h is not None:
                        ids.append(key)
                        found.append(h.hexdigest())
                    key, h = conv_id, hashlib.sha256()
                    h.update(line.as_py().encode())
                else:
                    h.update(b"\n" + line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, column.type), pa.array(found, pa.string())], names=["conv_id", name])
            ids, found = [], []
            last = column.type
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], last), pa.array([h.hexdigest()], pa.string())], names=["conv_id", name])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "line").mapInArrow(run, f"conv_id {kind.simpleString()}, {name} string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows that are damaged by the checksum of conversation and turn: dropped, emptied, unended, repeated, or made the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def op12_tight_arc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged conversations, repaired: faults, cost, edits and digest of each."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conversations, rows = repaired(damaged(turns))
    told, found = conversations.withColumnRenamed("conv_id", "c"), digests(rows, "repaired_sha256").withColumnRenamed("conv_id", "d")
    every = turns.select("conv_id").distinct()
    out = every.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _sql() -> str:
    """The query in SQL: the cheapest edits of each state from the last row to the first, letters and repaired lines carried along."""
    step = lambda state, cost, letter, line: f"{{'k': lpad((left({state}.k, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({state}.k, 10), 't': {line} || {state}.t}}"
    own, more = "role || ':' || text || chr(10)", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    kept = lambda s, to, initial: f"CASE WHEN left(role, 1) = '{initial}' AND fault NOT IN ('blank', 'duplicate') THEN {step(f'b{to}', more, 'K', own)} END"
    named = lambda to, name: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {step(f'b{to}', f'3 + {more}', 'R', f"'{name}:' || text || chr(10)")} END"
    ahead = {0: [kept(0, 1, "s"), kept(0, 2, "u"), named(2, "user")], 1: [kept(1, 2, "u"), named(2, "user")], 2: [kept(2, 3, "a"), named(3, "assistant")], 3: [kept(3, 2, "u"), named(2, "user")]}
    rows = ", ".join(f"list_min([{', '.join([step(f'b{s}', 4, 'D', repr('')), *ahead[s]])}]) AS g{s}" for s in range(4))
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
judged AS (
  SELECT *, CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
steps AS (
  SELECT conv_id, n + 1 AS i, {{'k': '000000000', 't': ''}} AS b0, {{'k': '000000006II', 't': {user} || {assistant}}} AS b1, {{'k': '000000003I', 't': {assistant}}} AS b2, {{'k': '000000000', 't': ''}} AS b3 FROM counts
  UNION ALL
  SELECT conv_id, i, list_min([g0, {step('h2', 3, 'I', user)}]), list_min([g1, {step('h2', 3, 'I', user)}]), h2, list_min([g3, {step('g2', 3, 'I', user)}])
  FROM (SELECT *, list_min([g2, {step('g3', 3, 'I', assistant)}]) AS h2
    FROM (SELECT s.conv_id, s.i - 1 AS i, {rows} FROM steps s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1))),
ends AS (SELECT conv_id, b0 FROM steps WHERE i = 1)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(left(b.b0.k, 9)::BIGINT, 0) AS cost, coalesce(substr(b.b0.k, 10), '') AS audit, sha256(regexp_replace(coalesce(b.b0.t, ''), '\n$', '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE = _sql()
