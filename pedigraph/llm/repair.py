"""Conversation structure repair by Wagner-Fischer alignment to a grammar of turns.

A conversation is put right when its role initials follow ``(s?(ua)+)?``.  Every string of
that grammar is an alternating one, with or without a leading s, so a table whose columns
are the characters still to come serves every feasible length at once; two tables, by the
last character, serve all ends.  Cells are filled only in an Ukkonen band around the turns
that may stay, as wide as the incumbent cost (keep every such turn where it stands) allows.
Among the lengths of least cost the backtraced audits are compared and the ASCII-least wins.

A conversation is cut into blocks by turn number.  A block is aligned between every pair of
grammar states (nothing yet, after s, after u, after a) on its own; insertions at its end
are left to the block that follows, so no audit of a block is the beginning of another one
and blocks fold exactly, from the end for the costs and from the start for the audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from pedigraph.llm.common import landed, pick

KEEP, DELETE, INSERT, REROLE, TRUNCATED = 0, 3, 2, 2, 1  # costs of the edits and of a truncated turn that stays
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLOCK = 64
_FAR = 1 << 40
_BLANKS = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: From a state to the end of the conversation: what is still to be inserted.
_CLOSE = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_ROWS = 2048


def expected(state: int) -> int:
    """The state an inserted or re-roled turn leads to."""
    return ASSISTANT if state == USER else USER


def following(state: int, initial: str) -> int:
    """The state a kept turn leads to."""
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]


class Tables:
    """Least costs T[end][i][k] of aligning turns i.. with the last k characters of a target that ends in u or a.

    A row of a table covers only its band; what lies outside costs more than the incumbent.
    """

    def __init__(self, initials: list[str], forced: list[bool], truncated: list[bool]):
        self.initials, self.forced, self.truncated, n = initials, forced, truncated, len(initials)
        stay = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            stay[i] = stay[i + 1] + (not forced[i])
        phases = [0, 0]  # incumbents: every turn that may stay, alternating from u or from a
        for x in range(n):
            if not forced[x]:
                at = stay[0] - stay[x]
                for phase in (0, 1):
                    phases[phase] += TRUNCATED * truncated[x] + REROLE * (initials[x] != "ua"[(at + phase) % 2])
        self.spare = min(max(phases), DELETE * stay[0]) + 2 * INSERT  # above the deletions nobody can save
        self.low = [max(0, s - self.spare // DELETE) for s in stay]
        self.high = [s + self.spare // INSERT for s in stay]
        self.cost = {end: self._filled(end) for end in (USER, ASSISTANT)}

    def want(self, end: int, k: int) -> str:
        """The character that stands k from the end, 1 being the last."""
        return "ua"[(end == ASSISTANT) ^ (k % 2 == 0)]

    def _filled(self, end: int) -> list[list[int]]:
        n, table = len(self.initials), []
        for i in range(n, -1, -1):
            lo, hi = self.low[i], self.high[i]
            row = [_FAR] * (hi - lo + 1)
            if i == n:
                if lo == 0:
                    row[0] = 0
                table.append(row)
                continue
            below, low = table[-1], self.low[i + 1]
            free, own, cut = not self.forced[i], self.initials[i], TRUNCATED * self.truncated[i]
            before = _FAR
            for k in range(lo, hi + 1):
                least = before + INSERT
                at = k - low
                if 0 <= at < len(below) and below[at] + DELETE < least:
                    least = below[at] + DELETE
                if free and 1 <= at <= len(below):
                    here = below[at - 1] + cut + (KEEP if own == self.want(end, k) else REROLE)
                    if here < least:
                        least = here
                row[k - lo] = before = least
            table.append(row)
        return table[::-1]

    def at(self, end: int, i: int, k: int) -> int:
        place = k - self.low[i]
        row = self.cost[end][i]
        return row[place] if 0 <= place < len(row) else _FAR

    def audit(self, end: int, i: int, k: int) -> str:
        """The ASCII-least cheapest edits from a cell: letters lead to different cells, so the first that fits is it."""
        out, n = [], len(self.initials)
        while i < n:
            cost = self.at(end, i, k)
            if self.at(end, i + 1, k) + DELETE == cost:
                out.append("D")
                i += 1
            elif k and self.at(end, i, k - 1) + INSERT == cost:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.initials[i] == self.want(end, k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def aligned(initials: list[str], forced: list[bool], truncated: list[bool]) -> tuple[list[int | None], list[str | None]]:
    """Least cost and its ASCII-least audit between every two states (4 x in + out), None where there is none.

    At least one turn.  No audit ends in an insertion.
    """
    n, tables = len(initials), Tables(initials, forced, truncated)
    best: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE * n, "D" * n) for p in range(4)}
    systems = [i for i in range(n) if initials[i] == "s" and not forced[i]]
    alone = [(DELETE * (n - 1) + TRUNCATED * truncated[i], "D" * i + "K" + "D" * (n - 1 - i)) for i in systems]
    if alone:
        best[START, SYSTEM] = min(alone)
    for end in (USER, ASSISTANT):
        for first in ("u", "a"):
            lengths = [k for k in range(1, tables.high[0] + 1) if tables.want(end, k) == first]
            costs = [tables.at(end, 0, k) for k in lengths]
            least = min(costs, default=_FAR)
            plain = (least, min(tables.audit(end, 0, k) for k, c in zip(lengths, costs) if c == least)) if least < _FAR else None
            for state in (START, SYSTEM, ASSISTANT) if first == "u" else (USER,):
                found = [x for x in (plain, best.get((state, end))) if x]
                if state == START:
                    found += _after_system(tables, systems, end)
                if found:
                    best[state, end] = min(found)
    cells = [best.get((p, q)) for p in range(4) for q in range(4)]
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _after_system(tables: Tables, systems: list[int], end: int) -> list[tuple[int, str]]:
    """Targets with a leading s: the turns before the one that gives it go, the rest is aligned from u."""
    found, least = [], _FAR
    for i in systems:
        for k in range(max(1, tables.low[i + 1]), tables.high[i + 1] + 1):
            if tables.want(end, k) == "u":
                cost = DELETE * i + TRUNCATED * tables.truncated[i] + tables.at(end, i + 1, k)
                if cost <= least and cost < _FAR:
                    least = cost
                    found.append((cost, i, k))
    return [(cost, "D" * i + "K" + tables.audit(end, i + 1, k)) for cost, i, k in found if cost == least]


def folded(costs: list[list[int | None]], audits: list[list[str | None]]) -> tuple[int, list[tuple[int, str]]]:
    """The whole cost, and for every block in order the state it starts from and its audit; the last one closes the conversation."""
    after, rest = [], [_CLOSE[p][0] for p in range(4)]
    for block in reversed(costs):
        after.append(rest)
        rest = [min([_FAR, *(block[4 * p + q] + rest[q] for q in range(4) if block[4 * p + q] is not None)]) for p in range(4)]
    after.reverse()
    state, out = START, []
    for block, texts, later in zip(costs, audits, after):
        _, audit, then = min((block[4 * state + q] + later[q], texts[4 * state + q], q) for q in range(4) if block[4 * state + q] is not None)
        out.append((state, audit))
        state = then
    if out:
        out[-1] = (out[-1][0], out[-1][1] + _CLOSE[state][1])
    return rest[START], out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, dict]]:
    """(key, first of its key, row) of sorted batches; the key is the first columns."""
    last: tuple | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):  # only a part of a batch stands as Python objects
            for row in batch.slice(at, _ROWS).to_pylist():
                key = tuple(list(row.values())[:keys])
                yield key, last is None or key != last, row
                last = key


def _batches(schema: pa.Schema, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _block(key: tuple, part: int, turns: list[dict]) -> dict:
    initials = [t["role"][:1] for t in turns]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    costs, audits = aligned(initials, [t["fault"] in (1, 2) for t in turns], [t["fault"] == 3 for t in turns])
    return {
        "conv": key[0], "block": key[1], "part": part, "costs": costs, "audits": audits,
        **{name: sum(t["fault"] == n for t in turns) for n, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))},
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1],
        "low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers)),
    }


def _align(schema: pa.Schema, size: int) -> Callable:
    """Sorted turns to one row per block of at most ``size`` turns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, last, part = [], None, 0
        for key, fresh, row in _runs(batches, 2):
            if held and (fresh or len(held) == size):
                yield _block(last, part, held)
                held, part = [], 0 if fresh else part + 1
            held.append(row)
            last = key
        if held:
            yield _block(last, part, held)

    return lambda batches: _batches(schema, rows(batches))


def _report(conv: object, blocks: list[dict]) -> Iterator[dict]:
    cost, parts = folded([b["costs"] for b in blocks], [b["audits"] for b in blocks])
    pairs = list(zip(blocks, blocks[1:]))
    numbered = [b for b in blocks if b["turns"]]
    met = sum(b["turns"] for b in numbered) - sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
    whole = {
        "gaps": numbered[-1]["high"] - numbered[0]["low"] + 1 - met if numbered else 0,
        **{name: sum(b[name] for b in blocks) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(b["illegal"] for b in blocks) + sum(a["tail"] + b["head"] not in _LEGAL for a, b in pairs),
        "cost": cost, "audit": "".join(audit for _, audit in parts),
    }
    at = 0
    while at < len(blocks):
        upto = at
        while upto < len(blocks) and blocks[upto]["block"] == blocks[at]["block"]:
            upto += 1
        yield {"conv": conv, "block": blocks[at]["block"], "state": parts[at][0], "edits": "".join(a for _, a in parts[at:upto]),
               "whole": whole if at == 0 else None}
        at = upto


def _fold(schema: pa.Schema) -> Callable:
    """Sorted blocks to one row per turn block with its edits; the first block of a conversation carries the figures of all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, last = [], None
        for key, fresh, row in _runs(batches, 1):
            if held and fresh:
                yield from _report(last[0], held)
                held = []
            held.append(row)
            last = key
        if held:
            yield from _report(last[0], held)

    return lambda batches: _batches(schema, rows(batches))


def _apply(schema: pa.Schema) -> Callable:
    """Rows of edits, each before its block's turns, to the repaired turns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        edits, at, state, place, key = "", 0, START, 0, (None, None)

        def made(edit: str, role: str, text: str) -> dict:
            return {"conv": key[0], "block": key[1], "place": place, "edit": edit, "role": role, "text": text}

        for key, _, row in _runs(batches, 2):
            if row["edits"] is not None:
                edits, at, state, place = row["edits"], 0, row["state"], 0
            else:
                edit = edits[at]
                at += 1
                if edit != "D":
                    state = following(state, row["role"][:1]) if edit == "K" else expected(state)
                    yield made(edit, row["role"] if edit == "K" else NAMES[state], row["text"])
                    place += 1
            while at < len(edits) and edits[at] == "I":
                state = expected(state)
                yield made("I", NAMES[state], "")
                place, at = place + 1, at + 1

    return lambda batches: _batches(schema, rows(batches))


def _digest(schema: pa.Schema) -> Callable:
    """Sorted repaired turns to the digest of each conversation, one running hash at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, running = None, None
        for key, fresh, row in _runs(batches, 1):
            if fresh:
                if last:
                    yield {"conv": last[0], "digest": running.hexdigest()}
                last, running = key, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
        if last:
            yield {"conv": last[0], "digest": running.hexdigest()}

    return lambda batches: _batches(schema, rows(batches))


def _sorted_map(df: DataFrame, keys: list[str], order: list[str], body: Callable[[pa.Schema], Callable], schema: StructType) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(body(to_arrow_schema(schema)), schema)


def judged(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, turn, role, text, copies) rows as single turns with their first fault and their block.

    fault: 1 blank, 2 role and text seen earlier in the conversation, 3 last character other
    than ``.``, ``!`` or ``?``, else 0.  Order: turn (nulls first), then ``by`` columns given in
    ``rows`` (role and text before damage), then the copy.
    """
    once = rows.groupBy("conv", "turn", "by_role", "by_text", "role", "text").agg(F.sum("copies").alias("copies"))
    single = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    mark = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "role").alias("k2")]
    single = landed(single.select("*", *mark), "turns")
    place = F.struct("turn", "by_role", "by_text", "copy")
    again = single.groupBy(F.col("conv").alias("c"), F.col("k1").alias("a"), F.col("k2").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    joined = single.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (F.when(F.length(trimmed) == 0, 1).when(F.col("first").isNotNull() & (place > F.col("first")), 2)
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    return landed(joined.select("conv", F.floor(F.col("turn") / block).cast("long").alias("block"), "turn", "by_role", "by_text", "copy", "role", "text",
                                fault.alias("fault")), "judged")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, turns): the audit of every conversation and its repaired turns.

    report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.  turns: conv, block,
    place (in this order), edit, role, text.  Null roles and texts are read as one blank; rows
    whose conversation is null are one conversation.  Rows of one turn stand by role and text,
    repeated rows next to each other.  Extra columns
    are left out; an empty table gives empty results.  A block is what one task step holds; the
    audits of one conversation are folded by one task, as they form one cell of the report.
    """
    filled = pick(rows, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text").select(
        "conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return repaired(filled.select("*", F.col("role").alias("by_role"), F.col("text").alias("by_text"), F.lit(1).cast("long").alias("copies")), block)


def repaired(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same from (conv, turn, role, text, by_role, by_text, copies) rows without null roles and texts."""
    turns = judged(rows, block)
    kind: DataType = turns.schema["conv"].dataType
    long = lambda *names: ", ".join(f"{n} bigint" for n in names)
    made = lambda ddl: StructType([StructField("conv", kind), *StructType.fromDDL(ddl).fields])
    order = ["turn", "by_role", "by_text", "copy"]
    blocks = _sorted_map(turns.select("conv", "block", *order, "role", "fault"), ["conv", "block"], order, lambda s: _align(s, block), made(
        f"block bigint, part int, costs array<int>, audits array<string>, {long('blank', 'duplicate', 'truncated', 'illegal')}, head string, tail string, {long('low', 'high', 'turns')}"))
    whole = ", ".join(f"{n}: bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    folds = landed(_sorted_map(blocks, ["conv"], ["block", "part"], _fold, made(f"block bigint, state int, edits string, whole struct<{whole}, audit: string>")), "folds")
    none = lambda name: F.lit(None).cast(turns.schema[name].dataType).alias(name)
    both = folds.select("conv", "block", F.lit(0).alias("kind"), *map(none, order), none("role"), none("text"), "state", "edits").unionByName(
        turns.select("conv", "block", F.lit(1).alias("kind"), *order, "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits")))
    fixed = _sorted_map(both, ["conv", "block"], ["kind", *order], _apply, made("block bigint, place bigint, edit string, role string, text string"))
    return folds.where("whole is not null").select("conv", "whole.*"), fixed


def digests(turns: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 of role:text joined by new lines; one running hash per conversation, in bounded memory."""
    return _sorted_map(turns.select("conv", "block", "place", "role", "text"), ["conv"], ["block", "place"], _digest,
                       StructType([turns.schema["conv"], *StructType.fromDDL("digest string").fields]))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after the stated damage, as ``repaired`` takes them.

    A pure function of conv_id and turn: 0 of crc32(conv_id:turn) mod 20 drops the row, 1 empties
    its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's.
    """
    filled = pick(rows, "conv_id", "turn", "role", "text").toDF("conv", "turn", "by_role", "by_text").select(
        "conv", "turn", F.coalesce("by_role", F.lit(" ")).alias("by_role"), F.coalesce("by_text", F.lit(" ")).alias("by_text"))
    spelled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spelled("conv"), F.lit(":"), spelled("turn")), "UTF-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("by_text", ".!?", "")).otherwise(F.col("by_text"))
    return filled.withColumn("kind", kind).where("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("by_role")).alias("role"), text.alias("text"), "by_role", "by_text",
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations as stated and repair them: one row per original conv_id."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, turns = repaired(damaged(rows))
    hashed = digests(turns)
    every = pick(rows, "conv_id").distinct()
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.join(report, F.col("conv_id").eqNullSafe(report.conv), "left").drop("conv").join(hashed, F.col("conv_id").eqNullSafe(hashed.conv), "left")
    return found.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in figures], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a fold over states instead of tables: text lists of cost (nine digits) and audit per state."""
    none = "999999999"
    add = lambda v, cost, edit: f"lpad((left({v}, 9)::bigint + {cost})::varchar, 9, '0') || substr({v}, 10) || '{edit}'"
    more = lambda v, cost, edit: f"case when left({v}, 9) >= '{none}' then '{none}' else {add(v, cost, edit)} end"
    filled = f"""[acc[1], acc[2],
      least(acc[3], {more('acc[1]', 2, 'I')}, {more('acc[2]', 2, 'I')}, {more('acc[4]', 2, 'I')}),
      least(acc[4], {more('acc[3]', 2, 'I')}, {more('acc[1]', 4, 'II')}, {more('acc[2]', 4, 'II')})]"""
    keep = lambda v, c: f"case when x.f in (1, 2) then '{none}' when x.i = '{c}' then {more(v, 'x.t', 'K')} else {more(v, '2 + x.t', 'R')} end"
    only = f"case when x.f in (1, 2) or x.i <> 's' then '{none}' else {more('acc[1]', 'x.t', 'K')} end"
    row = f"""[{more('acc[1]', 3, 'D')}, least({more('acc[2]', 3, 'D')}, {only}),
      least({more('acc[3]', 3, 'D')}, {keep('acc[1]', 'u')}, {keep('acc[2]', 'u')}, {keep('acc[4]', 'u')}),
      least({more('acc[4]', 3, 'D')}, {keep('acc[3]', 'a')})]"""
    crc = "list_reduce(range(8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), xor(a, y))"
    return f"""
with keyed as (select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
rolled as (select *, xor(list_reduce(list_transform(string_split(k, ''), lambda z: ascii(z)::bigint), lambda a, y: {crc}, 4294967295::bigint), 4294967295) % 20 as kind from keyed),
bad as (select conv_id, turn, role0, text0, case kind when 4 then 'user' else role0 end as role,
  case kind when 1 then '' when 2 then translate(text0, '.!?', '') else text0 end as text, unnest(case kind when 3 then [1, 2] else [1] end) as copy
  from rolled where kind <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role0, text0, copy) as n from bad),
marked as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
  row_number() over (partition by conv_id, role, text order by n) as seen, lag(left(role, 1)) over (partition by conv_id order by n) as prior from numbered),
faulty as (select *, case when body = '' then 1 when seen > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as f from marked),
convs as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where f = 1) as blank,
  count(*) filter (where f = 2) as duplicate, count(*) filter (where f = 3) as truncated,
  count(*) filter (where n > 1 and prior || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
  list({{i: left(role, 1), f: f, t: case when f = 3 then 1 else 0 end, role: role, text: text}} order by n) as turns from faulty group by conv_id),
steps as (select *, list_append(flatten(list_transform(turns, lambda z: [{{i: '+', f: 0, t: 0}}, {{i: z.i, f: z.f, t: z.t}}])), {{i: '+', f: 0, t: 0}}) as todo from convs),
done as (select *, list_reduce(todo, lambda acc, x: case when acc[5] = '' then list_append({filled}, 'row') else list_append({row}, '') end,
  ['000000000', '{none}', '{none}', '{none}', '']) as ends from steps),
picked as (select *, least(ends[1], ends[4]) as won from done),
audited as (select *, left(won, 9)::bigint as cost, substr(won, 10) as audit from picked),
spelled as (select *, list_reduce(list_filter(string_split(audit, ''), lambda z: z <> ''), lambda acc, e: {{
  r: acc.r + case e when 'I' then 0 else 1 end,
  s: case e when 'D' then acc.s when 'K' then turns[acc.r].i else case acc.s when 'u' then 'a' else 'u' end end,
  o: case e when 'D' then acc.o else list_append(acc.o, case e when 'K' then turns[acc.r].role || ':' || turns[acc.r].text
    else case acc.s when 'u' then 'assistant:' else 'user:' end || case e when 'R' then turns[acc.r].text else '' end end) end}},
  {{r: 1::bigint, s: '', o: []::varchar[]}}).o as lines from audited)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join spelled s on e.conv_id is not distinct from s.conv_id"""


ORACLE = _sql().replace("select conv_id, coalesce(gaps", "select e.conv_id, coalesce(gaps")
