"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Turns are symbols of an automaton with four states. For each cost, from 0 on, a bitset per turn tells from which states the rest of
the conversation can be repaired at no more than that cost, each cost following from those one, two, five, ... below it; the first whose bitset
holds the start state is the cost, and walking the bitsets from there, always by the least letter, gives the least audit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.llm.common import ASCII_SPACE, discard, map_arrow, settled, table
from dialogmill.tables import same

#: Costs of the edits: (delete, re-role, insert, a truncated turn that stays).
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Turns whose bitsets are held at once; longer conversations are walked block by block.
BLOCK = 64
#: Symbols of a turn by its role's initial (s, u, a, other): sound, truncated, blank, duplicate.
SOUND, CUT, BLANK, TWIN = "suax", "SUAX", "0123", "4567"
#: Where s, u and a lead from the states start, after s, after u, after a; -1 is nowhere. Start and after a accept.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "x": (-1, -1, -1, -1)}
ACCEPTING = (0, 3)
FAR = 1 << 60


def _sources(*initials: str) -> list[int]:
    """For every set of states those from which one of the initials leads into it."""
    return [sum(1 << q for q in range(4) if any(NEXT[i][q] >= 0 and reached >> NEXT[i][q] & 1 for i in initials)) for reached in range(16)]


_EITHER = _sources("u", "a")
#: Per symbol: (sets of states before a turn that is kept, its own cost when it stays, where it leads), or None for turns that must go.
_RULES = {s: (_sources(SOUND[k]), 0, NEXT[SOUND[k]]) for k, s in enumerate(SOUND)}
_RULES |= {s: (_sources(SOUND[k]), TRUNCATED, NEXT[SOUND[k]]) for k, s in enumerate(CUT)} | dict.fromkeys(BLANK + TWIN)


def cost_layers(symbols: str, after: Sequence[int], entry: Sequence[int]) -> list[list[int]]:
    """Per cost a bitset for each turn and for the end: the states from which the rest can be repaired at no more than it.

    ``after`` has the cost of each state behind the block. Layers are added until all states of ``entry`` are in the first bitset.
    """
    n, wanted = len(symbols), sum(1 << q for q in entry)
    rules = [_RULES[s] for s in symbols]
    layers: list[list[int]] = []
    nothing = [0] * (n + 1)

    def below(k: int) -> list[int]:
        return layers[-k] if len(layers) >= k else nothing

    while not layers or layers[-1][0] & wanted != wanted:
        one, deleted, inserted, late = below(REROLE), below(DELETE), below(INSERT), below(REROLE + TRUNCATED)
        here = [0] * (n + 1)
        here[n] = sum(1 << q for q in range(4) if after[q] <= len(layers)) | _EITHER[inserted[n]]
        for k in range(n - 1, -1, -1):
            reached = deleted[k + 1] | _EITHER[inserted[k]]
            if rules[k] is not None:
                before, extra, _ = rules[k]
                reached |= (before[below(TRUNCATED)[k + 1]] | _EITHER[late[k + 1]]) if extra else (before[here[k + 1]] | _EITHER[one[k + 1]])
            here[k] = reached
        layers.append(here)
    return layers


def _walk(symbols: str, layers: list[list[int]], state: int, last: bool) -> tuple[str, list[str], int]:
    """(audit, output of each turn and of the end, last state) of the cheapest edits from a state, by the least letter at every step.

    Outputs hold U or A for an inserted turn, k for a kept one, u or a for one with a new role, nothing for a deleted one.
    What can be inserted between two blocks is left to the second, which knows whether a lesser letter will do.
    """
    cost = next(c for c, layer in enumerate(layers) if layer[0] >> state & 1)
    audit, outputs, at, n = [], [""] * (len(symbols) + 1), 0, len(symbols)

    def leads(left: int, place: int, to: int) -> bool:
        return left >= 0 and to >= 0 and bool(layers[left][place] >> to & 1)

    while at < n or last:
        rule = _RULES[symbols[at]] if at < n else None
        extra = rule[1] if rule else 0
        if at < n and leads(cost - DELETE, at + 1, state):
            letter, spent, made, to, further = "D", DELETE, "", state, 1
        elif role := next((r for r in "ua" if leads(cost - INSERT, at, NEXT[r][state])), None):
            letter, spent, made, to, further = "I", INSERT, role.upper(), NEXT[role][state], 0
        elif rule and leads(cost - extra, at + 1, rule[2][state]):
            letter, spent, made, to, further = "K", extra, "k", rule[2][state], 1
        elif rule:
            role = next(r for r in "ua" if leads(cost - REROLE - extra, at + 1, NEXT[r][state]))
            letter, spent, made, to, further = "R", REROLE + extra, role, NEXT[role][state], 1
        else:
            break
        outputs[at] += made
        audit.append(letter)
        cost, state, at = cost - spent, to, at + further
    return "".join(audit), outputs, state


def repair(symbols: str) -> tuple[int, str, list[str]]:
    """(cost, audit, output of each turn) of a conversation; what is inserted at the end stands with its last turn.

    Time grows with the turns, and the bitsets of one block are held at a time: the blocks are first gone through from the end, to
    know what each state costs behind each block, then walked from the start. No turns cost nothing.
    """
    blocks = [symbols[k : k + BLOCK] for k in range(0, len(symbols), BLOCK)]
    after = [[0 if q in ACCEPTING else FAR for q in range(4)]]  # behind each block, from the last on, less the least of the four
    cost, state, audit, outputs = 0, 0, [], [""]
    for block in blocks[:0:-1]:
        layers = cost_layers(block, after[-1], range(4))
        costs = [next(c for c, layer in enumerate(layers) if layer[0] >> q & 1) for q in range(4)]
        cost += min(costs)
        after.append([c - min(costs) for c in costs])
    for number, block in enumerate(blocks):
        layers = cost_layers(block, after.pop(), [state])
        cost += len(layers) - 1 if number == 0 else 0
        letters, made, state = _walk(block, layers, state, number == len(blocks) - 1)
        audit.append(letters)
        outputs[-1] += made[0]
        outputs += made[1:]
    if len(outputs) > 1:
        outputs[-2:] = [outputs[-2] + outputs[-1]]
    return cost, "".join(audit), outputs if symbols else []


def illegal_pairs(symbols: str) -> int:
    """Neighbours whose roles' initials aren't su, ua or au."""
    roles = symbols.translate(str.maketrans(CUT + BLANK + TWIN, SOUND * 3))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _digest(role: Column, text: Column) -> list[Column]:
    return [role.alias("role"), F.md5(text).alias("digest")]


def ordered_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, pos) as a written table: pos counts a conversation's turns from 0 by turn, nulls first, then role and text.

    Turns are dealt by ranges of that order and numbered range by range, so a conversation with a third of all turns, or a third of all turns
    in one place with one text, is dealt over many tasks. Null roles and texts are one space.
    """
    one = F.lit(" ")
    rows = turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), one).alias("role"),
        F.coalesce(F.col(text_col), one).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = settled(rows.repartitionByRange(F.col("conv").asc_nulls_first(), *order, "salt").drop("salt").withColumn("part", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range that a conversation lies in
    before = sizes.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    numbered = same(dealt.withColumn("within", within), before, ["conv", "part"])
    placed = settled(numbered.select("conv", "turn", "role", "text", (F.col("before") + F.col("within")).alias("pos")), "placed")
    discard(dealt)
    return placed


def symbol_blocks(placed: DataFrame, block: int = 4096) -> DataFrame:
    """(conv, symbols): a character per turn that tells its role's initial and its first fault; gathered block by block, then joined.

    Blank is a turn without any character but ASCII white space, duplicate one whose role and text stood earlier, truncated one whose
    last other character isn't ``.``, ``!`` or ``?``.
    """
    text = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    role = F.position(F.substring("role", 1, 1), F.lit(SOUND[:3]))
    marks = placed.select(
        "conv", "pos", *_digest(F.col("role"), F.col("text")),
        F.when((F.char_length("role") > 0) & (role > 0), role).otherwise(4).alias("initial"),
        F.when(text == "", F.lit(BLANK)).when(~F.right(text, F.lit(1)).isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(SOUND)).alias("kinds"),
    )
    first = marks.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = same(marks, first, ["conv", "role", "digest"], "left")
    kinds = F.when((F.col("kinds") != BLANK) & (F.col("first") < F.col("pos")), F.lit(TWIN)).otherwise(F.col("kinds"))
    symbols = found.select("conv", "pos", F.floor(F.col("pos") / block).alias("block"), F.substring(kinds, F.col("initial"), F.lit(1)).alias("symbol"))

    def gathered(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, value)))
        return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[value]), "").alias(value))

    blocks = gathered(symbols, ["conv", "block"], "pos", "symbol")
    context = placed.sparkSession.sparkContext
    parts = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism)
    # as many tasks whatever the bytes: a conversation's symbols are few, but each takes work
    return gathered(blocks.repartition(parts, "conv"), ["conv"], "block", "symbol").withColumnRenamed("symbol", "symbols")


def repair_plans(symbols: DataFrame, block: int = 4096) -> DataFrame:
    """(conv, block, outputs, facts) of (conv, symbols): what each turn becomes, block by block, and with block 0 the facts of the conversation."""
    facts = "struct<blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"
    kind = symbols.schema["conv"].dataType.simpleString()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, marks in zip(batch.column("conv"), batch.column("symbols").to_pylist(), strict=True):
                cost, audit, outputs = repair(marks)
                counts = [sum(map(marks.count, kinds)) for kinds in (BLANK, TWIN, CUT)]
                told = dict(zip(("blank", "duplicate", "truncated"), counts, strict=True)) | {"illegal": illegal_pairs(marks), "cost": cost, "audit": audit}
                pieces = [outputs[k : k + block] for k in range(0, len(outputs), block)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv.as_py()] * len(pieces), batch.schema.field("conv").type), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.list_(pa.string())),
                    pa.array([told] + [None] * (len(pieces) - 1), pa.struct([(k, pa.int64()) for k in told if k != "audit"] + [("audit", pa.string())])),
                ], ["conv", "block", "outputs", "facts"])

    return map_arrow(symbols, plan, f"conv {kind}, block long, outputs array<string>, facts {facts}")


def repaired_turns(placed: DataFrame, plans: DataFrame, block: int = 4096) -> DataFrame:
    """(conv, pos, k, role, text, edit): the turns of the repaired conversations in order of (pos, k), with the edit's initial."""
    planned = placed.withColumn("block", F.floor(F.col("pos") / block))
    planned = same(planned, plans.select("conv", "block", "outputs"), ["conv", "block"])
    made = F.get("outputs", (F.col("pos") - F.col("block") * block).cast("int"))
    parts = planned.select("conv", "pos", "role", "text", F.posexplode(F.split(made, "")).alias("k", "as")).where("as <> ''")
    role = F.when(F.col("as") == "k", F.col("role")).when(F.lower("as") == "u", "user").otherwise("assistant")
    text = F.when(F.col("as").isin("U", "A"), "").otherwise(F.col("text"))
    edit = F.when(F.col("as") == "k", "K").when(F.col("as").isin("U", "A"), "I").otherwise("R")
    return parts.select("conv", "pos", "k", role.alias("role"), text.alias("text"), edit.alias("edit"))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation's turns, joined by newlines.

    A digest takes its lines one after the other: a conversation's turns stream through one task, sorted by Spark, and none of them is held.
    """
    lines = turns.select("conv", "pos", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = turns.schema["conv"].dataType.simpleString()
    dealt = lines.repartition("conv").sortWithinPartitions("conv", "pos", "k")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def told(rows: list, schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field("conv").type), pa.array([r[1] for r in rows], pa.string())], ["conv", "sha256"])

        for batch in batches:
            ended, schema = [], batch.schema
            for own, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        ended.append((conv, state.hexdigest()))
                    conv, state = own, sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            yield told(ended, schema)
        if state is not None:
            yield told([(conv, state.hexdigest())], schema)

    return map_arrow(dealt, digest, f"conv {kind}, sha256 string")


@dataclass(frozen=True)
class Repaired:
    """``conversations``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); ``turns``: (conv, pos, k, role, text, edit)."""

    conversations: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Faults, cheapest edits and repaired turns of every conversation.

    Turns count by turn, null turns first, those of one turn by role and text; null roles and texts are one space, so such a turn is blank or has no
    role that may stay, as has one with an empty role. A null id is a conversation like others. A turn that is repeated as it is
    is a duplicate. ``gaps`` counts the turn numbers that are missing between the least and the greatest. Other
    columns aren't read; an empty table gives empty tables.
    """
    placed = ordered_turns(turns, id_col, turn_col, role_col, text_col)
    plans = settled(repair_plans(symbol_blocks(placed)), "plans")
    missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    conversations = same(plans.where("block = 0").select("conv", "facts.*"), placed.groupBy("conv").agg(missing), ["conv"])
    return Repaired(conversations.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired_turns(placed, plans))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that crc32 of ``conv_id:turn`` modulo 20 deals, nulls being one space.

    0 drops a turn, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    one = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn"))
    h = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    hit = conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("times"),
    )
    return hit.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("conv")).distinct()
    full = same(same(every, found.conversations, ["conv"], "left"), turn_digests(found.turns), ["conv"], "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return full.select(
        F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_KEPT_SQL = """CASE left(role, 1) WHEN 's' THEN CASE x.q WHEN 0 THEN 1 END
                  WHEN 'u' THEN CASE WHEN x.q IN (0, 1, 3) THEN 2 END WHEN 'a' THEN CASE x.q WHEN 2 THEN 3 END END"""
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc_table),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR),
        ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, b: xor(c >> 8, list_extract(crc_table,
        CAST(xor(c, b) & 255 AS INT) + 1)), 4294967295::BIGINT), 4294967295) % 20 AS h FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM h, range(2) c(copy) WHERE h > 0 AND (copy = 0 OR h = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
        trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!',
        '?') THEN 'truncated' ELSE '' END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
x AS (SELECT * FROM (VALUES (0, 0, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', 'user:'), (1, 3,
        'II', 'user:' || chr(10) || 'assistant:'),
        (2, 2, '', ''), (2, 3, 'I', 'assistant:'), (2, 2, 'II', 'assistant:' || chr(10) || 'user:'), (3, 3, '', ''), (3, 2, 'I', 'user:'), (3, 3, 'II',
        'user:' || chr(10) || 'assistant:')) x(s, q, ins, lines)),
y AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit, best.lines FROM (
    SELECT conv_id, pos, state, arg_min({{'cost': cost, 'audit': audit, 'lines': lines}}, (cost, audit)) AS best FROM (
      SELECT conv_id, pos, e.state AS state, cost + e.cost AS cost, audit || e.letter AS audit,
             CASE WHEN e.line IS NULL THEN lines ELSE lines || [e.line] END AS lines FROM (
        SELECT y.conv_id, f.pos, y.cost + 5 * length(x.ins) AS cost, y.audit || x.ins AS audit, CASE WHEN x.lines = '' THEN y.lines ELSE y.lines || [x.lines] END AS lines,
               list_filter([{{'letter': 'D', 'state': x.q, 'cost': 2, 'line': NULL}},
                 {{'letter': 'K', 'state': {_KEPT_SQL}, 'cost': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'line': role || ':' || text}},
                 {{'letter': 'R', 'state': CASE WHEN x.q IN (0, 1, 3) THEN 2 END, 'cost': CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'line': 'user:' || text}},
                 {{'letter': 'R', 'state': CASE x.q WHEN 2 THEN 3 END, 'cost': CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'line': 'assistant:' || text}}],
                 lambda e: e.state IS NOT NULL AND (e.letter = 'D' OR fault NOT IN ('blank', 'duplicate'))) AS es
        FROM y JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.pos = y.pos + 1 JOIN x ON x.s = y.state), unnest(es) u(e))
    GROUP BY conv_id, pos, state)),
z AS (SELECT y.conv_id, arg_min({{'cost': y.cost + 5 * length(x.ins), 'audit': y.audit || x.ins, 'lines': CASE WHEN x.lines = '' THEN y.lines ELSE y.lines || [x.lines] END}},
        (y.cost + 5 * length(x.ins), y.audit || x.ins)) AS best
      FROM y JOIN x ON x.s = y.state JOIN (SELECT conv_id,
        max(pos) AS pos FROM y GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM y.conv_id AND m.pos = y.pos WHERE x.q IN (0, 3) GROUP BY y.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""
