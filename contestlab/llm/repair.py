"""Repair of conversations: the cheapest edits that make turns alternate, by A* on the edit lattice.

A conversation is its rows by turn. A row is blank, a duplicate of an earlier row, truncated, or sound. Edits: Keep a row (0),
Rerole it to user or assistant (2), Delete it (3; blank and duplicate rows must go), Insert an empty turn of user or
assistant (2); a truncated row that stays costs 1 more. What is left must read, by the roles' first letters, (s?(ua)+)?.

A node of the lattice is (rows done, what may come next); from each, an edit leads to one node only, so the edits' initials
name a path. The heuristic is a suffix sum over the rows to come: 3 for each that must go, 1 for each truncated one, as it costs
that at least whether it stays or goes. It never exceeds what is still to pay and falls by no more than an edit costs, so nodes are
settled once, in the order of (cost plus heuristic, audit), and the first end reached is the cheapest with the least audit.

Open nodes wait in levels of equal cost plus heuristic. A child of the same level follows its parent's audit directly, so a
level is a stack over its sorted openings. Audits are paths in a trie with skip links: comparing two takes
logarithmic time and no audit is spelt out before the end. Time and memory are linear in rows, but for that logarithm.

Jobs: equal rows are counted, dealt by ranges of (conversation, turn, role, text) and so get places in order; first occurrences
are minima, pre-aggregated. What A* needs of a row is one number, and what it returns is one string for a conversation,
as long as its rows: no text gathers with it. Kept texts meet their edits in a join by place; they are joined to
lines in blocks of bounded number, and a conversation's blocks are hashed one after another as a stream, as SHA-256 must be.

Defined cases: a null role or text is one space, in the key that draws the damage a null conv_id or turn too; rows with a null conv_id are one conversation;
rows of one turn are ordered by role and text. Repeated rows are rows of their own. A role that begins with another letter than s, u, a has to go or be reroled. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, materialize, table

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: What a row is: its role's initial times KINDS plus its fault.
INITIALS, OTHER = "sua", 3
SOUND, BLANK, DUPLICATE, CUT, KINDS = 0, 1, 2, 3, 4
#: What may come next: anything at all, a user after the system's turn, a user after an assistant's, an assistant.
START, SYSTEM, USER, ASSISTANT, STATES = 0, 1, 2, 3, 4
#: Repaired lines that are joined before they are hashed.
LINES = 256


class Audits:
    """A trie of edit initials. A node is a number; 0 is the empty audit."""

    def __init__(self):
        self.up, self.skip, self.depth, self.edit = [0], [0], [0], [""]

    def add(self, parent: int, edit: str) -> int:
        skip, depth = self.skip, self.depth
        a = skip[parent]
        # skip links of lengths 1, 3, 7, ...: each node's is twice its parent's if the parent's and the next are alike
        long = parent and depth[parent] - depth[a] == depth[a] - depth[skip[a]] and a != parent
        self.up.append(parent)
        skip.append(skip[a] if long else parent)
        depth.append(depth[parent] + 1)
        self.edit.append(edit)
        return len(depth) - 1

    def ancestor(self, x: int, depth: int) -> int:
        while self.depth[x] > depth:
            x = self.skip[x] if self.depth[self.skip[x]] >= depth else self.up[x]
        return x

    def compare(self, x: int, y: int) -> int:
        """Below 0 if x is the lesser audit; no two nodes are the same audit."""
        dx, dy = self.depth[x], self.depth[y]
        a, b = self.ancestor(x, min(dx, dy)), self.ancestor(y, min(dx, dy))
        if a == b:  # one begins with the other
            return dx - dy
        while self.up[a] != self.up[b]:
            if self.skip[a] != self.skip[b]:
                a, b = self.skip[a], self.skip[b]
            else:
                a, b = self.up[a], self.up[b]
        return -1 if self.edit[a] < self.edit[b] else 1

    def spell(self, x: int) -> str:
        out = []
        while x:
            out.append(self.edit[x])
            x = self.up[x]
        return "".join(reversed(out))


def remaining(codes: Sequence[int]) -> list[int]:
    """What the rows from each on cost at least."""
    fault = np.array(codes, np.int64) % KINDS
    must = np.where((fault == BLANK) | (fault == DUPLICATE), DELETE, np.where(fault == CUT, TRUNCATED, 0))
    return [*np.cumsum(must[::-1])[::-1].tolist(), 0]


def edits_of(code: int | None, state: int) -> Iterator[tuple[str, int, int]]:
    """Initial, cost and next state of what can be done at a node, in the order of initials; code: of the next row, None after the last."""
    initial, fault = (OTHER, BLANK) if code is None else divmod(code, KINDS)
    turn = ASSISTANT if state != ASSISTANT else USER
    if code is not None:
        yield "D", DELETE, state
    yield "I", INSERT, turn
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if initial == INITIALS.index("a" if state == ASSISTANT else "u"):
            yield "K", KEEP + more, turn  # reroling to the role that it has is dearer and leads to the same node
        else:
            if state == START and initial == INITIALS.index("s"):
                yield "K", KEEP + more, SYSTEM
            yield "R", REROLE + more, turn


def cheapest(codes: Sequence[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, of equal cost the least audit."""
    rest, audits, n = remaining(codes), Audits(), len(codes)
    settled = bytearray((n + 1) * STATES)
    levels: dict[int, list[tuple[int, int, int]]] = {rest[0]: [(0, START, 0)]}
    by_audit = cmp_to_key(lambda x, y: audits.compare(x[2], y[2]))
    while True:
        level = min(levels)
        stack = sorted((x for x in levels.pop(level) if not settled[x[0] * STATES + x[1]]), key=by_audit, reverse=True)
        while stack:
            at, state, audit = stack.pop()
            if settled[at * STATES + state]:
                continue
            settled[at * STATES + state] = 1
            if at == n and state in (START, USER):
                return level, audits.spell(audit)
            children = []
            for edit, cost, then in edits_of(codes[at] if at < n else None, state):
                to = at + (edit != "I")
                if not settled[to * STATES + then]:
                    f = level - rest[at] + cost + rest[to]
                    child = (to, then, audits.add(audit, edit))
                    (children if f == level else levels.setdefault(f, [])).append(child)
            stack.extend(reversed(children))


def repaired_roles(codes: Sequence[int], audit: str) -> Iterator[tuple[int | None, str | None]]:
    """For each repaired turn the number of its row, None for an inserted one, and its new role, None for its own."""
    at, state = 0, START
    for edit in audit:
        turn = ASSISTANT if state != ASSISTANT else USER
        role = "assistant" if state == ASSISTANT else "user"
        if edit == "K":
            yield at, None
            state = SYSTEM if state == START and codes[at] // KINDS == INITIALS.index("s") else turn
        elif edit != "D":
            yield (at if edit == "R" else None), role
            state = turn
        at += edit != "I"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.filter(draw != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(draw == 3, 2).otherwise(1).alias("copies")
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, pos, code: distinct rows, how often each occurs, in order of pos; code: initial and fault of the first copy."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    keys = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    dealt = materialize(dealt, "turns")
    said = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))  # 128 bits stand for a text
    said = dealt.select("conv_id", "role", *(x.alias(f"t{i}") for i, x in enumerate(said)), "pos").groupBy("conv_id", "role", "t0", "t1").agg(F.min("pos").alias("pos"))
    firsts = said.select("pos", F.lit(True).alias("first"))
    bare = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), OTHER).otherwise(initial)
    fault = F.when(bare == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~bare.isin(".", "!", "?"), CUT).otherwise(SOUND)
    return dealt.join(firsts, "pos", "left").select(*keys, "n", "pos", (initial * KINDS + fault).cast("int").alias("code"))


SOLVED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines array<struct<pos:long,role:string>>"
LEGAL = np.zeros((4, 4), bool)
for _pair in ("su", "ua", "au"):
    LEGAL[INITIALS.index(_pair[0]), INITIALS.index(_pair[1])] = True


def _solve(batches):
    for batch in batches:
        out = []
        for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = np.array([r["code"] for r in rows], np.int64)
            n = np.array([r["n"] for r in rows], np.int64)
            # copies of a row follow it: duplicates, if it isn't blank
            row = np.repeat(np.arange(len(rows)), n)
            codes = first[row]
            again = np.ones(len(row), bool)
            again[np.cumsum(n) - n] = False
            codes = np.where(again & (codes % KINDS != BLANK), codes // KINDS * KINDS + DUPLICATE, codes)
            faults, initials = np.bincount(codes % KINDS, minlength=KINDS), codes // KINDS
            codes = codes.tolist()
            cost, audit = cheapest(codes)
            lines = [{"pos": None if i is None else rows[row[i]]["pos"], "role": role} for i, role in repaired_roles(codes, audit)]
            illegal = int((~LEGAL[initials[:-1], initials[1:]]).sum())
            out.append({"conv_id": conv, "blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]), "truncated": int(faults[CUT]), "illegal": illegal, "cost": cost, "audit": audit, "lines": lines})
        kinds = [pa.int64(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("pos", pa.int64()), ("role", pa.string())]))]
        names = [x.split()[0] for x in SOLVED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, kinds, strict=True)], names)


def _digests(batches):
    """SHA-256 of each conversation's blocks, which come in order, joined by newlines."""
    last, running, begun = None, None, False
    for batch in batches:
        convs, digests = [], []
        for conv, block in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if not begun or conv != last:
                if begun:
                    convs.append(last)
                    digests.append(running.hexdigest())
                last, running, begun = conv, hashlib.sha256(), True
            else:
                running.update(b"\n")
            running.update(block.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([running.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


class Repair:
    """Conversations with their repair. rows: conv_id, turn, role, text."""

    def __init__(self, rows: DataFrame):
        self.turns = ordered(rows)
        # a number and a count for each distinct row: as long as the audit at most
        codes = self.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "n"))).alias("rows"))
        self.solved = materialize(codes.mapInArrow(_solve, SOLVED), "solved")

    @property
    def lines(self) -> DataFrame:
        """conv_id, at, role, text: the repaired turns, numbered from 0."""
        at = self.solved.select("conv_id", F.posexplode("lines").alias("at", "line")).select("conv_id", "at", "line.*")
        texts = self.turns.select("pos", F.col("role").alias("own"), "text")
        # the place of a row is unique; inserted turns have none and stay out of the join, where they would be one key
        kept = at.filter("pos is not null").join(texts, "pos").select("conv_id", "at", F.coalesce("role", "own").alias("role"), "text")
        return kept.unionByName(at.filter("pos is null").select("conv_id", "at", "role", F.lit("").alias("text")))

    @property
    def gaps(self) -> DataFrame:
        """conv_id, gaps: turns missing between the first and the last."""
        turns = self.turns.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
        return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))

    @property
    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256 of `role:text` lines; no row for a conversation that is left empty."""
        lines = self.lines.select("conv_id", (F.col("at") / LINES).cast("long").alias("block"), "at", F.concat("role", F.lit(":"), "text").alias("line"))
        block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
        blocks = lines.groupBy("conv_id", "block").agg(block.alias("lines"))
        dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "lines")
        return dealt.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


EMPTY = hashlib.sha256(b"").hexdigest()


def repair(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """A row for each conv_id of conversations: faults, cost, audit and digest of the repair of its rows, or of its rows in damaged."""
    work = Repair(conversations if damaged is None else damaged)
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for found in (work.gaps, work.solved.drop("lines"), work.digests):
        there = out["conv_id"].eqNullSafe(found["conv_id"])
        out = out.join(found, there, "left").select(*(out[c] for c in out.columns), *(found[c] for c in found.columns if c != "conv_id"))
    counts = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(conversations, damage(conversations))


def _sql() -> str:
    step = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
    # the least cost, and of equal cost the least audit, with which each state is reached; inserts are taken up at once
    closed = lambda a, u: f"list_min([{a}, {step('st', INSERT, 'I')}, {step('sy', INSERT, 'I')}, {step(u, INSERT, 'I')}])"
    keep = lambda x, letter: f"CASE WHEN must THEN never WHEN init = '{letter}' THEN {step(x, 'more', 'K')} ELSE {step(x, f'{REROLE} + more', 'R')} END"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE c AS MATERIALIZED {CRC_TABLE_SQL},
k AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, c),
damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE d <> 0),
placed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (SELECT *, left(role, 1) AS init, right(rtrim(text, {white}), 1) AS mark, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
turns AS MATERIALIZED (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN again THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM marked),
steps AS MATERIALIZED (SELECT conv, i, n, init, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END AS more, {{'c': 1000000000, 'a': ''}} AS never FROM turns),
walk AS (
    SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, n, {{'c': 0, 'a': ''}} AS st, {{'c': 1000000000, 'a': ''}} AS sy, {{'c': {2 * INSERT}, 'a': 'II'}} AS us, {{'c': {INSERT}, 'a': 'I'}} AS ai FROM steps
    UNION ALL
    SELECT conv, i, n, st, sy, list_min([us, {step("ai", INSERT, "I")}]) AS us, ai FROM (
        SELECT conv, i, n, st, sy, us, {closed("ai", "us")} AS ai FROM (
            SELECT conv, s.i, s.n, {step("st", DELETE, "D")} AS st,
                list_min([{step("sy", DELETE, "D")}, CASE WHEN NOT must AND init = 's' THEN {step("st", "more", "K")} ELSE never END]) AS sy,
                list_min([{step("us", DELETE, "D")}, {keep("ai", "a")}]) AS us,
                list_min([{step("ai", DELETE, "D")}, {keep("st", "u")}, {keep("sy", "u")}, {keep("us", "u")}]) AS ai
            FROM walk w JOIN steps s USING (conv) WHERE s.i = w.i + 1))),
solved AS (SELECT conv, list_min([st, us]) AS best FROM walk WHERE i = n),
edits AS (SELECT conv, j, substr(best.a, j, 1) AS edit, CAST(j - len(regexp_replace(left(best.a, j), '[^I]', '', 'g')) AS BIGINT) AS i FROM (SELECT conv, best, unnest(range(1, len(best.a) + 1)) AS j FROM solved)),
kept AS (SELECT e.conv, e.j, e.edit, t.role, t.text, t.init, row_number() OVER (PARTITION BY e.conv ORDER BY e.j) AS line FROM edits e LEFT JOIN turns t ON t.conv = e.conv AND t.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
led AS (SELECT *, max(CASE WHEN line = 1 AND edit = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS lead FROM kept),
digests AS (SELECT conv, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE (line - lead) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS repaired_sha256 FROM led GROUP BY 1),
faults AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY 1),
convs AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(repaired_sha256, '{EMPTY}') AS repaired_sha256
FROM convs LEFT JOIN faults USING (conv) LEFT JOIN solved USING (conv) LEFT JOIN digests USING (conv)"""


QUERIES = {"op12_astar_repair": op12}
SQL = {"op12_astar_repair": _sql()}
