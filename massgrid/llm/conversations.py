"""Repair of conversations: the cheapest edits that make the roles alternate.

Dijkstra runs on an implicit lattice of nodes (turns consumed, state of the role grammar). Edges are Keep, Rerole, Delete
and Insert; the priority is (cost, audit), audit being the initials of the edits so far, and the search stops at the
first accepting end node that is popped. Audits are nodes of a trie with jump pointers: equal ones are one node, none is
copied, and two of them are compared in logarithmic time.

Two of equal cost at one node are never prefixes of each other, as an edit's initial and its turn decide its cost; so a
smaller audit stays smaller whatever follows, and the first pop of a node is its best.

Rows are dealt by conv_id, sorted by Spark (which spills) and streamed through Arrow batches twice: once for faults and
edits, once to replay the edits, with each conversation's audit ahead of its turns. What a task holds of one
conversation is an initial, a fault and a digest a turn and the lattice, never its texts.

Cases: a null in any column is one space where it is printed, read or hashed, and null conv_ids are one conversation of
their own; turns are taken in order, nulls first, equal ones by role and text; repeated rows are turns of their own, and
duplicates of the first; an empty text is blank; a conversation without turns is repaired to nothing; an
empty table gives an empty result; further columns, whatever their names, are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.llm.common import lean, saved, shared_folder

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = {"su", "ua", "au"}
#: Role grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or reroled turn gets, by state.
NEXT = ("user", "user", "assistant", "user")
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
#: Rows of an Arrow batch that is handed back.
FLUSH = 2048


class Audits:
    """Strings over the edits' initials as nodes of a trie; 0 is the empty one."""

    def __init__(self):
        self.parent, self.jump, self.depth, self.letter, self.children = [0], [0], [0], [""], {}

    def then(self, node: int, letter: str) -> int:
        """The node of the string one letter longer."""
        found = self.children.get((node, letter))
        if found is None:
            found, j = len(self.parent), self.jump[node]
            even = self.depth[node] - self.depth[j] == self.depth[j] - self.depth[self.jump[j]]
            self.parent.append(node)
            self.jump.append(self.jump[j] if even else node)
            self.depth.append(self.depth[node] + 1)
            self.letter.append(letter)
            self.children[node, letter] = found
        return found

    def _up(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self._up(a, depth), self._up(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Label:
    """An entry of the queue: cost and audit of a path to a node."""

    __slots__ = ("audits", "cost", "audit", "turn", "state")

    def __init__(self, audits: Audits, cost: int, audit: int, turn: int, state: int):
        self.audits, self.cost, self.audit, self.turn, self.state = audits, cost, audit, turn, state

    def __lt__(self, other: Label) -> bool:
        return self.cost < other.cost if self.cost != other.cost else self.audits.less(self.audit, other.audit)


def cheapest(initials: str | list[str], faults: bytes | bytearray | list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of turns with these role initials and faults; ties go to the smallest audit."""
    audits, n = Audits(), len(faults)
    queue, settled = [Label(audits, 0, 0, 0, START)], set()
    while True:
        at = heapq.heappop(queue)
        if (at.turn, at.state) in settled:
            continue
        settled.add((at.turn, at.state))
        if at.turn == n and at.state in (START, ASSISTANT):
            return at.cost, audits.text(at.audit)
        edges = [(INSERT, "I", at.turn, STEP[at.state, NEXT[at.state][0]])]
        if at.turn < n:
            fault = faults[at.turn]
            edges.append((DELETE, "D", at.turn + 1, at.state))
            if fault in (NONE, TRUNCATED):
                stays = CUT_OFF if fault == TRUNCATED else 0
                edges.append((REROLE + stays, "R", at.turn + 1, STEP[at.state, NEXT[at.state][0]]))
                kept = STEP.get((at.state, initials[at.turn]))
                if kept is not None:
                    edges.append((stays, "K", at.turn + 1, kept))
        for cost, letter, turn, state in edges:
            if (turn, state) not in settled:
                heapq.heappush(queue, Label(audits, at.cost + cost, audits.then(at.audit, letter), turn, state))


class Conversation:
    """What the first pass holds of one conversation."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.first = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        """The next turn in order."""
        bare = text.rstrip(SPACES)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.faults.append(BLANK if not bare else DUPLICATE if digest in self.seen else TRUNCATED if bare[-1] not in STOPS else NONE)
        self.seen.add(digest)
        self.illegal += bool(self.initials) and self.initials[-1] + role[:1] not in LEGAL
        self.initials.append(role[:1])
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def row(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (conv_id, gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, *cheapest(self.initials, self.faults))


def replayed(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the audit leaves, in order; turns are taken as they are needed."""
    state = START
    for edit in audit:
        role, text = (NEXT[state], "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        role = role if edit == "K" else NEXT[state]
        state = STEP[state, role[0]]
        yield edit, role, text


def damaged(rows: DataFrame) -> DataFrame:
    """(part, conv_id, turn, role, text): turns damaged by crc32 of `conv_id:turn`, part 1; a dropped one leaves a mark of its conversation, part 2."""
    printed = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(printed("conv_id"), F.lit(":"), printed("turn")).cast("binary")) % 20
    few = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), printed("role").alias("role"), printed("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    role = F.when(gone, None).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(gone, None).when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return few.select(F.when(gone, 2).otherwise(1).alias("part"), "conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def turns(rows: DataFrame) -> DataFrame:
    """The same columns of turns as they are."""
    printed = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.lit(1).alias("part"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), printed("role").alias("role"), printed("text").alias("text"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of FLUSH rows or, as texts may be long, of 8 MB or a little more."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == FLUSH or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _by_conversation(rows: DataFrame, answer: Callable[[int | None, Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """answer(conv_id, rows in order) for every conversation, streamed."""
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped = groupby(_streamed(batches), itemgetter(0))
        return _packed((out for conv_id, own in grouped for out in answer(conv_id, own)), schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "part", "turn", "role", "text").mapInArrow(lean(run), ddl)


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation of turns() or damaged()."""

    def answer(conv_id: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        held = Conversation()
        for _, part, turn, role, text in own:
            if part == 1:
                held.add(turn, role, text)
        yield held.row(conv_id)

    return _by_conversation(rows, answer, AUDITS)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns after repair, each conversation's in order within its task."""

    def answer(conv_id: int | None, own: Iterator[tuple]) -> Iterator[tuple]:
        audit = next(own)[4]  # part 0
        for place, out in enumerate(replayed(audit, ((role, text) for _, part, _, role, text in own if part == 1))):
            yield (conv_id, place, *out)

    heads = found.select(F.lit(0).alias("part"), "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return _by_conversation(rows.unionByName(heads), answer, REPAIRED)


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of repaired(), as they stream: `role:text`, joined by newlines."""
    ddl = "conv_id long, repaired_sha256 string"
    schema = _schema(ddl)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, own in groupby(_streamed(batches), itemgetter(0)):
            digest = hashlib.sha256()
            for _, place, role, text in own:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield conv_id, digest.hexdigest()

    return fixed.select("conv_id", "place", "role", "text").mapInArrow(lambda batches: _packed(hashed(batches), schema), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: damaged conversations, their faults, cheapest repair and the digest of what it gives."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = saved(audits(rows), "audits", shared_folder(spark, "conversations"))
    after = digests(repaired(rows, found)).withColumnRenamed("conv_id", "of")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return found.join(after, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*found.columns, digest)
