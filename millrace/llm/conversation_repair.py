"""Repair of conversation structure: the cheapest edits that make the roles a legal sequence, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an edit costs, and what a truncated turn costs that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Where a role's initial leads in ``(s?(ua)+)?``.  States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: The role that an inserted or changed turn gets in each state, and the state after it.
MADE = {0: 2, 1: 2, 2: 3, 3: 2}
#: Turns that are searched at a time.
BLOCK = 256
ROLES = {"u": "user", "a": "assistant"}
BLANK, STOP = " \t\n\x0b\x0c\r", ".!?"


def settle(codes: str, starts: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest cost and then least audit with which each state is reached after all turns of ``codes``, from the ``starts`` (the same by state).

    A code is a role's initial (``x`` for others), in upper case if the turn is
    truncated, or ``d`` if it has to go.  A* on (turn, state): the heuristic
    adds up, from the end, the deletions that the remaining turns demand and
    what each truncated turn costs at least, deleted or not.  It never falls by
    more than a step costs, so the first time that a node leaves the queue,
    which is ordered by cost and heuristic and then by audit, its audit is final:
    of two audits that reach one node at the same cost, none begins the other.
    If ``last``, the search ends at the first node that may end.
    """
    rest = [0]
    for c in reversed(codes):
        rest.append(rest[-1] + (DELETE if c == "d" else TRUNCATED if c.isupper() else 0))
    rest.reverse()
    queue = [(cost + rest[0], audit, 0, state, cost) for state, (cost, audit) in starts.items()]
    heapq.heapify(queue)
    seen, out = set(), {}
    while queue:
        _, audit, i, state, cost = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        steps = [(0, MADE[state], INSERT, "I")]
        if i == len(codes):
            out[state] = cost, audit
            if last and state in ENDS:
                return {state: (cost, audit)}
        else:
            steps.append((1, state, DELETE, "D"))
            if (c := codes[i]) != "d":
                more = TRUNCATED if c.isupper() else 0
                steps.append((1, MADE[state], REROLE + more, "R"))
                if (state, c.lower()) in STEP:
                    steps.append((1, STEP[state, c.lower()], more, "K"))
        for far, to, price, edit in steps:
            if (i + far, to) not in seen:
                heapq.heappush(queue, (cost + price + rest[i + far], audit + edit, i + far, to, cost + price))
    return out


def repaired(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """The least cost for the turns of a conversation, and the least audit of that cost.

    Turns are searched in blocks.  Between two blocks stand the best ways into
    each state; what they have in common is settled, so that only their ends
    are carried on.
    """
    if len(codes) <= min(block, 64):
        return _short(codes)
    ways, settled = {0: (0, "")}, []
    for at in range(0, len(codes), block):
        ways = settle(codes[at : at + block], ways, at + block >= len(codes))
        done = commonprefix([audit for _, audit in ways.values()])
        settled.append(done)
        ways = {state: (cost, audit[len(done) :]) for state, (cost, audit) in ways.items()}
    (cost, audit), = ways.values()
    return cost, "".join(settled) + audit


@lru_cache(1 << 14)
def _short(codes: str) -> tuple[int, str]:
    (found,) = settle(codes, {0: (0, "")}, True).values()
    return found


class Writer:
    """Applies an audit to the turns of a conversation, one after the other; its length tells the role of each turn that is made."""

    def __init__(self, audit: str):
        self.audit, self.read, self.written = audit, 0, 0
        self.at = (len(audit) - audit.count("D")) % 2  # an odd number begins with a system turn; from then on users and assistants alternate

    def _made(self) -> str:
        return ROLES["ua"[(self.written - self.at) % 2]]

    def inserts(self) -> Iterator[tuple[int, str, str]]:
        """The turns (number, role, text) that the audit inserts here."""
        while self.audit[self.read : self.read + 1] == "I":
            self.read += 1
            yield self.written, self._made(), ""
            self.written += 1

    def take(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        """What comes of the next turn, and what is inserted before it."""
        yield from self.inserts()
        edit = self.audit[self.read]
        self.read += 1
        if edit != "D":
            yield self.written, role if edit == "K" else self._made(), text
            self.written += 1


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def with_faults(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20; a null counts as one blank.

    0 drops the turn, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` from
    it, 3 repeats it, and 4 makes its role ``user``.
    """
    kind = F.pmod(F.crc32(F.concat(_filled(conv_col), F.lit(":"), _filled(turn_col))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_filled(text_col), STOP, "")).otherwise(_filled(text_col))
    role = F.when(kind == 4, "user").otherwise(_filled(role_col))
    row = F.struct(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col))
    return turns.filter(kind != 0).select(F.explode(F.array_repeat(row, F.when(kind == 3, 2).otherwise(1))).alias("row")).select("row.*")


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def audits(turns: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``turns`` and each id of ``every``: its faults and the cheapest repair.

    ``gaps`` counts the numbers missing between the first and the last turn.  A
    turn's first fault counts: ``blank``, ``duplicate`` (role and text stand
    earlier in the conversation) or ``truncated`` (the last character that is
    not a blank is none of ``.!?``); ``illegal`` counts neighbours whose initials
    are not su, ua or au.  ``cost`` and ``audit`` are those of ``repaired``.

    Turns are read in the order of ``turn`` (nulls first), then role, then the
    digest of role and text.  No texts are moved, only what faults there are,
    and a task holds a letter and a digest for each turn of one conversation.

    A null text or role counts as one blank, so such turns are blank or have a
    role that has to be changed; a role without a character cannot be kept
    either.  Turns without a conversation id are one conversation, of the null
    id.  A conversation without turns has zeros and an empty audit.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    facts = rows.select("conv", F.lit(True).alias("here"), "turn", "role", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(*STOP)).alias("truncated"), "digest")
    kind = rows.schema["conv"].dataType.simpleString()
    if every is not None:
        ids = every.select(F.col(conv_col).cast(kind).alias("conv")).distinct()
        facts = facts.unionByName(ids.withColumn("here", F.lit(False)), allowMissingColumns=True)
    ordered = facts.repartition("conv").sortWithinPartitions("conv", *_ORDER).drop("role")
    return ordered.mapInArrow(_judge, f"conv {kind}, {FOUND}").withColumnRenamed("conv", conv_col)


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), _filled(role_col).alias("role"), _filled(text_col).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


#: Nulls are first where a sort is ascending.
_ORDER = ("turn", "role", "digest")


def _beside(turns: DataFrame, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The turns of each conversation in order, after a row with what ``audits`` found of it."""
    rows = _turns(turns, *names)
    first = found.select(F.col(names[0]).alias("conv"), F.struct(*NAMES).alias("found"))
    both = first.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("found").isNull(), *_ORDER).select("conv", "found", "role", "text")


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of each conversation after its cheapest repair: id, ``turn`` (from 0), ``role`` and ``text``.

    Nulls, ties and empty tables are as in ``audits``.  Texts are moved once,
    beside the audits; a task holds one turn of them at a time.
    """
    names = (conv_col, turn_col, role_col, text_col)
    both = _beside(turns, audits(turns, None, *names), names)
    kind = both.schema["conv"].dataType.simpleString()
    return both.mapInArrow(_rewrite, f"conv {kind}, turn long, role string, text string").toDF(*names)


def repair(turns: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of ``audits`` with ``repaired_sha256``, of the lines ``role:text`` that ``repaired_turns`` gives, joined by newlines.

    A conversation without turns has the digest of the empty text.  All of one
    goes through one task, as a stream, since the digest depends on all of it.
    """
    names = (conv_col, turn_col, role_col, text_col)
    both = _beside(turns, audits(turns, every, *names), names)
    kinds = f"conv {both.schema['conv'].dataType.simpleString()}, found {both.schema['found'].dataType.simpleString()}, repaired_sha256 string"
    return both.mapInArrow(_digest, kinds).select(F.col("conv").alias(conv_col), "found.*", "repaired_sha256")


class _Facts:
    """What is known of a conversation while its turns go by."""

    def __init__(self):
        self.codes, self.digests, self.before = bytearray(), set(), None
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turn = None

    def add(self, turn, initial: str, blank: bool, truncated: bool, digest: bytes) -> None:
        if turn is not None:
            self.gaps += 0 if self.turn is None or turn == self.turn else turn - self.turn - 1
            self.turn = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = initial if initial and initial in "sua" else "x"
        if blank:
            self.blank += 1
            code = "d"
        elif digest in self.digests:
            self.duplicate += 1
            code = "d"
        elif truncated:
            self.truncated += 1
            code = code.upper()
        self.digests.add(digest)
        self.codes += code.encode()

    def row(self) -> tuple:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, *repaired(self.codes.decode())


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    facts, now, kinds = _Facts(), None, None
    for b in batches:
        done = []
        for conv, here, *fact in zip(*(b.column(c).to_pylist() for c in ("conv", "here", "turn", "initial", "blank", "truncated", "digest")), strict=True):
            if kinds and conv != now:
                done.append((now, *facts.row()))
                facts = _Facts()
            now, kinds = conv, [b.column("conv").type, *[pa.int64()] * (len(NAMES) - 1), pa.string()]
            if here:
                facts.add(*fact)
        if done:
            yield _batch(["conv", *NAMES], kinds, done)
    if kinds:
        yield _batch(["conv", *NAMES], kinds, [(now, *facts.row())])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = now = kind = None
    names, text = ["conv", "turn", "role", "text"], [pa.int64(), pa.string(), pa.string()]
    for b in batches:
        kind, done = b.column("conv").type, []
        for conv, found, *turn in zip(*(b.column(c).to_pylist() for c in ("conv", "found", "role", "text")), strict=True):
            if found is None:
                done += [(now, *t) for t in writer.take(*turn)]
                continue
            if writer:
                done += [(now, *t) for t in writer.inserts()]
            now, writer = conv, Writer(found["audit"])
        yield _batch(names, [kind, *text], done)
    if writer:
        yield _batch(names, [kind, *text], [(now, *t) for t in writer.inserts()])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = now = found = kinds = sha = None

    def add(turns: Iterator[tuple[int, str, str]]) -> None:
        for n, role, text in turns:
            sha.update((("\n" if n else "") + f"{role}:{text}").encode())

    def row() -> tuple:
        add(writer.inserts())
        return now, found, sha.hexdigest()

    for b in batches:
        kinds, done = [b.column("conv").type, b.column("found").type, pa.string()], []
        for conv, what, *turn in zip(*(b.column(c).to_pylist() for c in ("conv", "found", "role", "text")), strict=True):
            if what is None:
                add(writer.take(*turn))
                continue
            if writer:
                done.append(row())
            now, found, writer, sha = conv, what, Writer(what["audit"]), hashlib.sha256()
        yield _batch(["conv", "found", "repaired_sha256"], kinds, done)
    if writer:
        yield _batch(["conv", "found", "repaired_sha256"], kinds, [row()])
