"""Operator 12, conversation structure repair over a suffix-shared automaton.

A row's signature letter says what may happen to it: its role's initial (``s``, ``u``, ``a``, else ``o``), upper case where the
text is cut off, or ``X`` where it must be deleted (blank, or a repetition). A conversation's letters, in
blocks of ``BLOCK`` rows, are words; equal words of all conversations are one. Sorted from their ends, words
that share a suffix lie together, so a sweep with a stack meets every node of the automaton (a suffix) once:
``Automaton`` computes there, for each grammar state, the cost to go and the best audit suffix from
the node below. A full block has four exits, one for each state it can be left in; a shorter block ends its conversation.
Blocks of a conversation are then chained from the end, four states at a time, and its audit replayed over the texts.

Grammar states: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``; accepted are ``(s?(ua)+)?``, that is states 0 and 3.
An insertion or a change of role always gives the one of user / assistant that the state allows. Audits of different
exits never are prefixes of each other (each ends with a row's letter and has as many of them), so comparing block audits is enough.

**Scale.** Texts move once, to be hashed (SHA-256 needs a conversation's lines in order; they are streamed, not held). All
else works on narrow rows: positions come from range parts, so one conversation may fill many tasks; repetitions are
looked up by (conv_id, digest). A conversation's blocks meet in one task as about 40 bytes a row,
the only group that grows with a conversation; its audit has to be one value anyway.

Defined results: a null role or text is one space, a null conv_id or turn is written as one space in the damage key; null
conv_ids are one conversation. Rows tie in turn: by role, then by SHA-256 of role and text; rows alike in all are interchangeable. A conversation without
rows gets zeros, an empty audit and the hash of nothing. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import stored
from quantloom.llm.streams import grouped, running_sums, stream

BLOCK = 64
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: The role that each grammar state allows next besides a leading system row, the state it leads to, and where a role may be kept.
ALLOWED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: Cost and audit of ending a conversation in each state.
ENDING = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
_NOT_BLANK = r"[^\x20\x09-\x0D]"
_EMPTY = sha256().hexdigest()


class Automaton:
    """Nodes on the path of the word read last; ``value`` computes only what its path does not share."""

    def __init__(self) -> None:
        self._path = ""
        self._values: list[list] = []

    @staticmethod
    def root(full: bool) -> list:
        """By exit and state, (cost, audit): one exit for an ended conversation, else one for each state."""
        if not full:
            return [ENDING]
        return [[(0, "") if state == leave else None for state in range(4)] for leave in range(4)]

    @staticmethod
    def step(letter: str, below: list) -> list:
        """The node in front of ``below``. Ties go to the audit least in ASCII order."""
        fault = CUT_OFF if letter.isupper() else 0
        out = []
        for cells in below:
            base = []
            for state in range(4):
                ways = [(cells[state][0] + DELETE, "D" + cells[state][1])] if cells[state] else []
                if letter != "X":
                    kept = cells[KEPT[letter.lower()].get(state, 0)] if state in KEPT[letter.lower()] else None
                    turned = cells[AFTER[state]]
                    if kept:
                        ways.append((kept[0] + fault, "K" + kept[1]))
                    if turned:
                        ways.append((turned[0] + fault + REROLE, "R" + turned[1]))
                base.append(min(ways, default=None))
            made = []
            for state in range(4):
                ways = [base[state]] if base[state] else []
                once = AFTER[state]
                for n, there in ((1, once), (2, AFTER[once])):
                    if base[there]:
                        ways.append((base[there][0] + n * INSERT, "I" * n + base[there][1]))
                made.append(min(ways, default=None))
            out.append(made)
        return out

    def value(self, word: str) -> list:
        path = ("#" if len(word) == BLOCK else "$") + word[::-1]
        shared = 0
        while shared < min(len(path), len(self._path)) and path[shared] == self._path[shared]:
            shared += 1
        del self._values[shared:]
        for at in range(shared, len(path)):
            self._values.append(self.root(path[0] == "#") if at == 0 else self.step(path[at], self._values[-1]))
        self._path = path
        return self._values[-1]


def _text_key(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows left by a fixed damage that depends on conv_id and turn."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named) % 20).alias("_kind")
    )
    kind, text = F.col("_kind"), F.col("text")
    texts = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    roles = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(kind != 0).select("conv_id", "turn", roles.alias("role"), texts.alias("text"), copies.alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row per row: position, role initial, signature letter and its first fault."""
    text = F.col("text")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = rows.select(
        "conv_id", "turn", "role", _text_key(F.col("role"), text).alias("key"), letter.alias("initial"), (~text.rlike(_NOT_BLANK)).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"), F.monotonically_increasing_id().alias("rid"), F.lit(1).alias("one"),
    )
    placed = running_sums(narrow, "repair-order", ["conv_id"], ["turn", "role", "key", "rid"], {"place": "one"}).drop("rid", "one", "role")
    placed = stored(placed, "repair-placed")
    again = placed.where(~F.col("blank")).groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = placed.join(again, (F.col("key") == F.col("_k")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    first = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("_first"), "duplicate").when(F.col("cut_off"), "truncated")
    signed = F.when(first.isin("blank", "duplicate"), "X").when(first == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return met.select("conv_id", "turn", "place", "initial", first.alias("fault"), signed.alias("letter"))


def words(marked: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, word, initials, counts): rows of each block of ``size`` rows as two strings."""
    block = F.floor((F.col("place") - 1) / size).alias("block")
    rows = F.array_sort(F.collect_list(F.struct("place", "letter", "initial")))
    text = lambda name: F.array_join(F.transform("_rows", lambda r: r[name]), "")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return marked.groupBy("conv_id", block).agg(rows.alias("_rows"), *counts).select("conv_id", "block", text("letter").alias("word"), text("initial").alias("initials"), "blank", "duplicate", "truncated")


_CELLS = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def solved(found: DataFrame) -> DataFrame:
    """(word, cells): for every distinct word, cost and audit by exit and entry state (four to an exit), computed once per shared suffix."""

    def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton = Automaton()
        for word, _ in rows:
            yield word, [cell and {"cost": cell[0], "audit": cell[1]} for cells in automaton.value(word) for cell in cells]

    distinct = found.select("word").distinct().withColumn("_end", F.reverse("word"))
    ordered = distinct.repartitionByRange("_end").sortWithinPartitions("_end").select("word", "_end")
    return stream(ordered, sweep, T.StructType([T.StructField("word", T.StringType()), T.StructField("cells", _CELLS)]))


def _chain(blocks: list[list]) -> tuple[int, str]:
    """Least cost and least audit through a conversation's blocks, read from the end."""
    ahead = [cost for cost, _ in ENDING]
    chosen = []
    for cells in reversed(blocks):
        if len(cells) == 4:  # ends the conversation
            choice, ahead = [(0, state) for state in range(4)], [cell["cost"] for cell in cells]
        else:
            ways = [min(((cells[4 * leave + state]["cost"] + ahead[leave], cells[4 * leave + state]["audit"], leave) for leave in range(4) if cells[4 * leave + state]), default=None) for state in range(4)]
            choice, ahead = [way and (way[2], state) for state, way in enumerate(ways)], [way[0] if way else 1 << 60 for way in ways]
        chosen.append(choice)
    state, audit = 0, []
    for cells, choice in zip(blocks, reversed(chosen)):
        leave = choice[state][0]
        audit.append(cells[4 * leave + state]["audit"])
        state = leave
    if len(blocks[-1]) != 4:
        audit.append(ENDING[state][1])
    return ahead[0], "".join(audit)


def _illegal(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def audits(found: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) from a conversation's blocks."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, blocks, bad, last = None, [], 0, ""
        for conv, initials, cells in rows:
            if blocks and conv != key:
                yield (key, bad, *_chain(blocks))
                blocks, bad, last = [], 0, ""
            key = conv
            blocks.append(cells)
            bad += _illegal(last + initials)
            last = initials[-1]
        if blocks:
            yield (key, bad, *_chain(blocks))

    met = found.join(plans, "word").select("conv_id", "block", "initials", "cells")
    ordered = grouped(met, ["conv_id"], ["block"]).select("conv_id", "initials", "cells")
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("illegal", "cost")], T.StructField("audit", T.StringType())])
    return stream(ordered, fold, schema)


def replay(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): each conversation's rows edited by its audit, as ``role:text`` lines.

    The plan comes first, the rows follow in order; a line is hashed and dropped.
    """

    def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = plan = state = None
        at = where = lines = 0

        def add(role: str, text: str) -> None:
            nonlocal lines
            state.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1

        def inserted() -> None:
            nonlocal at, where
            while at < len(plan) and plan[at] == "I":
                add(ALLOWED[where], "")
                at, where = at + 1, AFTER[where]

        for conv, audit, role, text in rows:
            if audit is not None:
                if plan is not None:
                    inserted()
                    yield key, state.hexdigest()
                key, plan, state = conv, audit, sha256()
                at = where = lines = 0
                continue
            inserted()
            if plan[at] == "K":
                add(role, text)
                where = KEPT[role[:1]][where]
            elif plan[at] == "R":
                add(ALLOWED[where], text)
                where = AFTER[where]
            at += 1
        if plan is not None:
            inserted()
            yield key, state.hexdigest()

    lines = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _text_key(F.col("role"), F.col("text")).alias("key"), F.lit(None).cast("string").alias("audit"), "text")
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(lines.schema[n].dataType).alias(n) for n in ("turn", "role", "key")], "audit", F.lit(None).cast("string").alias("text"))
    ordered = grouped(heads.unionByName(lines), ["conv_id"], ["kind", "turn", "role", "key"]).select("conv_id", "audit", "role", "text")
    return stream(ordered, edited, T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())]))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, edits and the repaired conversation's hash for every conversation among the rows (conv_id, turn, role, text)."""
    marked = stored(faults(rows), "repair-faults")
    turns = marked.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    found = stored(words(marked), "repair-words")
    counts = found.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    plans = stored(audits(found, solved(found)), "repair-plans")
    out = plans
    for part in (gaps, counts, replay(rows, plans)):
        right = part.withColumnRenamed("conv_id", "_id")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return out


def op12(conversations: DataFrame) -> DataFrame:
    repaired = repair(damage(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return every.select(
        "conv_id", *[zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"),
    )
