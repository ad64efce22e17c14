"""Conversation structure repair over a suffix-shared automaton.

A conversation becomes a signature: one letter a row for its role and fault. Equal
ends of signatures are shared: distinct signatures are sorted from their end, so
each distinct suffix is one node, met once, and its cheapest way to the end is
worked out once for each state of the grammar, from the node of the suffix one
letter shorter. A conversation's repair is read off the node of its signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.session import materialize, small_side

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; and those it may end in.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START, ASSISTANT}
#: What an added or changed role is, and the state it leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Letters of a signature: rows that must go, and rows by role, in upper case if truncated.
MUST_GO, OTHER = "x", "o"

_SPACE = r"[\x20\x09-\x0D]"


# ---- the automaton ----------------------------------------------------------------------------


def _kept(letter: str, state: int) -> int | None:
    """The state after a row that stays as it is; none where the grammar has no such row."""
    if letter == "s":
        return SYSTEM if state == START else None
    if letter == "u":
        return USER if state != USER else None
    if letter == "a":
        return ASSISTANT if state == USER else None
    return None


class Node:
    """A suffix: for each state the cost to go and its first edit; the rest is read off the node it leads to."""

    __slots__ = ("after", "cost", "edit")

    def __init__(self, letter: str, after: Node | None) -> None:
        self.after = after
        self.cost: list[int] = []
        self.edit: list[str] = []
        for state in range(4):
            cost, edit = self._without_insert(letter, state)
            self.cost.append(cost)
            self.edit.append(edit)
        # An insert leads to another state of the same node; three in a row reach every state.
        for _ in range(3):
            for state in range(4):
                added = INSERT + self.cost[NEXT[state]]
                if added < self.cost[state] or (added == self.cost[state] and self.edit[state] > "I"):
                    self.cost[state], self.edit[state] = added, "I"

    def _without_insert(self, letter: str, state: int) -> tuple[int, str]:
        if self.after is None:
            return (0, "") if state in ENDS else (1 << 40, "~")
        ways = [(DELETE + self.after.cost[state], "D")]
        if letter != MUST_GO:
            stays = TRUNCATED if letter.isupper() else 0
            to = _kept(letter.lower(), state)
            if to is not None:
                ways.append((stays + self.after.cost[to], "K"))
            ways.append((stays + REROLE + self.after.cost[NEXT[state]], "R"))
        return min(ways)


def repair(signatures: Iterator[str]) -> Iterator[tuple[str, int, str, list[int], list[str | None]]]:
    """(signature, cost, audit, places, roles) for signatures that come sorted by their reversed text.

    Places and roles say what the edits leave: the row (-1 for an added one) and its new role, if
    it gets one. Only the nodes on the way to the last signature are held: the next one shares its
    longest common suffix with it, and none behind it needs what is dropped.
    """
    path, last = [Node("", None)], ""
    for signature in signatures:
        back = signature[::-1]
        shared = next((i for i, (a, b) in enumerate(zip(back, last, strict=False)) if a != b), min(len(back), len(last)))
        del path[shared + 1 :]
        for letter in back[shared:]:
            path.append(Node(letter, path[-1]))
        last = back
        yield signature, path[-1].cost[START], *_read(path[-1], signature)


def _read(node: Node, signature: str) -> tuple[str, list[int], list[str | None]]:
    """Audit, places and roles along the cheapest way from a node."""
    state, at = START, 0
    audit: list[str] = []
    places: list[int] = []
    roles: list[str | None] = []
    while edit := node.edit[state]:
        audit.append(edit)
        if edit == "K":
            state = _kept(signature[at].lower(), state)
        elif edit in "RI":
            state = NEXT[state]
        if edit != "D":
            places.append(-1 if edit == "I" else at)
            roles.append(None if edit == "K" else "user" if state == USER else "assistant")
        if edit != "I":
            node, at = node.after, at + 1
    return "".join(audit), places, roles


_AUDITS = {"signature": pa.string(), "cost": pa.int64(), "audit": pa.string(), "places": pa.list_(pa.int32()), "roles": pa.list_(pa.string())}


def audits(signatures: DataFrame) -> DataFrame:
    """``signature``, ``cost``, ``audit``, ``places``, ``roles`` of distinct signatures.

    A range of the order by reversed text is one task's share. Suffixes that span two ranges are
    worked out in both; no other is worked out twice.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _AUDITS.values(), strict=True)], names=list(_AUDITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in repair(s for b in batches for s in b.column("signature").to_pylist()):
            rows.append(row)
            size += len(row[2])
            if size > 1 << 20 or len(rows) == 4096:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    ordered = signatures.select("signature", F.reverse("signature").alias("back")).repartitionByRange("back").sortWithinPartitions("back")
    return ordered.select("signature").mapInArrow(run, "signature string, cost long, audit string, places array<int>, roles array<string>")


# ---- rows ---------------------------------------------------------------------------------------


def signed(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """A row a conversation: ``conv_id``, counts of its faults, ``rows`` (role, text) in order and their ``signature``."""
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    named = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), gone.alias("gone")
    )
    named = named.repartition("conv_id")  # serves both windows and the grouping: texts move once
    again = Window.partitionBy("conv_id", "gone", "role", F.md5("text")).orderBy("place")
    in_order = Window.partitionBy("conv_id", "gone").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    placed = named.withColumns({
        "place": F.row_number().over(in_order), "before": F.lag(initial).over(in_order), "new_turn": ~F.col("turn").eqNullSafe(F.lag("turn").over(in_order)),
    }).withColumn("copy", F.row_number().over(again) > 1)
    tail = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(tail == "", "blank").when(F.col("copy"), "duplicate").when(~F.substring(tail, -1, 1).isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    judged = placed.withColumn("fault", fault).withColumn("letter", F.when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind))
    there = ~F.col("gone")

    def counted(condition: Column, name: str) -> Column:
        return F.count(F.when(there & condition, 1)).alias(name)

    turns = F.when(there, F.col("turn"))
    grouped = judged.groupBy("conv_id").agg(
        F.coalesce(F.max(turns) - F.min(turns) + 1 - F.count(F.when(F.col("new_turn"), turns)), F.lit(0)).cast("long").alias("gaps"),
        *[counted(F.col("fault") == name, name) for name in ("blank", "duplicate", "truncated")],
        counted(~F.concat("before", initial).isin("su", "ua", "au"), "illegal"),
        F.array_sort(F.collect_list(F.when(there, F.struct("place", "letter", "role", "text")))).alias("rows"),
    )
    return grouped.withColumn("signature", F.array_join(F.transform("rows", lambda x: x["letter"]), ""))


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """A row a conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``turns``, the repaired rows (role, text).

    Rows are taken by turn, null turns first, equal turns by role and text. A row's first fault
    counts: blank (nothing but space), duplicate (role and text seen before in the conversation),
    truncated (doesn't end in . ! or ?). Edits keep a row (0), change its role to user or assistant
    (3), delete it (4; blank rows and duplicates must go) or add an empty user or assistant row
    (3); a truncated row that stays adds 3. ``audit`` has the initials of the cheapest edits that
    give an optional system row and then user and assistant in turn, the least in ASCII of equally
    cheap ones. Null roles and texts count as one space; a null conversation id is an id; repeated
    rows are duplicates. Rows where ``gone`` holds only name their conversation: one without any
    other row has zeros, an empty audit and no turns. Other columns are not read; an empty table
    gives an empty result. A conversation's rows come together in one task, as its result is one
    row that holds them; conversations of one signature are repaired once.
    """
    conversations = materialize(signed(rows, conv_id, turn, role, text, gone))
    known = small_side(audits(conversations.select("signature").distinct()))
    joined = conversations.join(known, "signature")
    row = lambda p: F.get("rows", p)
    turns = F.zip_with("places", "roles", lambda p, r: F.struct(F.coalesce(r, row(p)["role"]).alias("role"), F.coalesce(row(p)["text"], F.lit("")).alias("text")))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", turns.alias("turns"))
