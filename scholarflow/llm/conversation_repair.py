"""Repair of chat logs by Knuth's lightest derivations.

An item says that a stretch of rows can be repaired so that a state of the role
grammar leads to another one; its weight is (cost, audit). A row gives items by its
edits (keep, rerole, delete), an insertion extends an item, and two neighbouring
stretches join where the first one's state is the second one's. Costs add up and
audits are put one behind the other, so no derivation weighs less than the one it
extends, and an agenda that pops items by (cost, audit) finalises each at its least
weight; it ends when it pops a goal.

Rows are dealt by ranges of (conversation, turn), so a huge conversation lies in
several tasks: each gives the items of its own stretch for every state, and these
few tables of a conversation are joined by the same agenda.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# states of (s?(ua)+)? by the last initial; START and AFTER_A accept
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {
    START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U},
}
GOALS = frozenset({START, AFTER_A})
# rows of a stretch whose items are derived one by one
STRETCH = 256
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_PLACE = ("turn", "role", "digest")

# items of a stretch: state before -> [(state after, cost, audit)]
Items = dict[int, list[tuple[int, int, str]]]


@lru_cache(maxsize=None)
def row_items(initial: str, gone: bool, cut: bool) -> Items:
    """The items of one row: ``gone`` rows must be deleted, ``cut`` ones cost more if they stay."""
    extra = CUT if cut else 0
    out: Items = {}
    for state, follow in NEXT.items():
        items = [(state, DELETE, "D")]
        if not gone:
            items += [(follow[x], REROLE + extra, "R") for x in ROLES if x in follow]
            if initial in follow:
                items.append((follow[initial], KEEP + extra, "K"))
        out[state] = items
    return out


def lightest(stretches: list[Items], start: int, goals: frozenset[int] = frozenset()) -> list[tuple[int, int, str]]:
    """The lightest items that lead from ``start`` through all ``stretches``: (state, cost, audit).

    With ``goals`` the agenda stops at the first goal it pops, which is the one result.
    """
    agenda = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    out = []
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(stretches):
            if state in goals:
                return [(state, cost, audit)]
            out.append((state, cost, audit))
        else:
            for after, more, edits in stretches[i].get(state, ()):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + edits, i + 1, after))
        for x in ROLES:
            after = NEXT[state].get(x)
            if after is not None and (i, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, after))
    return out


class Stretches:
    """The items of a growing run of rows, in so little memory as their audits need.

    Rows become one table per ``STRETCH`` rows; tables of equally many rows are
    joined in pairs, so that each audit is copied a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.rows: list[Items] = []
        self.tables: list[tuple[int, Items]] = []

    def add(self, row: Items) -> None:
        self.rows.append(row)
        if len(self.rows) == STRETCH:
            self._close()

    def _close(self) -> None:
        table, size = {p: lightest(self.rows, p) for p in NEXT}, 1
        self.rows = []
        while self.tables and self.tables[-1][0] == size:
            before = self.tables.pop()[1]
            table, size = {p: lightest([before, table], p) for p in NEXT}, size * 2
        self.tables.append((size, table))

    def items(self) -> Items:
        """The items for every state before, of all rows so far."""
        parts = [t for _, t in self.tables] + self.rows
        return {p: lightest(parts, p) for p in NEXT}

    def repair(self) -> tuple[int, str]:
        """(cost, audit) of the lightest repair of all rows."""
        return lightest([t for _, t in self.tables] + self.rows, START, GOALS)[0][1:]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with planted faults, by crc32 of 'conv_id:turn' modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``[.!?]`` out, 3 gives it twice,
    4 makes its role user. NULL roles and texts become one space, as do NULL ids
    and turns in the hashed text only. Other columns are dropped.
    """
    blank = F.lit(" ")
    named = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)
    )
    code = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _digest() -> F.Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, blank, later, cut: equal rows of a turn are one, n times.

    ``later`` says that an earlier turn has the role and text. Texts stay behind.
    """
    ended = F.col("text").rlike(_ENDED)
    narrow = rows.select("conv_id", "turn", "role", _digest(), (~F.col("text").rlike(_NOT_SPACE)).alias("blank"), (~ended).alias("cut"))
    once = narrow.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    firsts = once.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")).agg(
        F.min(F.struct("turn")).alias("least"), F.count(F.lit(1)).alias("turns")
    ).where("turns > 1")
    on = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    return once.join(firsts, on, "left").select(*once.columns, later.alias("later"))


_TABLE = "array<struct<before:int,after:int,cost:long,audit:string>>"
_PART = f"conv_id CONV, turn TURN, role string, digest binary, whole boolean, illegal long, first string, last string, cost long, audit string, items {_TABLE}"
_LEGAL = frozenset({"su", "ua", "au"})


def _flat(items: Items) -> list[dict]:
    return [{"before": p, "after": q, "cost": c, "audit": a} for p, found in items.items() for q, c, a in found]


def _derive(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation and task. A conversation that has others of the task
    on both sides lies there whole and gives its repair, else the items of its stretch."""
    out: list[dict] = []
    open_row: dict | None = None
    run = Stretches()
    count = 0

    def close(whole: bool) -> dict:
        if whole:
            cost, audit = run.repair()
            return open_row | {"whole": True, "cost": cost, "audit": audit, "items": None}
        return open_row | {"whole": False, "cost": None, "audit": None, "items": _flat(run.items())}

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "n", "blank", "later", "cut"))
        for conv, turn, role, digest, n, blank, later, cut in zip(*columns):
            if open_row is None or conv != open_row["conv_id"]:
                if open_row is not None:
                    out.append(close(count > 1))
                count += 1
                open_row = {"conv_id": conv, "turn": turn, "role": role, "digest": digest, "illegal": 0, "first": role[:1], "last": None}
                run = Stretches()
            initial = role[:1]
            if open_row["last"] is not None:
                open_row["illegal"] += (open_row["last"] + initial) not in _LEGAL
            open_row["illegal"] += n - 1  # a role never follows itself
            open_row["last"] = initial
            run.add(row_items(initial, blank or later, cut))
            for _ in range(n - 1):
                run.add(row_items(initial, True, cut))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if open_row is not None:
        out.append(close(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _join_parts(group: pa.Table) -> pa.Table:
    """The repair of a conversation from the items of its stretches, in their order."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["digest"]))
    parts = []
    for r in rows:
        items: Items = {}
        for x in r["items"]:
            items.setdefault(x["before"], []).append((x["after"], x["cost"], x["audit"]))
        parts.append(items)
    illegal = sum(r["illegal"] for r in rows)
    illegal += sum((a["last"] + b["first"]) not in _LEGAL for a, b in zip(rows, rows[1:]))
    _, cost, audit = lightest(parts, START, GOALS)[0]
    out = group.select(["conv_id"]).slice(0, 1)
    for name, value, kind in (("illegal", illegal, pa.int64()), ("cost", cost, pa.int64()), ("audit", audit, pa.string())):
        out = out.append_column(name, pa.array([value], kind))
    return out


def repairs(conversations: DataFrame) -> DataFrame:
    """conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    ``conversations`` has conv_id, turn, role and text; other columns are not read,
    and NULL roles and texts count as one space. A conversation's rows go by turn,
    NULL first; rows of one turn by role, then by the sha256 of their text. Rows
    without conv_id are one conversation. A row is blank without a character besides
    white space, else a duplicate if an earlier row has its role and text, else
    truncated if its last such character is none of ``.!?``. Deleting costs 4 and
    must be for blank rows and duplicates, making a row user or assistant 3,
    inserting an empty one of these 3, and a truncated row that stays 3. ``audit``
    has the initials of the cheapest edits in order, of equally cheap ones the least
    in ASCII; after them the roles' initials are ``(s?(ua)+)?``. gaps are the turns
    missing between the first and the last one.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    found = _faults(rows)
    kind = dict(found.dtypes)
    schema = _PART.replace("CONV", kind["conv_id"]).replace("TURN", kind["turn"])
    arrow = _arrow_schema(spark, schema)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    dealt = found.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = staged(dealt.mapInArrow(lambda batches: _derive(batches, arrow), schema))
    whole = parts.where("whole").select("conv_id", "illegal", "cost", "audit")
    open_ = parts.where("not whole").select("conv_id", *_PLACE, "illegal", "first", "last", "items")
    joined = open_.groupBy("conv_id").applyInArrow(
        lambda group: _join_parts(group), f"conv_id {kind['conv_id']}, illegal long, cost long, audit string"
    )
    repaired = whole.union(joined)
    first = (~F.col("blank") & ~F.col("later")).cast("long")
    counts = found.groupBy("conv_id").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - first).otherwise(0)).alias("duplicate"),
        F.sum(F.when(F.col("cut"), first).otherwise(0)).alias("truncated"),
    )
    other = repaired.withColumnRenamed("conv_id", "r_conv")
    return counts.join(other, F.col("conv_id").eqNullSafe(F.col("r_conv"))).drop("r_conv")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def repaired_rows(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text, edit: the rows after the edits of ``repairs``.

    ``found`` is its result over the same rows. Inserted rows have a NULL turn and
    an empty text; ``edit`` is K, R or I. The rows of a conversation are in one
    partition, in order, which is what a digest over them needs; they pass through
    its task one batch at a time.
    """
    kind = dict(conversations.dtypes)
    rows = conversations.select(
        "conv_id", F.lit(1).alias("part"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumn("digest", _digest())
    audits = found.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast(kind["turn"]).alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(b"").alias("digest"),
    )
    order = [F.asc_nulls_first("conv_id"), "part", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = audits.union(rows).repartition("conv_id").sortWithinPartitions(*order).drop("digest")
    schema = f"conv_id {kind['conv_id']}, position long, turn {kind['turn']}, role string, text string, edit string"
    arrow = _arrow_schema(conversations.sparkSession, schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position = None, "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []

            def put(turn, role: str, text: str, what: str) -> None:
                nonlocal state, position
                state = NEXT[state][role[:1]]
                out.append((conv, position, turn, role, text, what))
                position += 1

            def insert() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put(None, ROLES[_expected(state)], "", "I")
                    at += 1

            for c, part, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "turn", "role", "text"))):
                if part == 0:
                    conv, audit, at, state, position = c, text, 0, START, 0
                    insert()
                    continue
                what = audit[at]
                at += 1
                if what == "K":
                    put(turn, role, text, "K")
                elif what == "R":
                    put(turn, ROLES[_expected(state)], text, "R")
                insert()
            columns = list(zip(*out)) if out else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return dealt.mapInArrow(edit, schema)


def _expected(state: int) -> str:
    """The initial of the row that an edit puts behind ``state``."""
    return "a" if state == AFTER_U else "u"


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines 'role:text' of ``repaired_rows``, without gathering them."""
    kind = dict(repaired.dtypes)["conv_id"]
    schema = f"conv_id {kind}, repaired_sha256 string"
    arrow = _arrow_schema(repaired.sparkSession, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, position, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if state is not None:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], arrow)

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(digest, schema)
