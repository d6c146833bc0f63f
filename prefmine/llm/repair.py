"""Repair of conversations by weighted CYK interval parsing.

Rows have faults (blank, duplicate, truncated), roles may stand in the wrong order, turns may be missing. The cheapest
edits that give a sequence of roles ``(s?(ua)+)?`` (an optional system turn, then user and assistant in turn) are found
by a repair grammar in Chomsky normal form:

* A nonterminal names the first and last role that is left of a span of rows: ``ua`` is the pattern ``u(au)*a``, ``su`` is
  ``s(ua)*u``, and ``""`` is a span of which nothing is left. ``RULES`` has ``x -> y z`` for all roles that may
  be neighbours. The start symbols are ``""``, ``ua`` and ``sa``.
* A cell holds the least (cost, audit) of every nonterminal over a span; an audit is the string of the edits' initials, Keep,
  Rerole, Delete and Insert. Strings of the same rows and cost are never prefixes of each other, so the least of the
  parts gives the least of the whole, ties by bytes included.
* Insertion closure: the cell of an empty span holds what insertions alone give; each row's cell is joined with it on both
  sides, so rows may be inserted anywhere.
* Spans grow bottom-up by length. Up to ``CHART`` rows all spans of all lengths are filled, with the least over all
  splits. As a nonterminal names all that neighbours need to know, every split of a span gives the same cell, so longer
  spans are joined from two halves: first within a leaf of at most ``LEAF`` rows, then from up to ``FAN`` cells a task.

Rows are put in order by one range sort over (conversation, turn, role, text), not per conversation, and a long conversation
is parsed leaf by leaf in many tasks on one character a row. Repeats are found by digest. Only the digest of a repaired
conversation, sequential by definition, streams through one task, a batch at a time.

Defined results: null roles and texts are one space; null turns come first; equal turns are in order of role and text; null
conversation ids form one conversation; rows that repeat are duplicates; roles that begin with neither s, u nor a can't be
kept. Texts are whole, of any length. Extra columns are ignored. No rows give no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import null_safe_join
from prefmine.llm.tables import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEIGHBOURS = ("su", "ua", "au")
NONTERMINALS = ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
START = ("", "ua", "sa")
CHART, LEAF_BITS, FAN = 8, 12, 64
LEAF = 1 << LEAF_BITS
SPACES = " \t\n\x0b\f\r"
NAMES = {"u": "user", "a": "assistant"}

#: (x, y, z): x -> y z
RULES = [(z, "", z) for z in NONTERMINALS] + [(y, y, "") for y in NONTERMINALS if y]
RULES += [(y[0] + z[1], y, z) for y in NONTERMINALS for z in NONTERMINALS if y and z and y[1] + z[0] in NEIGHBOURS]

Cell = dict[str, tuple[int, str]]

# --------------------------------------------------------------------------- the grammar


def joined(left: Cell, right: Cell) -> Cell:
    """Cell of two neighbouring spans."""
    out: Cell = {}
    for x, y, z in RULES:
        if y in left and z in right:
            (a, one), (b, two) = left[y], right[z]
            known = out.get(x)
            if known is None or a + b <= known[0]:
                new = (a + b, one + two)
                if known is None or new < known:
                    out[x] = new
    return out


def _least(cells: list[Cell]) -> Cell:
    out: Cell = {}
    for cell in cells:
        for x, value in cell.items():
            if x not in out or value < out[x]:
                out[x] = value
    return out


def _inserted() -> Cell:
    """Cell of an empty span: insertions until nothing becomes cheaper."""
    one: Cell = {"": (0, ""), "uu": (INSERT, "I"), "aa": (INSERT, "I")}
    cell = one
    while (more := _least([cell, joined(cell, one)])) != cell:
        cell = more
    return cell


EMPTY = _inserted()


def code(initial: Column, fault: Column) -> Column:
    """One character a row: the role's initial (others: o), in capitals if truncated; to delete: x, y, z and w for s, u, a and others."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault == 2, F.translate(known, "suao", "xyzw")).when(fault == 1, F.upper(known)).otherwise(known)


def _initial(symbol: str) -> str:
    return symbol.lower().translate(str.maketrans("xyzw", "suao"))


@lru_cache(maxsize=64)
def row_cell(symbol: str) -> Cell:
    """Cell of one row with the insertions around it."""
    cell: Cell = {"": (DELETE, "D")}
    if symbol not in "xyzw":
        more = TRUNCATED if symbol.isupper() else 0
        role = symbol.lower()
        cell |= {2 * r: (REROLE + more, "R") for r in "ua"}
        if role != "o":
            cell[2 * role] = (KEEP + more, "K")
    return joined(joined(EMPTY, cell), EMPTY)


@lru_cache(maxsize=1 << 16)
def chart(codes: str) -> Cell:
    """Cell of at most ``CHART`` rows: all spans by length, all splits."""
    n = len(codes)
    cells = {(i, i + 1): row_cell(c) for i, c in enumerate(codes)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells[i, i + length] = _least([joined(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)])
    return cells[0, n]


def combined(cells: list[Cell]) -> Cell:
    """Cell of neighbouring spans, halves of equal numbers of them first."""
    while len(cells) > 1:
        cells = [joined(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parsed(codes: str) -> Cell:
    return combined([chart(codes[i : i + CHART]) for i in range(0, len(codes), CHART)])


def illegal_pairs(codes: str) -> int:
    initials = _initial(codes)
    return sum(initials[i : i + 2] not in NEIGHBOURS for i in range(len(initials) - 1))


# --------------------------------------------------------------------------- cells in tables

_CELL = [T.StructField(n, t) for n, t in (
    ("first", T.StringType()), ("last", T.StringType()), ("illegal", T.LongType()), ("costs", T.ArrayType(T.LongType())), ("audits", T.ArrayType(T.StringType())),
)]


def _row(cell: Cell, first: str, last: str, illegal: int) -> dict:
    costs, audits = zip(*(cell.get(x, (None, None)) for x in NONTERMINALS))
    return {"first": first, "last": last, "illegal": illegal, "costs": costs, "audits": audits}


def _with_cells(df: DataFrame, column: str, make) -> DataFrame:
    """Puts the fields of a cell, made from a value of ``column``, in its place."""
    kept = [f for f in df.schema.fields if f.name != column]
    kinds = pa.struct([("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):  # few at a time: audits grow with the span
                batch = whole.slice(at, 256)
                cells = pa.array([make(v) for v in batch.column(column).to_pylist()], kinds)
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + cells.flatten(), [f.name for f in kept] + [f.name for f in _CELL])

    return df.mapInArrow(run, T.StructType(kept + _CELL))


def _leaf(codes: str) -> dict:
    return _row(parsed(codes), _initial(codes[0]), _initial(codes[-1]), illegal_pairs(codes))


def _span(parts: list[dict]) -> dict:
    cells = [{x: (c, a) for x, c, a in zip(NONTERMINALS, p["costs"], p["audits"]) if c is not None} for p in parts]
    between = sum(a["last"] + b["first"] not in NEIGHBOURS for a, b in zip(parts, parts[1:]))
    return _row(combined(cells), parts[0]["first"], parts[-1]["last"], between + sum(p["illegal"] for p in parts))


def cheapest(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, illegal) of rows (conv_id, at, code); ``at`` is the order."""
    leaf = F.shiftright("at", LEAF_BITS).alias("place")
    leaves = rows.groupBy("conv_id", leaf).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "").alias("codes"))
    cells = written(_with_cells(leaves, "codes", _leaf), "cells")
    done = []
    while True:
        sizes = cells.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        sized = null_safe_join(cells, sizes, ["conv_id"], "inner")
        done.append(sized.filter("n = 1").select("conv_id", *[f.name for f in _CELL]))
        left = sized.filter("n > 1").drop("n")
        if not left.limit(1).count():
            break
        rank = (F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1) / FAN)).alias("next")
        ranks = left.select("conv_id", "place", rank)
        parts = F.array_sort(F.collect_list(F.struct("place", *[f.name for f in _CELL]))).alias("parts")
        above = null_safe_join(left, ranks, ["conv_id", "place"], "inner").groupBy("conv_id", F.col("next").alias("place")).agg(parts)
        cells = written(_with_cells(above, "parts", _span), "cells")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    at = lambda x: F.struct(F.get("costs", F.lit(NONTERMINALS.index(x))).alias("cost"), F.get("audits", F.lit(NONTERMINALS.index(x))).alias("audit"))
    best = F.array_min(F.filter(F.array(*[at(x) for x in START]), lambda c: c["cost"].isNotNull()))
    return whole.select("conv_id", "illegal", best.alias("best")).select("conv_id", "best.cost", "best.audit", "illegal")


# --------------------------------------------------------------------------- conversations


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with the stated share of each damage, drawn by crc32 of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")), F.lit(20)).alias("draw")
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), draw).filter("draw <> 0")
    changed = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": changed, "role": F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))})
    again = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", again.alias("again")).drop("again")


def in_order(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored rows with ``at``, which grows with (conversation, turn, role, text)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.select("conv_id", "turn", space("role"), space("text")).orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, code, fault): fault is blank, duplicate, truncated or null, the first that holds."""
    said = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select("conv_id", "turn", "at", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("open"))
    repeated = narrow.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    narrow = null_safe_join(narrow, repeated, ["conv_id", "role", "digest"])
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("earliest"), "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    narrow = narrow.withColumn("fault", fault)
    return narrow.select("conv_id", "turn", "at", code(F.substring("role", 1, 1), kind).alias("code"), "fault")


def fault_counts(flagged: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated); turns are counted first, so that a long conversation is many groups."""
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    turns = flagged.groupBy("conv_id", "turn").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    return turns.groupBy("conv_id").agg(gaps, *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])


def repaired_rows(audit: str) -> Iterator[tuple[str, str | None]]:
    """Edits in order as (initial, role to be written); None is the row's own role. To be told the row's role after each K."""
    last = ""
    for edit in audit:
        if edit in "RI":
            last = "a" if last == "u" else "u"
            yield edit, NAMES[last]
        else:
            own = yield edit, None
            last = own or last


class _Digest:
    """Digest of one repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.sha, self.empty, self.edits = hashlib.sha256(), True, repaired_rows(audit)
        self.next = next(self.edits, None)

    def _write(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self) -> None:
        while self.next and self.next[0] == "I":
            self._write(self.next[1], "")
            self.next = next(self.edits, None)

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, written_as = self.next
        if edit != "D":
            self._write(written_as or role, text)
        try:
            self.next = self.edits.send(role[:1] if edit == "K" else None)
        except StopIteration:
            self.next = None

    def hexdigest(self) -> str:
        self._insert()
        return self.sha.hexdigest()


def with_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Appends repaired_sha256 to ``audits``: its row comes first, then the conversation's rows, in one sorted stream."""
    told = [c for c in audits.columns if c != "conv_id"]
    heads = audits.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*told).alias("told"))
    both = heads.unionByName(rows.select("conv_id", "at", "role", "text"), allowMissingColumns=True)
    streams = both.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    schema = T.StructType([*audits.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    fields = audits.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head, done, kinds = None, None, [], None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([d[0][n] for d in done], kinds[n]) for n in fields] + [pa.array([d[1] for d in done], pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*fields, "repaired_sha256"])

        for part in batches:
            if kinds is None:
                told_type = part.schema.field("told").type
                kinds = {"conv_id": part.schema.field("conv_id").type} | {n: told_type.field(n).type for n in told}
            for at in range(0, len(part), 1024):
                some = part.slice(at, 1024)
                for conv, place, role, text, told_here in zip(*(some.column(n).to_pylist() for n in ("conv_id", "at", "role", "text", "told"))):
                    if place == -1:
                        if current:
                            done.append((head, current.hexdigest()))
                        head, current = {"conv_id": conv, **told_here}, _Digest(told_here["audit"])
                    else:
                        current.row(role, text)
            if len(done) > 1000:
                yield batch()
                done = []
        if current:
            done.append((head, current.hexdigest()))
        if done:
            yield batch()

    return streams.mapInArrow(run, schema)


def repair_report(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = in_order(df, conv_id, turn, role, text)
    flagged = written(with_faults(rows), "faults")
    parsed_ = with_digests(rows, written(cheapest(flagged.select("conv_id", "at", "code")), "audits"))
    return null_safe_join(fault_counts(flagged), parsed_, ["conv_id"], "inner").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def damage_report(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`repair_report` of the damaged rows, one row for every original conversation."""
    known = df.select(F.col(conv_id).alias("conv_id")).distinct()
    found = null_safe_join(known, repair_report(damaged(df, conv_id, turn, role, text)), ["conv_id"])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )
