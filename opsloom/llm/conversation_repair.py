"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Turns are kept, given another role, deleted or inserted. The plan of a
conversation comes from a dynamic program over the turns that stay: for each
role that the last turn that stayed can have, the running minimum of (cost
minus the price of deleting everything up to there) is held, so a later turn
prices the gap to its predecessor from one prefix sum of deletions, and the pair
of roles says which turns have to be inserted between. Of equally cheap plans
the one with the ASCII-least audit wins; since all audits up to a turn spell
that many turns, none is a proper prefix of another, and it is enough to hold
the rank of each of the four minima.

Two passes, both sorted by conversation and turn, stream through tasks:
- ``plan`` reads what decides (role initial, fault), some 20 bytes a turn, and
  gives a row a conversation: counts, cost and the audit, a letter an edit;
- ``apply`` merges the plans with the texts and gives the repaired turns, or
  what a ``Sink`` makes of them; texts are shuffled once and never held.
A conversation runs through one task, since its result is one sequence; that
task holds some 20 bytes for each of its turns, and no text but the one at hand.

Defined results: null roles and texts are one space, null turns come first;
turns with equal numbers are ordered by role and a digest of the text; rows
that repeat are duplicates; a null conversation id is a conversation of its
own; an empty table gives an empty result; a text of any length passes whole;
ties between plans are decided by the audit; only the named columns are read,
so others may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from opsloom.llm.workspace import Workspace

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT, GONE = range(5)
START, S, U, A = range(4)
NAMES = {U: "user", A: "assistant"}
#: Inserted turns between a turn that stays and the next one; the last column is the end of the conversation.
INSERTS = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
AT_END = {START: 0, S: 2, U: 1, A: 0}
ROLE_OF = {"s": S, "u": U, "a": A}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Plan:
    """The dynamic program over the turns of one conversation, one at a time."""

    def __init__(self) -> None:
        self.n = self.deleted = self.illegal = 0
        self.faults = [0] * 5
        self.last: str | None = None
        self.low = self.high = self.before = None
        self.distinct = 0
        # For each role of the last turn that stays: cost minus deletions so far, rank of its audit, node.
        self.best: dict[int, tuple[int, int, int]] = {START: (0, 0, -1)}
        self.parent, self.turn, self.kind = array("q"), array("q"), bytearray()

    def add(self, number: int | None, initial: str, fault: int) -> None:
        """The next turn. ``number`` is its turn number, ``fault`` one of OK, BLANK, DUPLICATE, CUT; GONE stands for no turn."""
        if fault == GONE:
            return
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if number is not None:
            self.low = number if self.low is None else self.low
            self.high = number
            self.distinct += number != self.before
            self.before = number
        # Every minimum stays as it is when the turn is deleted: only the prefix sum grows.
        stay = {r: (c, (k, "D"), None) for r, (c, k, _) in self.best.items()}
        if fault in (OK, CUT):
            price = TRUNCATED * (fault == CUT) - DELETE
            for r, (c, k, node) in self.best.items():
                for role, own, letter in self._ways(initial):
                    m = INSERTS.get((r, role))
                    if m is not None:
                        found = (c + m * INSERT + own + price, (k, "I" * m + letter), (node, m, letter))
                        if role not in stay or found[:2] < stay[role][:2]:
                            stay[role] = found
        rank = {key: i for i, key in enumerate(sorted({key for _, key, _ in stay.values()}))}
        held = {}
        for r, (c, key, made) in stay.items():
            node = self.best[r][2] if made is None else self._node(*made)
            held[r] = (c, rank[key], node)
        self.best = held
        self.deleted += DELETE
        self.n += 1

    @staticmethod
    def _ways(initial: str) -> Iterator[tuple[int, int, str]]:
        kept = ROLE_OF.get(initial)
        if kept is not None:
            yield kept, 0, "K"
        for role in (U, A):
            if role != kept:
                yield role, REROLE, "R"

    def _node(self, parent: int, inserts: int, letter: str) -> int:
        self.parent.append(parent)
        self.turn.append(self.n)
        self.kind.append(inserts * 2 + (letter == "R"))
        return len(self.kind) - 1

    def audit(self, node: int) -> str:
        """The edits up to the last turn: deletions come before insertions, as D < I."""
        out, after = [], self.n
        while node >= 0:
            i, kind = self.turn[node], self.kind[node]
            out.append("D" * (after - i - 1))
            out.append("KR"[kind & 1])
            out.append("I" * (kind >> 1))
            after, node = i, self.parent[node]
        out.append("D" * after)
        return "".join(reversed(out))

    def result(self) -> tuple[list[int], str]:
        """COUNTS and the audit."""
        ends = [(c + AT_END[r] * INSERT, self.audit(node) + "I" * AT_END[r]) for r, (c, _, node) in self.best.items()]
        least = min(c for c, _ in ends)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, *self.faults[1:4], self.illegal, least + self.deleted], min(a for c, a in ends if c == least)


class Walk:
    """Applies an audit to the turns of a conversation, one at a time; gives (edit, role, text) of what stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _next(self) -> int:
        return A if self.state == U else U

    def _inserted(self) -> Iterator[tuple[str, str, bytes]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, self._next()
            yield "I", NAMES[self.state], b""

    def turn(self, role: str, text: bytes) -> Iterator[tuple[str, str, bytes]]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        self.state = ROLE_OF[role[0]] if letter == "K" else self._next()
        yield letter, role if letter == "K" else NAMES[self.state], text

    def end(self) -> Iterator[tuple[str, str, bytes]]:
        yield from self._inserted()


def judged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """conv, turn, role, digest, text, gone of every row; ``gone`` marks rows that only name their conversation."""
    blank = F.lit(" ")
    out = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), (F.lit(False) if gone is None else gone).alias("gone"),
    )
    return out.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


#: Nulls come first in ascending order.
ORDER = ["turn", "role", "digest"]


def plan(rows: DataFrame) -> DataFrame:
    """A row a conversation of ``judged`` rows: conv, COUNTS, audit."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select(
        "conv", "turn", "role", "digest", "gone", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "gone", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("gone"), GONE).when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(F.col("cut"), CUT).otherwise(OK)
    light = light.withColumn("seen", seen).withColumn("fault", fault.cast("tinyint")).sortWithinPartitions("conv", *ORDER, "seen")
    light = light.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    schema = StructType([light.schema["conv"]])
    for c in COUNTS:
        schema = schema.add(c, "long")
    return light.mapInArrow(_plans(light.schema["conv"].name), schema.add("audit", "string"))


def _plans(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, kind = None, None, None
        done: list[tuple] = []
        for b in batches:
            kind = b.schema.field(key).type
            for conv, number, initial, fault in zip(*(b.column(c).to_pylist() for c in (key, "turn", "initial", "fault")), strict=True):
                if held is None or conv != at:
                    if held is not None:
                        done.append((at, *held.result()))
                    held, at = Plan(), conv
                held.add(number, initial, fault)
            if len(done) >= 512:
                yield _plan_rows(done, kind, key)
                done = []
        if held is not None:
            done.append((at, *held.result()))
        if done:
            yield _plan_rows(done, kind, key)

    return run


def _plan_rows(done: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    counts = [pa.array([d[1][i] for d in done], pa.int64()) for i in range(len(COUNTS))]
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *counts, pa.array([d[2] for d in done], pa.string())], names=[key, *COUNTS, "audit"])


class Sink:
    """What becomes of the repaired turns of a conversation; one instance a conversation."""

    schema: str

    def __init__(self, head: dict) -> None:
        self.head = head

    def take(self, edit: str, role: str, text: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


class Turns(Sink):
    """The repaired turns themselves."""

    schema = "position long, edit string, role string, text string"

    def __init__(self, head: dict) -> None:
        super().__init__(head)
        self.n = 0

    def take(self, edit: str, role: str, text: bytes) -> Iterator[tuple]:
        yield self.n, edit, role, text.decode("utf-8", "replace")
        self.n += 1


class Digest(Sink):
    """The plan with the SHA-256 of the repaired turns as lines ``role:text``."""

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def __init__(self, head: dict) -> None:
        super().__init__(head)
        self.hash, self.first = hashlib.sha256(), True

    def take(self, edit: str, role: str, text: bytes) -> Iterator[tuple]:
        self.hash.update(b"" if self.first else b"\n")
        self.hash.update(role.encode() + b":")
        self.hash.update(text)
        self.first = False
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield *(self.head[c] for c in COUNTS), self.head["audit"], self.hash.hexdigest()


def apply(rows: DataFrame, plans: DataFrame, sink: type[Sink] = Turns) -> DataFrame:
    """conv and the columns of ``sink`` for ``judged`` rows and their plans."""
    heads = plans.select("conv", F.struct(*COUNTS, "audit").alias("head"))
    texts = rows.filter("not gone").select("conv", "turn", "role", "digest", F.col("text").cast("binary").alias("text"))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions("conv", F.col("head").isNull(), *ORDER).select("conv", "head", "role", "text")
    extra = StructType.fromDDL(sink.schema)
    schema = StructType([rows.schema["conv"], *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, to, at, kind = None, None, None, None
        out: list[tuple] = []

        def ended() -> Iterator[tuple]:
            for edit in walk.end():
                yield from to.take(*edit)
            yield from to.end()

        for b in batches:
            kind = b.schema.field("conv").type
            columns = [b.column(c) for c in ("conv", "head", "role", "text")]
            for conv, head, role, text in zip(*columns, strict=True):
                if head.is_valid:
                    if walk is not None:
                        out += ((at, *r) for r in ended())
                    plan_ = head.as_py()
                    walk, to, at = Walk(plan_["audit"]), sink(plan_), conv.as_py()
                else:
                    for edit in walk.turn(role.as_py(), text.as_py()):
                        out += ((at, *r) for r in to.take(*edit))
                if len(out) >= 256:
                    yield _rows(out, kind, extra)
                    out = []
        if walk is not None:
            out += ((at, *r) for r in ended())
        if out:
            yield _rows(out, kind, extra)

    return both.mapInArrow(run, schema)


def _rows(out: list[tuple], kind: pa.DataType, extra: StructType) -> pa.RecordBatch:
    types = [kind, *(pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in extra.fields)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", *extra.names])


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows with the faults that the query plants, as ``judged`` rows."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "how", copies.alias("copy"))
    return judged(rows, gone=F.col("how") == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    space = Workspace(spark, "op12")
    return apply(rows, space.save(plan(rows), "plans"), Digest).withColumnRenamed("conv", "conv_id")


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE = {
    "op12_conversation_repair": r"""WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(256))
), hashed AS (
  SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) % 20 AS how
  FROM conversations c, bits
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM hashed, (VALUES (0), (1)) v(k) WHERE how <> 0 AND (k = 0 OR how = 3)
), numbered AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM rows_
), judged AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM numbered
), steps(a, b, ins) AS (
  VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u'), ('', '', ''), ('s', '', 'ua'), ('u', '', 'a')
), walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM judged
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
    SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
      SELECT w.conv_id, j.i, w.state, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.said FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, j.i, s.b, w.cost + 3 * length(s.ins) + CASE WHEN s.b = j.ini THEN 0 ELSE 3 END + CASE WHEN j.fault = 3 THEN 3 ELSE 0 END,
        w.audit || repeat('I', length(s.ins)) || CASE WHEN s.b = j.ini THEN 'K' ELSE 'R' END,
        list_concat(w.said, CASE s.ins WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE [] END,
          [CASE WHEN s.b = j.ini THEN j.role WHEN s.b = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text])
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN steps s ON s.a = w.state
      WHERE s.b <> '' AND j.fault IN (0, 3) AND (s.b <> 's' OR j.ini = 's')
    ) GROUP BY conv_id, i, state)
), ends AS (
  SELECT w.conv_id, min({'cost': w.cost + 3 * length(coalesce(s.ins, '')), 'audit': w.audit || repeat('I', length(coalesce(s.ins, ''))),
    'said': list_concat(w.said, CASE s.ins WHEN 'a' THEN ['assistant:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE [] END)}) AS best
  FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM judged) c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  LEFT JOIN steps s ON s.a = w.state AND s.b = '' GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
}
