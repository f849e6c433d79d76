"""Repair of the turn structure of conversations by cheapest edits.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`.  Rows are kept (0), given the role user or
assistant (2) or deleted (3, required for blank and duplicate rows); empty user and assistant rows may be inserted
anywhere (2 each); a truncated row that stays adds 1.  Of the cheapest edits those whose letters D, I, K, R are least in
ASCII order are taken.

The grammar has four states: nothing yet, after a system row, after user, after assistant.  A segment of at most SEGMENT
rows of a conversation is one group; the groups are hash-partitioned, and each task takes them up in batches of about
BATCH rows, for which one recursive DuckDB query runs: each recursion advances one turn in all groups of the batch and
keeps, for every pair of first and present state, the least (cost, letters).  What a segment gives is again a step from
state to state, so that the segments of a long conversation are the turns of the next level's groups, by the same query;
a conversation of n rows takes log(n) / log(SEGMENT) levels, and no task needs to hold a conversation.  Comparing letters
state by state is right: two strings at one place of one conversation end in a row's letter and hold equally many of
those, so that neither can be the beginning of the other.

Letters are kept with the role they lead to (J: an assistant inserted, S: made assistant), in the same order.  The edited
text is hashed row after row from sorted partitions, in constant memory.

Cases.  Null roles and texts are one space, and so is a null conv_id or turn where it is part of a key that is hashed; a
null conv_id is a conversation of its own, and null turns come first.  Rows of one turn go by role and text, so that
repeated rows stand together.  A role with another initial than s, u, a (also an empty one) fits nowhere and is changed or
deleted.  Conversations that lose all rows have zeros and empty edits.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

SEGMENT = 128
BATCH = 16_384
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, RETURN, DEFECT = 3, 2, 2, 1
START, ACCEPT = 0, (0, 3)
#: state and initial: the next state.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STEPS = "array<struct<origin:int,state:int,cost:bigint,audit:string>>"


def insertions(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) after at most two inserted rows; more would come back to a state that costs less."""
    found, last = [(state, 0, "")], [(state, 0, "")]
    for _ in range(2):
        last = [(GRAMMAR[q, r], c + INSERT, a + letter) for q, c, a in last for r, letter in (("u", "I"), ("a", "J")) if (q, r) in GRAMMAR]
        found += last
    return found


def moves() -> pa.Table:
    """kind, origin, state, cost, audit: the cheapest way over one row.  kind: the role's initial (x: any other) and d
    (must be deleted), t (truncated) or c (clean)."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for initial, fault, origin in product("suax", "dtc", range(4)):
        for q, cost, audit in insertions(origin):
            ways = [(q, DELETE, "D")]
            if fault != "d":
                stays = DEFECT if fault == "t" else 0
                ways += [(GRAMMAR[q, r], stays + c, letter) for r, c, letter in ((initial, 0, "K"), ("u", RETURN, "R"), ("a", RETURN, "S")) if (q, r) in GRAMMAR]
            for state, c, letter in ways:
                key, value = (initial + fault, origin, state), (cost + c, audit + letter)
                best[key] = min(best.get(key, value), value)
    rows = [{"kind": k, "origin": o, "state": s, "cost": c, "audit": a} for (k, o, s), (c, a) in best.items()]
    return pa.Table.from_pylist(rows, pa.schema([("kind", pa.string()), ("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


#: A turn at a time for all groups; groups from the second on may begin in any state.
WALK = """
WITH RECURSIVE heads AS (SELECT grp, any_value(conv_id) AS conv_id, any_value(seg) AS seg, max(k) AS last FROM turns GROUP BY grp),
step AS ({steps}),
walk AS (
  SELECT grp, -1 AS k, q AS origin, q AS state, 0::BIGINT AS cost, '' AS audit
  FROM heads JOIN (VALUES (0::INT), (1), (2), (3)) AS start(q) ON seg > 0 OR q = 0
  UNION ALL
  SELECT grp, k, origin, state, best.cost, best.audit FROM (
    SELECT w.grp, w.k + 1 AS k, w.origin, s.state, min({{'cost': w.cost + s.cost, 'audit': w.audit || s.audit}}) AS best
    FROM walk w JOIN step s ON s.grp = w.grp AND s.k = w.k + 1 AND s.origin = w.state
    GROUP BY ALL)
)
SELECT any_value(h.conv_id) AS conv_id, any_value(h.seg) AS seg,
       list({{'origin': origin, 'state': state, 'cost': cost, 'audit': audit}}) AS steps
FROM walk JOIN heads h ON h.grp = walk.grp AND h.last = walk.k GROUP BY h.grp"""
FROM_KINDS = "SELECT t.grp, t.k, m.* EXCLUDE kind FROM turns t JOIN moves m ON m.kind = t.kind"
FROM_STEPS = "SELECT grp, k, unnest(steps, recursive := true) FROM turns"


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows in tables of about `rows`, each of whole groups; a group begins where k is 0."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        found = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(found.column("k").to_numpy() == 0)[-1])
        if cut:
            yield found.slice(0, cut)
            held = found.slice(cut).to_batches()
            n = found.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _walker(steps: str, names: list[str], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""}) as db:
            db.register("moves", moves())
            for found in whole_groups(batches, rows):
                k = found.column("k").to_numpy()
                db.register("turns", found.append_column("grp", pa.array(np.cumsum(k == 0))))
                out = db.sql(WALK.format(steps=steps)).to_arrow_table().select(names)
                kinds = pa.schema([pa.field("conv_id", found.schema.field("conv_id").type), ("seg", pa.int64()), ("steps", pa.list_(pa.struct([("origin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
                yield from out.cast(kinds).to_batches()

    return run


def _walked(turns: DataFrame, steps: str) -> DataFrame:
    """conv_id, seg, steps of turns(conv_id, seg, k, kind or steps)."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("seg", T.LongType()), T.StructField("steps", T._parse_datatype_string(STEPS))])
    dealt = turns.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "k")
    return dealt.mapInArrow(_walker(steps, ["conv_id", "seg", "steps"], BATCH), schema)


def cheapest(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, cost, letters (with roles, see above) of turns(conv_id, pos from 1 on, kind)."""
    at = F.col("pos") - 1
    steps = _walked(turns.select("conv_id", F.floor(at / segment).alias("seg"), (at % segment).alias("k"), "kind"), FROM_KINDS)
    longest = turns.agg(F.max("pos")).first()[0] or 0
    segments = -(-longest // segment)
    while segments > 1:
        place = F.col("seg")
        steps = _walked(stored(steps, "segments").select("conv_id", F.floor(place / segment).alias("seg"), (place % segment).alias("k"), "steps"), FROM_STEPS)
        segments = -(-segments // segment)
    ends = F.array(*[F.struct(F.lit(q).alias("state"), F.lit(c).alias("cost"), F.lit(a).alias("audit")) for q in range(4) for end, c, a in insertions(q) if end in ACCEPT])
    whole = F.filter("steps", lambda s: s["origin"] == START)
    ended = F.flatten(F.transform(whole, lambda s: F.transform(F.filter(ends, lambda e: e["state"] == s["state"]), lambda e: F.struct((s["cost"] + e["cost"]).alias("cost"), F.concat(s["audit"], e["audit"]).alias("letters")))))
    return steps.select("conv_id", F.array_min(ended).alias("best")).select("conv_id", "best.cost", "best.letters")


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows, with pos (from 1 on in the conversation), fault (blank, duplicate, truncated or
    null), kind, and illegal and new_turn (0 or 1)."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.withColumn("pos", F.row_number().over(in_order).cast("long"))
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    initial, trimmed = F.substring("role", 1, 1), F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(F.length(trimmed) == 0, "blank")
        .when(seen, "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    before, last_turn = F.lag(initial).over(by_pos), F.lag("turn").over(by_pos)
    placed = placed.select(
        "*", fault.alias("fault"), initial.alias("initial"),
        (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).cast("long").alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(last_turn == F.col("turn"), F.lit(False))).cast("long").alias("new_turn"),
    )
    kind = F.concat(
        F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x"),
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("c"),
    )
    return placed.withColumn("kind", kind)


def repaired(rows: DataFrame, letters: DataFrame) -> DataFrame:
    """conv_id, pos, lines: what becomes of each row, as `role:text` lines (null: nothing).  rows: of audited();
    letters: of cheapest()."""
    codes = letters.select(F.col("conv_id").alias("_conv"), F.posexplode(F.regexp_extract_all("letters", F.lit("([IJ]*[DKRS](?:[IJ]+$)?)"), F.lit(1))).alias("_at", "_code"))
    joined = rows.join(codes, rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["pos"] == F.col("_at") + 1))
    texts = {"I": F.lit("user:"), "J": F.lit("assistant:"), "K": F.concat("role", F.lit(":"), "text"), "R": F.concat(F.lit("user:"), "text"), "S": F.concat(F.lit("assistant:"), "text")}

    def line(letter: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, text in texts.items():
            out = F.when(letter == name, text).otherwise(out)
        return out

    lines = F.filter(F.transform(F.split("_code", ""), line), lambda x: x.isNotNull())
    return joined.select("conv_id", "pos", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a conversation, of rows in order."""
    digest, names, found, any_line, present, kind = None, [], [], False, None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if digest is None or conv != present:
                if digest is not None:
                    names.append(present)
                    found.append(digest.hexdigest())
                digest, present, any_line = hashlib.sha256(), conv, False
            if line is not None:
                digest.update(("\n" + line if any_line else line).encode())
                any_line = True
        if len(names) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(found)], ["conv_id", "repaired_sha256"])
            names, found = [], []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*names, present], kind), pa.array([*found, digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def hashed(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines of each conversation, joined by newlines."""
    schema = T.StructType([lines.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_hashes, schema)


def repair(rows: DataFrame) -> DataFrame:
    """For each conv_id of rows(conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  Rows with a null `turn` are rows as well."""
    rows = stored(audited(rows), "turns")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    stats = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.sum("illegal").alias("illegal"),
    )
    letters = stored(cheapest(rows.select("conv_id", "pos", "kind")), "letters")
    found = letters.select(F.col("conv_id").alias("_conv"), "cost", F.translate("letters", "JS", "IR").alias("audit"))
    hashes = hashed(repaired(rows, letters)).withColumnRenamed("conv_id", "_hashed")
    out = stats.join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")))
    return out.select(*stats.columns, "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows that are dropped, emptied, cut, repeated or given another role by their key."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("how", F.crc32(key) % 20).where("how != 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = repair(damaged(given)).withColumnRenamed("conv_id", "_found")
    every = given.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in found.columns if c != "_found"])


SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 20 AS how
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed JOIN (VALUES (1), (2)) AS copies(n) ON how != 0 AND (n = 1 OR how = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed, role[1] AS initial
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN trimmed[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS two
  FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last
  FROM judged GROUP BY conv_id),
emits(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserts(q, q2, cost, audit, lines) AS (
  SELECT q, q, 0, '', []::VARCHAR[] FROM range(4) AS r(q)
  UNION ALL SELECT q, q2, 2, 'I', [CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM emits WHERE initial != 's'
  UNION ALL SELECT a.q, b.q2, 4, 'II', [CASE a.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE b.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
    FROM emits a JOIN emits b ON b.q = a.q2 WHERE a.initial != 's' AND b.initial != 's'),
ways AS (
  SELECT conv_id, pos, q, q AS q2, 3 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM judged, range(4) AS r(q)
  UNION ALL SELECT conv_id, pos, q, q2, (fault = 'truncated')::INT, 'K', [role || ':' || text]
    FROM judged JOIN emits USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, pos, q, q2, 2 + (fault = 'truncated')::INT, 'R', [CASE e.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM judged JOIN emits e ON e.initial != 's' WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM stats
  UNION ALL
  SELECT conv_id, pos, q, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, w.pos + 1 AS pos, o.q2 AS q,
           min({'cost': w.cost + i.cost + o.cost, 'audit': w.audit || i.audit || o.audit, 'lines': w.lines || i.lines || o.lines}) AS best
    FROM walk w JOIN inserts i ON i.q = w.q
    JOIN ways o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.pos = w.pos + 1 AND o.q = i.q2
    GROUP BY ALL)),
ended AS (
  SELECT w.conv_id, min({'cost': w.cost + i.cost, 'audit': w.audit || i.audit, 'lines': w.lines || i.lines}) AS best
  FROM walk w JOIN inserts i ON i.q = w.q AND i.q2 IN (0, 3)
  JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.last = w.pos
  GROUP BY w.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
