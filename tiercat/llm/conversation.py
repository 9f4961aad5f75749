"""Repair of conversation structure by a rank-convergence parallel Viterbi.

The turns of a conversation, in order, are edited at least cost until their roles read system (or
none), then user and assistant in turn: Keep costs 0, a new Role 1, Delete 2, Insert an empty user or
assistant turn 5; a turn with no end mark that is not deleted adds 5. Blank turns and turns whose role and
text stand earlier in the conversation must go. A turn's role is read by its first letter.

Four states tell what the roles read so far allow; the least cost from each state to the end is a
vector of four numbers, and a turn turns the vector behind it into the one before it (backwards).

1. Turns get their places by ranges (``common.ranked``), and ``chunk`` turns with consecutive places are a
   chunk, so a conversation of any length is split over tasks.
2. Every chunk starts from a speculative vector behind it, the one of the conversation's end, which is
   right for the last chunk.
3. Fix-up passes: a chunk whose vector differs from the one that its successor has found, by more than
   a constant, runs again with that one, until none differs. Chunks that still differ after
   ``passes`` passes are told by products of their min-plus matrices, doubling the reach each round,
   so the number of rounds is a logarithm even where no turn lets the costs converge.
4. With the stitched costs behind each turn, every chunk traces, from each of the four states, the edits
   with the least letters (D < I < K < R) among the cheapest. Which state a chunk starts from is
   told by composing the chunks' state maps, again by doubling.

Because letters of one state differ in what they lead to, least letters turn by turn are the least
audit. An audit's edits decide the repaired roles, so the repaired turns are unique.

Defined cases: turns are ordered by turn (null first), role (null first), then the digest of conversation,
role and text; a null key is one conversation; a null or empty role fits nowhere and is rewritten or
deleted; a null text is blank; a row that repeats another is a duplicate of it; an empty table gives
an empty result. The audit and the hash of the repaired conversation are one value each, so one task
streams a whole repaired conversation through the hash, a turn at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tiercat.llm.common import body, col, ranked, stored

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
# States: nothing yet, after system, after user, after assistant. The next user or assistant
# turn leads from each state to
TO = (2, 2, 3, 2)
END = (0, 10, 5, 0)  # the costs behind the last turn
FAR = 1 << 40  # more than any cost that is compared
SPACE = "\t\n\x0b\x0c\r "
VECTOR = "array<long>"


def _closed(x):
    """Costs with inserted turns before the next one; two suffice, a third would come back."""
    for _ in range(2):
        x = [min(x[q], INSERT + x[TO[q]]) for q in range(4)]
    return tuple(x)


@lru_cache(maxsize=1 << 16)
def _back(code: int, after: tuple) -> tuple:
    """Costs before a turn. code: 0 system, 1 user, 2 assistant, 3 another role, 4 if it is cut off, 8 if it must go."""
    initial, cut = code & 3, CUT if code & 4 else 0
    x = [DELETE + c for c in after]
    if not code & 8:
        for q in range(4):
            fits = initial == TO[q] - 1
            x[q] = min(x[q], cut + (0 if fits else REROLE) + after[TO[q]])
        if initial == 0:
            x[0] = min(x[0], cut + after[1])
    return _closed(x)


def _normal(v: tuple) -> tuple:
    low = min(v)
    return tuple(min(c - low, FAR) for c in v)


@lru_cache(maxsize=1 << 16)
def _step(code: int, after: tuple) -> tuple[tuple, int]:
    v = _back(code, after)
    return _normal(v), min(v)


@lru_cache(maxsize=1 << 16)
def _moves(code: int, after: tuple) -> list[tuple[str, int, int]]:
    """(letters, state behind the turn, cost) from each state before it; S: a system turn is kept."""
    own, initial, cut = _back(code, after), code & 3, CUT if code & 4 else 0
    out = []
    for q in range(4):
        letters, cost = "", 0
        while True:
            keep = 1 if initial == 0 and q == 0 else TO[q] if initial == TO[q] - 1 else None
            if DELETE + after[q] == own[q]:
                letters, cost = letters + "D", cost + DELETE
            elif INSERT + own[TO[q]] == own[q]:
                letters, cost, q = letters + "I", cost + INSERT, TO[q]
                continue
            elif keep is not None and cut + after[keep] == own[q]:
                letters, cost, q = letters + ("S" if keep == 1 else "K"), cost + cut, keep
            else:
                letters, cost, q = letters + "R", cost + cut + REROLE, TO[q]
            break
        out.append((letters, q, cost))
    return out


def sweep(codes: list[int], behind: tuple) -> list[tuple]:
    """The vectors, less their least entries, before each turn and behind the last."""
    out = [behind]
    for code in reversed(codes):
        out.append(_step(code, out[-1])[0])
    return out[::-1]


def matrix(codes: list[int]) -> list[tuple]:
    """Row q: the costs from state q before the turns to each state behind them."""
    columns = []
    for end in range(4):
        v = tuple(0 if q == end else FAR for q in range(4))
        for code in reversed(codes):
            v = tuple(min(c, FAR) for c in _back(code, v))
        columns.append(v)
    return [tuple(columns[e][q] for e in range(4)) for q in range(4)]


def trace(codes: list[int], behind: tuple, last: bool) -> list[tuple[str, int, int]]:
    """(letters, state behind, cost) of the least audit from each state."""
    vectors = sweep(codes, behind)
    out = []
    for q in range(4):
        letters, cost = [], 0
        for i, code in enumerate(codes):
            more, q, price = _moves(code, vectors[i + 1])[q]
            letters.append(more)
            cost += price
        while last and END[q]:
            letters.append("I")
            cost += INSERT
            q = TO[q]
        out.append(("".join(letters), q, cost))
    return out


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, initial, digest, blank, cut, start, at, size, duplicate) of every turn, narrow."""
    trimmed = F.rtrim(body(text), F.lit(SPACE))
    last = F.substring(trimmed, -1, 1)
    first = F.substring(col(role).cast("string"), 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    narrow = rows.select(
        col(conv).alias("conv"), col(turn).alias("turn"), col(role).cast("string").alias("role"), initial.alias("initial"),
        digest(conv, role, text).alias("digest"), (trimmed == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("no"))
    placed = stored(ranked(narrow, "conv", [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                            F.col("digest"), F.col("no")], "turns").drop("role", "no"), "turn-places")
    # the first of the turns that share conversation, role and text; a digest holds all three
    first = placed.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")) \
        .where("copies > 1").drop("copies")
    return stored(placed.join(first, "digest", "left").withColumn(
        "duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
        .withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("duplicate")).drop("first"), "turn-faults")


def digest(conv: str, role: str, text: str) -> Column:
    """sha256 of conversation, role and text (null as empty)."""
    r = col(role).cast("string")
    return F.sha2(F.concat(F.coalesce(col(conv).cast("string"), F.lit("-")), F.lit(":"),
                           F.coalesce(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r), F.lit("-")),
                           F.lit(":"), body(text)), 256)


def chunks(each: DataFrame, chunk: int) -> DataFrame:
    """(start, chunk, last, codes, prior): the codes of a chunk's turns in order; ``prior``: the initial
    of the turn before it, or null."""
    no = F.floor(F.col("at") / chunk)
    code = F.col("initial") + F.when(F.col("cut"), 4).otherwise(0) \
        + F.when(F.col("blank") | F.col("duplicate"), 8).otherwise(0)
    # the last turn of a chunk also stands before the next chunk
    to = F.when((F.col("at") % chunk == chunk - 1) & (F.col("at") + 1 < F.col("size")), F.array(no, no + 1)) \
        .otherwise(F.array(no))
    g = each.select("start", "size", F.explode(to).alias("chunk"), F.struct("at", code.alias("code")).alias("x"))
    g = g.groupBy("start", "size", "chunk").agg(F.sort_array(F.collect_list("x")).alias("x"))
    inside = lambda x: x["at"] >= F.col("chunk") * chunk
    return g.select(
        "start", "chunk", ((F.col("chunk") + 1) * chunk >= F.col("size")).alias("last"),
        F.transform(F.filter("x", inside), lambda x: x["code"]).alias("codes"),
        F.when(~inside(F.col("x")[0]), F.col("x")[0]["code"].bitwiseAND(3)).alias("prior"))


def _swept(work: DataFrame) -> DataFrame:
    """(start, chunk, last, behind, before) of ``work`` (start, chunk, last, behind, codes)."""
    def run(batches):
        for b in batches:
            behind = [tuple(v) for v in b.column(3).to_pylist()]
            front = [list(sweep(c, v)[0]) for c, v in zip(b.column(4).to_pylist(), behind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(front, pa.list_(pa.int64()))],
                                             ["start", "chunk", "last", "behind", "before"])

    return work.select("start", "chunk", "last", "behind", "codes").mapInArrow(
        run, f"start long, chunk long, last boolean, behind {VECTOR}, before {VECTOR}")


def vectors(parts: DataFrame, passes: int = 4) -> DataFrame:
    """(start, chunk, last, behind): the costs behind each chunk, less the least."""
    end = F.array(*[F.lit(c).cast("long") for c in END])
    v = stored(_swept(parts.withColumn("behind", end)), "speculated")
    if v.where("NOT last").isEmpty():
        return v
    for k in range(passes + 1):
        found = v.select("start", (F.col("chunk") - 1).alias("chunk"), F.col("before").alias("found"))
        wrong = stored(v.where("NOT last").join(found, ["start", "chunk"]).where("found <> behind")
                       .select("start", "chunk", "found"), "unlike")
        if wrong.isEmpty():
            return v
        if k < passes:
            again = parts.join(wrong, ["start", "chunk"]).withColumnRenamed("found", "behind")
            v = stored(v.join(wrong, ["start", "chunk"], "left_anti").unionByName(_swept(again)), "fixed-up")
    return _doubled(parts.join(wrong.select("start").distinct(), "start", "left_semi"), v)


def _doubled(parts: DataFrame, v: DataFrame) -> DataFrame:
    """``vectors`` of whole conversations by products of the chunks' matrices."""
    def run(batches):
        for b in batches:
            m = [[list(r) for r in matrix(c)] for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.list_(pa.int64())))],
                                             ["start", "chunk", "m"])

    m = stored(parts.select("start", "chunk", "codes").mapInArrow(run, f"start long, chunk long, m array<{VECTOR}>"),
               "matrices")
    end = F.array(*[F.lit(c).cast("long") for c in END])

    def times(a, b):
        cell = lambda row, j: F.array_min(F.transform(
            F.arrays_zip(row.alias("x"), b.alias("y")), lambda z: z["x"] + z["y"][j]))
        return F.transform(a, lambda row: F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda j: F.least(cell(row, j), F.lit(FAR))))

    most, reach = m.agg(F.max("chunk")).first()[0], 1
    while reach <= most:  # m: the product of a chunk and up to reach - 1 behind it
        later = m.select("start", (F.col("chunk") - reach).alias("chunk"), F.col("m").alias("more"))
        m = stored(m.join(later, ["start", "chunk"], "left").select(
            "start", "chunk", F.when(F.col("more").isNull(), F.col("m")).otherwise(times(F.col("m"), F.col("more")))
            .alias("m")), "products")
        reach *= 2
    cost = F.transform("m", lambda row: F.array_min(F.transform(
        F.arrays_zip(row.alias("x"), end.alias("y")), lambda z: z["x"] + z["y"])))
    front = m.withColumn("c", cost).select(
        "start", (F.col("chunk") - 1).alias("chunk"), F.transform("c", lambda x: x - F.array_min("c")).alias("true"))
    j = v.join(front, ["start", "chunk"], "left")
    return stored(j.select("start", "chunk", "last", F.coalesce("true", "behind").alias("behind")), "doubled")


def audits(parts: DataFrame, v: DataFrame) -> DataFrame:
    """(start, chunk, state, audit, cost, illegal) of every chunk."""
    def run(batches):
        for b in batches:
            rows = [trace(c, tuple(w), e) for c, w, e in
                    zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            bad = []
            for c, p in zip(b.column(2).to_pylist(), b.column(5).to_pylist()):
                line = [x & 3 for x in c] if p is None else [p, *(x & 3 for x in c)]
                bad.append(sum((x, y) not in ((0, 1), (1, 2), (2, 1)) for x, y in zip(line, line[1:])))
            col_of = lambda i, kind: pa.array([[t[i] for t in r] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), col_of(0, pa.string()), col_of(1, pa.int32()), col_of(2, pa.int64()),
                 pa.array(bad, pa.int64())], ["start", "chunk", "audits", "ends", "costs", "illegal"])

    j = parts.join(v.select("start", "chunk", "behind"), ["start", "chunk"]).select(
        "start", "chunk", "codes", "behind", "last", "prior")
    t = stored(j.mapInArrow(run, "start long, chunk long, audits array<string>, ends array<int>, costs array<long>, "
                                 "illegal long"), "traces")
    most = t.agg(F.max("chunk")).first()[0] or 0
    m, reach = t.select("start", "chunk", "ends"), 1
    while reach <= most:  # ends: over a chunk and up to reach - 1 before it
        earlier = m.select("start", (F.col("chunk") + reach).alias("chunk"), F.col("ends").alias("e"))
        m = stored(m.join(earlier, ["start", "chunk"], "left").select(
            "start", "chunk", F.when(F.col("e").isNull(), F.col("ends")).otherwise(
                F.transform("e", lambda q: F.get("ends", q))).alias("ends")), "state-maps")
        reach *= 2
    begin = m.select("start", (F.col("chunk") + 1).alias("chunk"), F.get("ends", F.lit(0)).alias("state"))
    t = t.join(begin, ["start", "chunk"], "left") if most else t.withColumn("state", F.lit(0))
    state = F.coalesce("state", F.lit(0))
    return stored(t.select("start", "chunk", state.alias("state"), F.get("audits", state).alias("audit"),
                           F.get("costs", state).alias("cost"), "illegal"), "audits")


def edits(told: DataFrame, chunk: int) -> DataFrame:
    """(start, at, sub, role, old) of the turns that the audits leave: ``role`` is null where it stays;
    inserted turns (not ``old``) stand before the turn at the same place."""
    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for start, no, q, audit in zip(*[c.to_pylist() for c in b.columns]):
                at, sub = no * chunk, 0
                for x in audit:
                    if x != "D":
                        q = 1 if x == "S" else TO[q]
                        role = None if x in "SK" else "assistant" if q == 3 else "user"
                        for c, value in zip(out, (start, at, sub, role, x != "I")):
                            c.append(value)
                    at, sub = (at, sub + 1) if x == "I" else (at + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.bool_())], ["start", "at", "sub", "role", "old"])

    return told.select("start", "chunk", "state", "audit").mapInArrow(
        run, "start long, at long, sub int, role string, old boolean")


def _hashes(repaired: DataFrame) -> DataFrame:
    """(start, sha256) over the repaired turns of each conversation, streamed in order."""
    def run(batches):
        now, h = None, None
        for b in batches:
            for start, line in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if start != now:
                    if h is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])],
                                                         ["start", "repaired_sha256"])
                    now, h = start, hashlib.sha256(line)
                else:
                    h.update(b"\n" + line)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])],
                                             ["start", "repaired_sha256"])

    line = F.concat(F.coalesce("role", F.lit("")), F.lit(":"), body("text"))
    r = repaired.repartition("start").sortWithinPartitions("start", "at", "sub")
    return r.select("start", line.alias("line")).mapInArrow(run, "start long, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = 2048, passes: int = 4) -> tuple[DataFrame, DataFrame]:
    """(report, turns). Report: one row per conversation with key, gaps (turn numbers missing between
    the least and the greatest), blank, duplicate, truncated (turns by their first fault), illegal
    (neighbours whose initials are not su, ua or au), cost, audit, repaired_sha256. Turns: key, at, sub,
    role, text of the repaired conversations, ordered by (at, sub) inside a key."""
    each = turns(rows, conv, turn, role, text)
    parts = stored(chunks(each, chunk), "turn-chunks")
    told = audits(parts, vectors(parts, passes))

    # an edited turn's words come from any row with its digest: they are all the same
    left = edits(told, chunk).withColumnRenamed("role", "new")
    placed = each.where("NOT blank AND NOT duplicate").select("start", "at", F.lit(True).alias("old"), "digest")
    named = left.join(placed, ["start", "at", "old"], "left")
    texts = rows.select(digest(conv, role, text).alias("digest"), col(role).cast("string").alias("role"),
                        body(text).alias("text")).groupBy("digest").agg(
        F.first("role").alias("role"), F.first("text").alias("text"))
    keys = each.groupBy("start").agg(F.first("conv").alias("key"))
    kept = named.where("old").join(texts, "digest").select(
        "start", "at", "sub", F.coalesce("new", "role").alias("role"), "text")
    put = named.where("NOT old").select("start", "at", "sub", F.col("new").alias("role"), F.lit("").alias("text"))
    repaired = stored(kept.unionByName(put), "repaired-turns")

    count = lambda c: F.count(F.when(c, 1))
    numbered = F.col("turn").isNotNull()
    by_turn = each.groupBy("start", "turn").agg(
        F.first("conv").alias("conv"), count(F.col("blank")).alias("blank"),
        count(F.col("duplicate")).alias("duplicate"), count(F.col("cut")).alias("truncated"))
    faults = by_turn.groupBy("start").agg(
        F.first("conv").alias("key"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(numbered), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    sums = told.groupBy("start").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))),
                                             lambda x: x["audit"]), ""), "S", "K").alias("audit"))
    report = faults.join(sums, "start").join(_hashes(repaired), "start", "left").select(
        "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return report, repaired.join(keys, "start").select("key", "at", "sub", "role", "text")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``rows`` (those four columns) with planted faults, by crc32 of ``conv:turn`` (null: a space) modulo
    20: 0 drops the row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it a user's."""
    name = F.concat_ws(":", *[F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    d = rows.select(*[col(c).alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))],
                    (F.crc32(name.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    fault = F.col("fault")
    return d.select(
        "conv", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
