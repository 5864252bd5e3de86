"""Repair of conversations at least cost: which rows to keep, rerole or delete, and where to insert turns, so that the roles
are an optional system turn and then pairs of user and assistant; of all cheapest ways the least by its audit.

All rows of a conversation are ordered by a range partitioning, so that a long one is spread, and cut into segments of at most
SEGMENT rows. Costs go from the end to the start: inside a segment by rows (all segments of a batch at once, in numpy), across
segments by products of 4 x 4 cost matrices, doubled by joins. Then the nodes (gap, state) of a segment are ranked by the labels
of their cheapest arcs, for audits of 1, 2, 4, ... letters, with a pointer to where so many letters lead. A label leads from a
node to one node only, so the least audit of any length has one end; the doubled pointers then name all nodes of the least path, for
each state in which a segment may be entered, and joins that double the segments tell in which it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize

#: Rows of a segment (a power of two: the bits of an id below it).
SEGMENT_BITS = 12
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 4 stands for none. What follows by an inserted or
#: reroled turn, by a kept one (system, user, assistant, other), and what ending in a state costs.
NEXT, KEPT, AT_END = [2, 2, 3, 2], [[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]], [0, 4, 2, 0]
FAR = 1 << 60
SPACE = " \t\n\x0b\f\r"
PLANNED = "id long, ops int, end int"


def ordered_rows(rows: DataFrame) -> DataFrame:
    """conv (text), turn, role, text, copies, id: equal rows as one with their number; ids follow conv, turn (nulls first), role and
    text, so that the rows of a conversation have rising ids. Written once, as ids wouldn't be the same again."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return materialize(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))


def faults(ordered: DataFrame) -> DataFrame:
    """id, conv, seg, kind (0 system, 1 user, 2 assistant, 3 other), fault (blank, duplicate, truncated or empty), extra (copies
    beside the row itself). First rows of equal role and text are found by digest; ids say which they are."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = ordered.groupBy("conv", digest.alias("digest")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    light = ordered.select(
        "id", "conv", F.shiftright("id", SEGMENT_BITS).alias("seg"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"), (F.col("copies") - 1).alias("extra"),
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return light.join(firsts, "id", "left").select("id", "conv", "seg", "kind", fault.alias("fault"), "extra")


def _costs(kind, forced, cut, extra, start, size, ends):
    """Cost to the end from every gap and state. Rows of all segments one after the other; a segment of m rows has m + 1
    gaps; ends: (segments, k, 4) for k ends at once. Returns (gaps, k, 4)."""
    import numpy as np

    kept_to, gap = np.array(KEPT), start + np.arange(len(start))
    out = np.empty((len(kind) + len(start), *ends.shape[1:]), np.int64)
    out[gap + size] = ends
    order = np.argsort(-size, kind="stable")
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        some = order[: np.searchsorted(-size[order], -t)]
        row, g = start[some] + t, gap[some] + t
        then = out[g + 1]
        own = (extra[row] * DELETE)[:, None, None]
        padded = np.concatenate([then, np.full((*then.shape[:2], 1), FAR)], 2)
        stay = (own[:, 0, 0] + cut[row] * TRUNCATED + np.where(forced[row], FAR, 0))[:, None, None]
        kept = np.take_along_axis(padded, np.broadcast_to(kept_to[kind[row]][:, None, :], then.shape), 2) + stay
        best = np.minimum(np.minimum(then + own + DELETE, kept), then[..., NEXT] + stay + REROLE)
        two = np.minimum(best[..., 2], best[..., 3] + INSERT)
        three = np.minimum(best[..., 3], best[..., 2] + INSERT)
        out[g] = np.stack([np.minimum(best[..., 0], two + INSERT), np.minimum(best[..., 1], two + INSERT), two, three], -1)
    return np.minimum(out, FAR)


def _least_paths(kind, forced, cut, extra, start, size, ends, last):
    """For each row, and for the end of each segment, the step on the least path from each of four entry states, one byte
    each: turns inserted, state then (from bit 2), and the edit (from bit 4: 1 delete, 3 keep, 4 rerole)."""
    import numpy as np

    costs = _costs(kind, forced, cut, extra, start, size, ends[:, None, :])[:, 0, :]
    seg = np.repeat(np.arange(len(start)), size)
    gap = np.arange(len(kind)) + seg  # of the row
    end = start + np.arange(len(start)) + size
    nodes = np.arange(costs.size)
    label, to = np.zeros(costs.shape, np.int64), nodes.reshape(costs.shape).copy()

    def arcs(gaps, fits, name, target):  # later calls have lesser labels
        where = np.nonzero(fits)
        label[gaps[where[0]], where[1]] = name
        to[gaps[where[0]], where[1]] = target[where]

    here, then = costs[gap], costs[gap + 1]
    stay = (extra * DELETE + cut * TRUNCATED + np.where(forced, FAR, 0))[:, None]
    after, follow = (gap + 1)[:, None] * 4, np.array(NEXT)
    arcs(gap, here == then[:, follow] + stay + REROLE, 4, after + follow)
    target = np.array(KEPT)[kind]
    kept = np.take_along_axis(np.c_[then, np.full(len(then), FAR)], target, 1)
    arcs(gap, (target < 4) & (here == kept + stay), 3, after + target)
    both = np.r_[gap, end[last]]
    arcs(both, costs[both] == costs[both][:, follow] + INSERT, 2, both[:, None] * 4 + follow)
    arcs(gap, here == then + ((extra + 1) * DELETE)[:, None], 1, after + np.arange(4))

    rank, jumps = label.ravel(), [to.ravel()]
    while True:  # rank by audits of twice the length
        jump = jumps[-1]
        further = jump[jump]
        if (further == jump).all():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        jumps.append(further)
    seen = np.zeros(len(nodes), np.uint8)
    for e in range(4):
        seen[(start + np.arange(len(start))) * 4 + e] |= np.uint8(1 << e)
    for jump in reversed(jumps):
        np.bitwise_or.at(seen, jump, seen.copy())
    seen, steps = seen.reshape(costs.shape), np.zeros(len(costs), np.int64)
    for e in range(4):
        on = (seen >> e & 1).astype(bool)
        leaves = on & (label != 2)
        state = leaves.argmax(1)
        code = on.sum(1) - 1 | state << 2 | label[np.arange(len(costs)), state] << 4
        steps |= code << 8 * e
    return steps[gap].astype(np.int32), steps[end].astype(np.int32)


def _segments(batches):
    """From rows in the order of seg and id, arrays of whole segments; a batch's last one waits for the next batch."""
    import numpy as np
    import pyarrow as pa

    def arrays(table):
        names = {c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}
        new = np.r_[True, (names["conv"][1:] != names["conv"][:-1]) | (names["seg"][1:] != names["seg"][:-1])]
        start = np.flatnonzero(new)
        fault = names["fault"]
        names |= {"forced": (fault == "blank") | (fault == "duplicate"), "cut": (fault == "truncated").astype(np.int64)}
        return names, start, np.diff(np.r_[start, len(new)])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        names, start, _ = arrays(table)
        cut = int(start[-1])
        held = table.slice(cut)
        if cut:
            yield arrays(table.slice(0, cut))
    if held is not None:
        yield arrays(held.combine_chunks())


def _dealt(light: DataFrame) -> DataFrame:
    return light.repartition("seg").sortWithinPartitions("seg", "id")


def segment_costs(light: DataFrame) -> DataFrame:
    """conv, seg, m: the least costs from each state before a segment to each after it, 16 numbers (FAR: none)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        for x, start, size in _segments(batches):
            found = _costs(x["kind"], x["forced"], x["cut"], x["extra"], start, size, np.repeat(unit[None], len(start), 0))
            m = found[start + np.arange(len(start))].transpose(0, 2, 1).reshape(len(start), 16)  # by state before, then after
            yield pa.RecordBatch.from_arrays([pa.array(x["conv"][start], pa.string()), pa.array(x["seg"][start]), pa.array(m.tolist(), pa.list_(pa.int64()))], ["conv", "seg", "m"])

    return _dealt(light.select("conv", "seg", "id", "kind", "fault", "extra")).mapInArrow(run, "conv string, seg long, m array<long>")


def segment_paths(light: DataFrame) -> DataFrame:
    """id, ops, end: the steps of `_least_paths`; `end` at the last row of a segment. Wants `after`, the costs after the
    segment by state, where it isn't a conversation's last."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for x, start, size in _segments(batches):
            after = x["after"][start]
            last = np.array([a is None for a in after])
            ends = np.array([AT_END if a is None else list(a) for a in after], np.int64)
            ops, end = _least_paths(x["kind"], x["forced"], x["cut"], x["extra"], start, size, ends, last)
            at = np.full(len(ops), None, object)
            at[start + size - 1] = end
            yield pa.RecordBatch.from_arrays([pa.array(x["id"]), pa.array(ops), pa.array(list(at), pa.int32())], ["id", "ops", "end"])

    return _dealt(light.select("conv", "seg", "id", "kind", "fault", "extra", "after")).mapInArrow(run, PLANNED)


def _least_sums(a: str, b: str) -> Column:
    return F.array(*[F.least(F.lit(FAR), *[F.col(a)[4 * i + k] + F.col(b)[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def _composed(first: str, then: str) -> Column:
    """Of two maps of four states, one byte each: `then` of `first`."""
    byte = lambda e: F.expr(f"shiftleft(shiftright({then}, 8 * (shiftright({first}, {8 * e}) & 255)) & 255, {8 * e})")
    return byte(0).bitwiseOR(byte(1)).bitwiseOR(byte(2)).bitwiseOR(byte(3))


def _doubled(table: DataFrame, value: str, most: int, step: int, join) -> DataFrame:
    """Values of (conv, k) combined with all that come after (step 1) or before (step -1), in log2 `most` rounds."""
    reach = 1
    while reach < most:
        other = table.select("conv", (F.col("k") - step * reach).alias("k"), F.col(value).alias("_other"))
        new = materialize(table.join(other, ["conv", "k"], "left").withColumn(value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(join(value, "_other"))).drop("_other"))
        if reach > 1:
            discard(table)
        table, reach = new, 2 * reach
    return table


def plan_repairs(light: DataFrame) -> DataFrame:
    """id, op, end: for each row of `faults` its step on the least of the cheapest paths, and what follows a conversation's last
    row. `light` is read more than once."""
    segs = light.groupBy("conv", "seg").agg(F.max("id").alias("id"))
    of = Window.partitionBy("conv")
    # conversations of several segments; a window holds one row for SEGMENT rows of a conversation
    many = materialize(segs.withColumns({"of": F.count("*").over(of), "k": F.row_number().over(of.orderBy("seg"))}).where("of > 1"))
    most = many.agg(F.max("of")).first()[0] or 0
    if not most:
        return segment_paths(light.withColumn("after", F.lit(None).cast("array<long>"))).select("id", F.col("ops").bitwiseAND(F.lit(255)).alias("op"), F.col("end").bitwiseAND(F.lit(255)).alias("end"))
    rows = light.join(many.select("conv", "seg", "k", "of"), ["conv", "seg"], "left")
    matrices = segment_costs(rows.where("k is not null")).join(many.select("conv", "seg", "k"), ["conv", "seg"])
    onward = _doubled(materialize(matrices), "m", most, 1, _least_sums)
    vector = F.array(*[F.least(*[F.col("m")[4 * i + j] + AT_END[j] for j in range(4)]) for i in range(4)])
    after = onward.select("conv", (F.col("k") - 1).alias("k"), vector.alias("after"))
    paths = materialize(segment_paths(rows.join(after, ["conv", "k"], "left")))
    state = lambda e: F.expr(f"shiftleft(shiftright(end, {8 * e + 2}) & 3, {8 * e})")
    exits = many.join(paths.select("id", "end"), "id").select("conv", "k", state(0).bitwiseOR(state(1)).bitwiseOR(state(2)).bitwiseOR(state(3)).alias("f"))
    inward = _doubled(materialize(exits), "f", most, -1, lambda f, other: _composed(other, f))
    entries = inward.select("conv", (F.col("k") + 1).alias("k"), F.col("f").bitwiseAND(F.lit(3)).alias("entry"))
    entered = many.join(entries, ["conv", "k"], "left").select("conv", "seg", F.coalesce("entry", F.lit(0)).alias("entry"), (F.col("k") == F.col("of")).alias("ends"))
    told = light.select("id", "conv", "seg").join(paths, "id").join(entered, ["conv", "seg"], "left")
    told = told.withColumns({"entry": F.coalesce("entry", F.lit(0)), "ends": F.coalesce("ends", F.lit(True))})
    return told.select("id", F.expr("shiftright(ops, 8 * entry) & 255").alias("op"), F.when(F.col("ends"), F.expr("shiftright(end, 8 * entry) & 255")).alias("end"))


ROLES = {2: "user", 3: "assistant"}


def _inserted(code: int) -> list[str]:
    n, state = code & 3, code >> 2 & 3
    return [ROLES[state if (n - 1 - i) % 2 == 0 else 5 - state] for i in range(n)]


def repaired_turns(row) -> list[tuple[str, str]]:
    """(role, text) of what stands for a planned row after the repair."""
    turns = [(role, "") for role in _inserted(row["op"])]
    edit, state = row["op"] >> 4, row["op"] >> 2 & 3
    if edit == 3:
        turns.append((row["role"], row["text"]))
    elif edit == 4:
        turns.append((ROLES[NEXT[state]], row["text"]))
    return turns + [(role, "") for role in _inserted(row["end"] or 0)]


REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(planned: DataFrame) -> DataFrame:
    """One row for each conversation with rows. A digest goes through a text from start to end, so a conversation's rows stream
    through one task; that holds one row, counters and the audit (a letter a row) at a time."""

    def run(batches):
        import pyarrow as pa

        own, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or own.conv != row["conv"]:
                    if own:
                        out.append(own.row())
                    own = _Repaired(row["conv"])
                own.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if own:
            yield pa.RecordBatch.from_pylist([own.row()])

    columns = planned.select("conv", "id", "turn", "role", "text", "fault", "extra", "op", "end")
    return columns.repartition("conv").sortWithinPartitions("conv", "id").mapInArrow(run, REPORT)


class _Repaired:
    """Counters of a conversation while its rows pass in order."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, conv: str):
        self.conv, self.count = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.audit, self.digest, self.any = [], hashlib.sha256(), False

    def add(self, row: dict) -> None:
        turn, fault, extra, op, initial = row["turn"], row["fault"], row["extra"], row["op"], row["role"][:1]
        if turn is not None:
            self.turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        if fault:
            self.count[fault] += 1
        self.count["blank" if fault == "blank" else "duplicate"] += extra
        self.illegal += (self.before is not None and self.before + initial not in self.LEGAL) + extra
        self.before = initial
        inserted, edit, end = op & 3, op >> 4, (row["end"] or 0) & 3
        self.cost += INSERT * (inserted + end) + DELETE * extra + (DELETE if edit == 1 else TRUNCATED * (fault == "truncated") + REROLE * (edit == 4))
        self.audit.append("I" * inserted + " D KR"[edit] + "D" * extra + "I" * end)
        for role, text in repaired_turns(row):
            self.digest.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, **self.count, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def planned_rows(rows: DataFrame) -> DataFrame:
    """All distinct rows with their fault, copies beside the first, and step (`repaired_turns` tells what it makes of them)."""
    ordered = ordered_rows(rows)
    light = materialize(faults(ordered))
    planned = plan_repairs(light)
    return ordered.join(light.select("id", "fault", "extra"), "id").join(planned, "id")


def conv_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The report on rows of conv_id, turn, role and text, with the id as it is.

    Edge cases: a null role or text counts as one space; a null conv_id is a conversation of its own; null turns come first and
    aren't gaps; rows of one turn are ordered by role, then text; equal rows are repeats; roles other than system, user and
    assistant, told by initials, can't be kept; an empty table gives an empty result; extra columns don't matter.
    """
    space = F.lit(" ")
    plain = rows.select(conv_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    told = report(planned_rows(plain))
    own = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(rows.schema["conv_id"].dataType)
    return told.select(own.alias("conv_id"), *told.columns[1:])


def damage(rows: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its end
    marks, 3 repeats it, 4 makes it the user's. Nulls are written as one space in the key and become one space."""
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), key.alias("_h")).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return changed.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_t")).drop("_t")
