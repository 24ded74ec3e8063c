"""Chat formatting with minimum-cost role repair.

A legal conversation is a path through a small automaton: an optional system turn, then user and
assistant turns in alternation, ending with the assistant. For each given turn the repair may keep
its role, relabel it, merge it into the turn before, or put empty turns before it; dynamic
programming over the automaton's states finds the cheapest repair of the whole conversation,
which is then rendered.

A conversation of more than ``chunk_turns`` turns is not gathered anywhere. The turns of all such
conversations are put in order over the cluster and cut by their place in it into chunks; each chunk
is summed up as a matrix of least costs from state to state, the matrices of a conversation (one for
each chunk) are chained to give the costs at the cuts, from these each chunk finds which state each
of its last states comes from, and that is chained back to the state after each chunk. Every chunk
then takes exactly the steps that the whole conversation would take, ties included. Rendered pieces are rows,
one for each given turn; joined in order they are the rendered conversation.

Edge cases: a null or unknown role may become any role at a small cost; a null text is empty; a null
turn number sorts last; turns with equal numbers go by hashes of role and text; repeated rows are turns of
their own; rows without a conversation id form one conversation; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import land, located, small_enough

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then "the last turn is of this role".
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Which turns may follow a state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
FAR = 1 << 40
BEGIN = [0, FAR, FAR, FAR]


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    unknown: int = 1
    merge: int = 1
    merge_other: int = 4
    insert: int = 2


class Automaton:
    """For each kind of turn and pair of states the cheapest step and its cost."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        # cheapest chains of empty turns from state to state (a system turn is never made up)
        self.chain: dict[tuple[int, int], tuple[int, ...]] = {}
        for a in range(STATES):
            self.chain[a, a] = ()
            front = [(a, ())]
            while front:
                at, path = front.pop(0)
                for b in NEXT[at]:
                    if b != SYSTEM and (a, b) not in self.chain:
                        self.chain[a, b] = (*path, b)
                        front.append((b, (*path, b)))
        self.steps = [[[self._step(r, a, b) for b in range(STATES)] for a in range(STATES)] for r in range(STATES)]
        #: (cost, turns to add) from a state to the end
        self.close = [(len(self.chain[a, FINAL]) * costs.insert, self.chain[a, FINAL]) if a != START else (0, ()) for a in range(STATES)]

    def _step(self, role: int, a: int, b: int) -> tuple[int, str, tuple[int, ...]]:
        """Cheapest way from state a to b with one given turn (role 0: unknown): cost, action, turns put before."""
        c, found = self.costs, []
        label = 0 if role == b else c.unknown if role == START else c.relabel
        for (s, t), path in self.chain.items():
            if s == a and b in NEXT[t]:
                found.append((label + len(path) * c.insert, len(path), "keep" if role == b else "relabel", path))
        if a == b != START:
            found.append((c.merge if role in (START, a) else c.merge_other, 0, "merge", ()))
        best = min(found, default=(FAR, 0, "", ()))
        return best[0], best[2], best[3]

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least cost from each state to each state over the given turns."""
        out = []
        for a in range(STATES):
            row = [0 if b == a else FAR for b in range(STATES)]
            for r in roles:
                step = self.steps[r]
                row = [min(row[s] + step[s][b][0] for s in range(STATES)) for b in range(STATES)]
            out.append(row)
        return out

    def walk(self, roles: list[int], enter: list[int]) -> tuple[list[int], list[list[int]]]:
        """Costs of the states after the turns, given those before, and for each turn the state that each state comes from."""
        row, back = enter, []
        for r in roles:
            step = self.steps[r]
            best = [min((row[s] + step[s][b][0], s) for s in range(STATES)) for b in range(STATES)]
            row = [x for x, _ in best]
            back.append([s for _, s in best])
        return row, back

    def last(self, row: list[int]) -> int:
        """The state in which the turns end best."""
        return min(range(STATES), key=lambda s: row[s] + self.close[s][0])

    def path(self, roles: list[int], enter: list[int] | None = None, leave: int | None = None) -> list[int]:
        """The states before and after each turn; ``enter`` holds the costs of the states before, None for the start."""
        row, back = self.walk(roles, BEGIN if enter is None else enter)
        out = [self.last(row) if leave is None else leave]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def repair(self, roles: list[int]) -> tuple[int, list[tuple[int, str, tuple[int, ...], int]]]:
        """Cost of a whole conversation, and (role, action, turns before, cost) of each given turn."""
        states = self.path(roles)
        out = []
        for r, a, b in zip(roles, states, states[1:], strict=False):
            cost, action, added = self.steps[r][a][b]
            out.append((b, action, added, cost))
        return sum(x[3] for x in out) + self.close[states[-1]][0], out


def chain_costs(matrices: list[list[list[int]]]) -> list[list[int]]:
    """Costs of the states before each chunk, and after the last one."""
    rows = [BEGIN]
    for m in matrices:
        rows.append([min(rows[-1][s] + m[s][b] for s in range(STATES)) for b in range(STATES)])
    return rows


@dataclass(frozen=True)
class Template:
    """How turns are written. Text that looks like a marker is broken up by a space."""

    head: str = "<|{role}|>\n"
    tail: str = "<|end|>\n"
    joint: str = "\n\n"

    def text(self, text: Column) -> Column:
        return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))

    def turn(self, role: int) -> str:
        return self.head.format(role=ROLES[role - 1])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of equal (conv_id, chunk), and where the runs start (and the last one ends)."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        keys = [rows.column("conv_id").fill_null(0), rows.column("conv_id").is_null(), rows.column("chunk")]
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in (x.to_numpy(zero_copy_only=False) for x in keys)])
        marks = np.flatnonzero(new)
        if marks[-1]:
            yield rows.slice(0, marks[-1]), marks
        held = rows.slice(marks[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _role_code():
    role = F.lower(F.trim("role"))
    return F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(0).cast("int")


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
    template: Template = Template(),
    chunk_turns: int = 4096,
) -> DataFrame:
    """One row for each given turn, with its new role, what was done and its piece of the rendering.

    ``inserted`` names the empty turns put before it (and, after a bar, those that end the
    conversation). The pieces in order of (chunk, place) make up the conversation.
    """
    automaton = Automaton(costs)
    turns, place = located(turns)
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
        F.col(place).alias("row"),
    ).withColumns({"code": _role_code(), "tie": F.xxhash64("role", "text"), "tie2": F.xxhash64(F.lit(1), "role", "text")})
    order = [F.col("turn").asc_nulls_last(), F.col("tie"), F.col("tie2"), F.col("row")]
    border = F.lit(None).cast("array<bigint>").alias("enter"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("ends")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_turns)
    long = land(sizes.select(F.col("conv_id").alias("long_id")), "long")
    if long.isEmpty():
        rows = rows.select("*", F.lit(0).cast("long").alias("chunk"), *border)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        hot = rows.join(small_enough(long, 16), same, "left_semi").repartitionByRange(F.col("conv_id"), *order).sortWithinPartitions("conv_id", *order)
        # a row's number in its task, cut into chunks; tasks follow one another in order
        number = F.monotonically_increasing_id()
        hot = land(hot.withColumn("chunk", number - F.pmod(number, F.lit(1 << 33)) + F.floor(F.pmod(number, F.lit(1 << 33)) / chunk_turns)), "hot")
        borders = _borders(hot.select("conv_id", "chunk", "turn", "tie", "tie2", "row", "code"), automaton, order)
        at = hot["conv_id"].eqNullSafe(borders["at_id"]) & (hot["chunk"] == borders["at_chunk"])
        short = rows.join(small_enough(long, 16), same, "left_anti").select("*", F.lit(0).cast("long").alias("chunk"), *border)
        rows = short.unionByName(hot.join(small_enough(borders, 80), at).drop("at_id", "at_chunk"))
    rows = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", *order)

    # what a step means, by (given role, state before, state after), and an end, by state
    steps = [automaton.steps[r][a][b] for r in range(STATES) for a in range(STATES) for b in range(STATES)]
    after = [b for _ in range(STATES * STATES) for b in range(STATES)]
    opens = [a == START for _ in range(STATES) for a in range(STATES) for _ in range(STATES)]
    heads = [_head(template, added, action, b, first) for (_, action, added), b, first in zip(steps, after, opens, strict=True)]
    names = lambda roles: ",".join(ROLES[r - 1] for r in roles)
    ends = [template.tail + "".join(template.turn(r) + template.tail for r in close) for _, close in automaton.close]
    closings = ["|" + names(close) if close else "" for _, close in automaton.close]
    step_cost, close_cost = np.array([x[0] for x in steps], np.int64), np.array([x[0] for x in automaton.close], np.int64)
    columns = {"role_out": [ROLES[b - 1] if b else "" for b in after], "action": [x[1] for x in steps], "put": [names(x[2]) for x in steps], "head": heads}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: pa.array(v, pa.string()) for n, v in columns.items()} | {"tail": pa.array([*ends, ""], pa.string()), "closing": pa.array([*closings, ""], pa.string())}
        for batch, marks in _groups(batches):
            codes, enter, leave = (batch.column(n).to_pylist() for n in ("code", "enter", "leave"))
            last = batch.column("ends").to_numpy(zero_copy_only=False)
            kind, end = np.empty(batch.num_rows, np.int64), np.full(batch.num_rows, STATES)
            for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                states = automaton.path(codes[a:b], enter[a], leave[a])
                kind[a:b] = [16 * r + 4 * s + t for r, s, t in zip(codes[a:b], states, states[1:], strict=False)]
                if last[a]:
                    end[b - 1] = states[-1]
            place = np.arange(batch.num_rows) - np.repeat(marks[:-1], np.diff(marks))
            cost = step_cost[kind] + np.append(close_cost, 0)[end]
            taken = [tables[n].take(pa.array(end if n in ("tail", "closing") else kind)) for n in tables]
            given = [batch.column(n) for n in ("conv_id", "chunk", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(place, pa.int32()), pa.array(cost, pa.int32()), *taken], ["conv_id", "chunk", "turn", "role", "text", "place", "cost", *tables])

    texts = ", ".join(f"{n} string" for n in [*columns, "tail", "closing"])
    done = rows.drop("row", "tie", "tie2").mapInArrow(run, f"conv_id long, chunk long, turn long, role string, text string, place int, cost int, {texts}")
    rendered = F.concat("head", template.text(F.col("text")), "tail").alias("rendered")
    return done.select("conv_id", "chunk", "place", "turn", "role", "role_out", "action", F.concat("put", "closing").alias("inserted"), "cost", rendered)


def _head(template: Template, added: tuple[int, ...], action: str, state: int, first: bool) -> str:
    """What is written before a turn's text: the end of the turn before, empty turns, and its own head or the joint of a merger."""
    out = ""
    for role in (*added, *([] if action == "merge" else [state])):
        out += ("" if first else template.tail) + (template.turn(role) if role else "")
        first = False
    return out + template.joint * (action == "merge")


def _borders(hot: DataFrame, automaton: Automaton, order: list) -> DataFrame:
    """(at_id, at_chunk, enter, leave, ends) for every chunk of the long conversations."""
    matrix = "conv_id long, chunk long, least array<bigint>"

    def over_chunks(rows: DataFrame, sum_up: Callable[[list[int], list[int]], list[int]], name: str) -> DataFrame:
        """One row a chunk: what ``sum_up`` makes of its turns and of the costs before it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, marks in _groups(batches):
                codes, enter = batch.column("code").to_pylist(), batch.column("enter").to_pylist()
                found = [sum_up(codes[a:b], enter[a]) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
                firsts = pa.array(marks[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(firsts), batch.column("chunk").take(firsts), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "chunk", name])

        rows = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", *order)
        return rows.drop("row", "turn", "tie", "tie2").mapInArrow(run, matrix.replace("least", name))

    def forward(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        rows = chain_costs([[m[STATES * a : STATES * a + STATES] for a in range(STATES)] for m in table.column("least").to_pylist()])
        costs = [pa.array(x, pa.list_(pa.int64())) for x in (rows[:-1], rows[1:])]
        return pa.table({"at_id": table.column("conv_id"), "at_chunk": table.column("chunk"), "enter": costs[0], "after": costs[1]})

    def backward(table: pa.Table) -> pa.Table:
        table = table.sort_by("at_chunk")
        leave = [automaton.last(table.column("after")[-1].as_py())]
        for came in reversed(table.column("came").to_pylist()[1:]):
            leave.append(came[leave[-1]])
        ends = [False] * (len(leave) - 1) + [True]
        return table.select(["at_id", "at_chunk", "enter"]).append_column("leave", pa.array(leave[::-1], pa.int32())).append_column("ends", pa.array(ends))

    def origins(codes: list[int], enter: list[int]) -> list[int]:
        _, back = automaton.walk(codes, enter)
        out = list(range(STATES))
        for came in reversed(back):
            out = [came[s] for s in out]
        return out

    flat = lambda codes, _: [x for row in automaton.matrix(codes) for x in row]
    least = over_chunks(hot.withColumn("enter", F.lit(None).cast("array<bigint>")), flat, "least")
    costs = land(least.groupBy("conv_id").applyInArrow(forward, "at_id long, at_chunk long, enter array<bigint>, after array<bigint>"), "costs")
    join = lambda rows: rows["conv_id"].eqNullSafe(costs["at_id"]) & (rows["chunk"] == costs["at_chunk"])
    came = over_chunks(hot.join(small_enough(costs.drop("after"), 72), join(hot)).drop("at_id", "at_chunk"), origins, "came")
    came = came.join(costs, join(came)).select("at_id", "at_chunk", "enter", "after", "came")
    return land(came.groupBy("at_id").applyInArrow(backward, "at_id long, at_chunk long, enter array<bigint>, leave int, ends boolean"), "borders")


def conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, cost, rendered): a conversation in one part, a long one (see ``repair``) in a part for each chunk, in order."""
    piece = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    joined = F.array_join(F.transform(piece, lambda p: p["rendered"]), "").alias("rendered")
    return repaired.groupBy("conv_id", F.col("chunk").alias("part")).agg(F.sum("cost").alias("cost"), joined)
