"""State machines over ordered events: scans of runs, and functions from states to states where a run is cut.

An event is a function from states to states, kept as an array. A run is read in order, once, in one task; one that is too large for
that is cut into chunks (``plans.scan``), of which each is a function from states to states, too. These functions, one for a chunk,
are folded in order and give every chunk the state that it begins with, so that a run that holds a third of all rows is spread
like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.plans.scan import begins, chunked, sorted_groups
from lakewright.session import checkpointed


@dataclass(frozen=True)
class Machine:
    """``states``: names; ``steps``: for each event the next state of each state, and whether the event is legal there; ``counts``: by
    name the events of which the legal ones are counted along a run."""

    states: list[str]
    steps: dict[str, tuple[list[int], list[bool]]]
    counts: dict[str, list[str]] = field(default_factory=dict)

    def number(self, event: Column) -> Column:
        """The place of an event among ``steps``; one more than the last for events that aren't known."""
        out = F.lit(len(self.steps))
        for i, name in enumerate(self.steps):
            out = F.when(event == name, F.lit(i)).otherwise(out)
        return out

    def tables(self) -> tuple[list[list[int]], list[list[bool]], list[list[list[int]]]]:
        """Next states and legality by event and state, unknown events last, and for each count what an event adds."""
        moves = [m for m, _ in self.steps.values()] + [list(range(len(self.states)))]
        legal = [ok for _, ok in self.steps.values()] + [[False] * len(self.states)]
        adds = [[[int(ok) for ok in row] if name in counted else [0] * len(row) for name, row in zip([*self.steps, None], legal, strict=True)] for counted in self.counts.values()]
        return moves, legal, adds


def _read(machine: Machine, keys: list[str], start: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of sorted runs, or chunks, with the states around each event, whether it is legal, and the counts up to it."""
    moves, legal, adds = machine.tables()
    names = list(machine.counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, counts, last = start, [0] * len(adds), None
        for batch in batches:
            rows = pa.table(batch)
            # A group that goes on from the batch before isn't new: its last row is looked at again.
            both = rows.select(keys) if last is None else pa.concat_tables([last, rows.select(keys)])
            new = np.zeros(rows.num_rows + (last is not None), bool)
            new[begins(both, keys)] = True
            new = new[last is not None :].tolist()
            last = rows.select(keys).slice(rows.num_rows - 1) if rows.num_rows else last
            before, ok, sums = [], [], [[] for _ in adds]
            held = [rows.column(c).to_pylist() for c in ("__state", *[f"__from_{n}" for n in names])]
            for i, e in enumerate(rows.column("__event_no").to_pylist()):
                if new[i]:
                    state = start if held[0][i] is None else held[0][i]
                    counts = [h[i] or 0 for h in held[1:]]
                before.append(state)
                ok.append(legal[e][state])
                for k, add in enumerate(adds):
                    counts[k] += add[e][state]
                    sums[k].append(counts[k])
                state = moves[e][state]
            rows = rows.drop_columns([*keys, "__event_no", "__state", *[f"__from_{n}" for n in names]])
            after = np.array(moves, np.int32)[batch.column("__event_no").to_numpy(), np.array(before, np.int64)] if len(before) else []
            for name, v, kind in (("before", before, pa.int32()), ("after", after, pa.int32()), ("legal", ok, pa.bool_()), *[(n, v, pa.int64()) for n, v in zip(names, sums, strict=True)]):
                rows = rows.append_column(name, pa.array(v, kind))
            yield from rows.to_batches()

    return read


def _functions(machine: Machine, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk: the state that it leads to from each state, and for each count what it adds from there."""
    moves, _, adds = (np.array(t, np.int64) for t in machine.tables())

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, sums = None, None, None

        def done() -> pa.RecordBatch:
            named = {c: key.column(c) for c in keys} | {"f": pa.array([state.tolist()], pa.list_(pa.int32()))}
            return pa.table(named | {f"a{k}": pa.array([v.tolist()], pa.list_(pa.int64())) for k, v in enumerate(sums)}).combine_chunks().to_batches()[0]

        for batch in batches:
            rows = pa.table(batch)
            both = rows.select(keys) if key is None else pa.concat_tables([key, rows.select(keys)])
            new = set((begins(both, keys) - (key is not None)).tolist())
            for i, e in enumerate(rows.column("__event_no").to_pylist()):
                if i in new:
                    if key is not None:
                        yield done()
                    key, state, sums = rows.select(keys).slice(i, 1), np.arange(len(machine.states)), np.zeros((len(adds), len(machine.states)), np.int64)
                for k in range(len(adds)):
                    sums[k] += adds[k, e, state]
                state = moves[e, state]
        if key is not None:
            yield done()

    return functions


def run(events: DataFrame, by: str, order: list[str], event: str, machine: Machine, start: int = 0) -> DataFrame:
    """The events with ``before`` and ``after``, the numbers of the states around each, ``legal`` and the machine's counts after each.

    ``order`` must be unique in a run; a null ``by`` is a run of its own. Events that the machine doesn't know, null ones too, change
    nothing and aren't legal. An empty table gives no rows."""
    row = [F.col(c).alias(f"__r{i}") for i, c in enumerate(events.columns)]
    given = events.select(*row, F.col(by).alias("__by"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], machine.number(F.col(event)).alias("__event_no"))
    keys, at = ["__by", "__chunk"], [f"__o{i}" for i in range(len(order))]
    dealt, large = chunked(given, ["__by"], at)
    kind = events.schema[by].dataType
    froms = ["__state", *[f"__from_{n}" for n in machine.counts]]
    if large:
        size = dealt.groupBy("__by").agg(F.max("__chunk").alias("__most")).where("__most > 0").select(F.col("__by").alias("__b"))
        cut = dealt.join(F.broadcast(size), F.col("__by").eqNullSafe(F.col("__b"))).select(*keys, *at, "__event_no")
        schema = T.StructType([T.StructField("__by", kind), T.StructField("__chunk", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))] + [T.StructField(f"a{k}", T.ArrayType(T.LongType())) for k in range(len(machine.counts))])
        each = checkpointed(sorted_groups(cut, keys, at).mapInArrow(_functions(machine, keys), schema))
        # What a run's chunks lead to, in order: from the state and counts in front of one to those in front of the next.
        step = F.struct("__chunk", "f", *[f"a{k}" for k in range(len(machine.counts))])
        zero = F.struct(F.lit(start).cast("int").alias("s"), F.array(*[F.lit(0).cast("long") for _ in machine.counts]).cast("array<bigint>").alias("n"), F.array().cast("array<struct<c:int,s:int,n:array<bigint>>>").alias("out"))

        def fold(acc: Column, x: Column) -> Column:
            seen = F.struct(x["__chunk"].alias("c"), acc["s"].alias("s"), acc["n"].alias("n"))
            counts = F.array(*[F.get(acc["n"], F.lit(k)) + F.get(x[f"a{k}"], acc["s"]) for k in range(len(machine.counts))]).cast("array<bigint>")
            return F.struct(F.get(x["f"], acc["s"]).cast("int").alias("s"), counts.alias("n"), F.concat(acc["out"], F.array(seen)).alias("out"))

        folded = each.groupBy("__by").agg(F.array_sort(F.collect_list(step)).alias("steps")).select(F.col("__by").alias("__b"), F.explode(F.aggregate("steps", zero, fold, lambda acc: acc["out"])).alias("e"))
        known = checkpointed(folded.select("__b", F.col("e.c").alias("__c"), F.col("e.s").alias("__state"), *[F.get("e.n", F.lit(k)).alias(f"__from_{n}") for k, n in enumerate(machine.counts)]))
        dealt = dealt.join(F.broadcast(known), F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__chunk") == F.col("__c")), "left").drop("__b", "__c")
    else:
        dealt = dealt.select("*", F.lit(None).cast("int").alias("__state"), *[F.lit(None).cast("long").alias(c) for c in froms[1:]])
    ready = sorted_groups(dealt, keys, at).select(*[f"__r{i}" for i in range(len(events.columns))], *keys, "__event_no", *froms)
    own = [T.StructField(f"__r{i}", f.dataType) for i, f in enumerate(events.schema.fields)]
    found = T.StructType(own + [T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("legal", T.BooleanType())] + [T.StructField(n, T.LongType()) for n in machine.counts])
    out = ready.mapInArrow(_read(machine, keys, start), found)
    return out.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(events.columns)], "before", "after", "legal", *machine.counts)


#: Phases of a turn, in order, and its two ends.
PHASES = ["observe", "orient", "decide", "act", "verify", "rollback", "done"]


def turns(cap: int, max_steps: int) -> Machine:
    """The machine of observe, orient, decide, act and verify turns that asks for a rollback after ``cap`` failures in a row.

    Events: orient, decide, act, act_mutating (which waits for checkpointed before its end), checkpointed, ok and fail (the end of
    an act; ok sets failures to 0), verify, recovered (after a rollback; failures 0) and finish. A verify that comes when ``max_steps``
    acts have ended ends the run. A state is a phase, whether a checkpoint is awaited, the failures in a row, and the acts ended, of
    which no more than ``max_steps`` are told apart; all of them are counted as ``step``, and checkpoints as ``checkpoints``."""
    most, budget = max(cap, 1), max(max_steps, 0)
    keys = [(p, w, n, d) for p in range(len(PHASES)) for w in (0, 1) for n in range(most + 1) for d in range(budget + 1)]
    number = {k: i for i, k in enumerate(keys)}
    at = {name: i for i, name in enumerate(PHASES)}

    def step(event: str, p: int, w: int, n: int, d: int) -> tuple[int, int, int, int] | None:
        moves = {"orient": ("observe", "orient"), "decide": ("orient", "decide"), "act": ("decide", "act"), "act_mutating": ("decide", "act"), "verify": ("verify", "observe"), "recovered": ("rollback", "observe")}
        if event == "finish" or event == "verify" and d >= budget:
            return at["done"], w, n, d
        if event in moves:
            if p != at[moves[event][0]]:
                return None
            return at[moves[event][1]], 1 if event == "act_mutating" else w, 0 if event == "recovered" else n, d
        if event == "checkpointed":
            return (p, 0, n, d) if w else None
        if w or p != at["act"]:
            return None
        ended = min(d + 1, budget)
        if event == "ok":
            return at["verify"], w, 0, ended
        failed = min(n + 1, most)
        return at["rollback" if failed >= cap else "verify"], w, failed, ended

    steps = {}
    for event in ("orient", "decide", "act", "act_mutating", "checkpointed", "ok", "fail", "verify", "recovered", "finish"):
        found = [step(event, *k) for k in keys]
        steps[event] = ([number[f] if f else i for i, f in enumerate(found)], [f is not None for f in found])
    return Machine([f"{PHASES[p]} {w} {n}" for p, w, n, _ in keys], steps, {"step": ["ok", "fail"], "checkpoints": ["checkpointed"]})


def run_turns(events: DataFrame, by: str, order: list[str], event: str, max_steps: int = 64, cap: int = 3) -> DataFrame:
    """The events with phase, awaiting, failures, step and checkpoints after each, and whether it was legal.

    The budget of ``max_steps`` ended acts is spent at the first verify event that comes with that many: from there on a verify ends
    the run."""
    machine = turns(cap, max_steps)
    out = run(events, by, order, event, machine)
    state = F.split(F.get(F.lit(machine.states), F.col("after")), " ")
    return out.select(*events.columns, state[0].alias("phase"), (state[1] == "1").alias("awaiting"), state[2].cast("long").alias("failures"), "step", "checkpoints", "legal")
