"""The turn machine against a plain simulation, row by row."""

import random

from lakewright.operators import machines

SCHEMA = "run string, at long, event string, note map<string,string>"
EVENTS = ["orient", "decide", "act", "act_mutating", "checkpointed", "ok", "fail", "verify", "recovered", "finish", None, "other"]
MOVES = {"orient": ("observe", "orient"), "decide": ("orient", "decide"), "act": ("decide", "act"), "act_mutating": ("decide", "act"), "recovered": ("rollback", "observe")}


def simulate(events, max_steps, cap):
    phase, waiting, failures, step, kept = "observe", False, 0, 0, 0
    for e in events:
        legal = True
        if e == "verify" and step >= max_steps:
            phase = "done"
        elif e == "verify":
            legal = phase == "verify"
            phase = "observe" if legal else phase
        elif e in MOVES:
            legal = phase == MOVES[e][0]
            if legal:
                phase = MOVES[e][1]
                waiting = waiting or e == "act_mutating"
                failures = 0 if e == "recovered" else failures
        elif e == "checkpointed":
            legal = waiting
            kept, waiting = kept + legal, False
        elif e == "finish":
            phase = "done"
        elif e in ("ok", "fail"):
            legal = phase == "act" and not waiting
            if legal:
                step += 1
                failures = 0 if e == "ok" else failures + 1
                phase = "rollback" if e == "fail" and failures >= cap else "verify"
        else:
            legal = False
        yield phase, waiting, failures, step, kept, legal


def likely(r, n, finish=0.0):
    """Mostly legal events, for long walks."""
    out = []
    while len(out) < n:
        out += ["orient", "decide"] + r.choice((["act"], ["act_mutating", "checkpointed"], ["act_mutating"])) + [r.choice(("ok", "fail", "fail"))] + r.choice((["verify"], ["verify"], ["recovered"], []))
        if r.random() < 0.3:
            out.append(r.choice(EVENTS[:9] + EVENTS[10:]))
        if r.random() < finish:
            out.append("finish")
    return out[:n]


def test_turns(spark):
    r = random.Random(4)
    runs = {f"r{k}": likely(r, r.choice((1, 5, 63, 64, 65, 200)), 0.02) for k in range(25)} | {"long": likely(r, 5000), None: likely(r, 70), "noise": [r.choice(EVENTS) for _ in range(300)]}
    rows = [(k, i, e, {"x": "y"}) for k, events in runs.items() for i, e in enumerate(events)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for most, cap in ((64, 3), (5, 1)):
        got = {(x["run"], x["at"]): (x["phase"], x["awaiting"], x["failures"], x["step"], x["checkpoints"], x["legal"]) for x in machines.run_turns(df, "run", ["at"], "event", most, cap).collect()}
        assert got == {(k, i): s for k, events in runs.items() for i, s in enumerate(simulate(events, most, cap))}
    assert machines.run_turns(df.limit(0), "run", ["at"], "event").count() == 0


def test_cut_runs(spark, monkeypatch):
    """Runs of more than a chunk are cut, and give what they give whole; a run of another size beside them doesn't change."""
    from lakewright.plans import scan

    monkeypatch.setattr(scan, "CHUNK", 400)
    monkeypatch.setattr(scan, "SAMPLE", 100)
    r = random.Random(5)
    runs = {"long": likely(r, 3000), None: likely(r, 900), "short": likely(r, 200), "noise": [r.choice(EVENTS) for _ in range(1500)]}
    df = spark.createDataFrame([(k, i, e, {"x": "y"}) for k, events in runs.items() for i, e in enumerate(events)], SCHEMA)
    assert scan.chunked(df, ["run"], ["at"])[0].select("run", "__chunk").distinct().count() > 12
    for most, cap in ((300, 3), (5, 1)):
        got = {(x["run"], x["at"]): (x["phase"], x["awaiting"], x["failures"], x["step"], x["checkpoints"], x["legal"]) for x in machines.run_turns(df, "run", ["at"], "event", most, cap).collect()}
        assert got == {(k, i): s for k, events in runs.items() for i, s in enumerate(simulate(events, most, cap))}
