"""A plain loop over recorded polls, to compare the window-function form with.

Written from the described semantics; test code only, it never runs on a cluster.
"""

from __future__ import annotations

from phasebeat.functions.lasso import fit_points
from phasebeat.operators.replay import synthetic_points

RES = 2


def number(s):
    try:
        x = float(s)
    except ValueError:
        return None
    return x if x == x and abs(x) != float("inf") else None


def fields(line):
    parts = line.split(",")
    return [number(p) for p in parts] if len(parts) == RES else [None] * RES


class Loop:
    def __init__(self, settings):
        self.s = settings
        self.db = {}
        self.confidence = 0
        self.terms = [[], []]

    def predict(self, key, prev2, prev1):
        entry = self.db.get(key)
        if key == "":
            return [0.0] * RES, False
        if entry is None:
            return prev1, False
        model = entry["model"]
        if self.s.algo == "simple" or model is None:
            return prev1, True
        if self.s.algo == "agg":
            return (model if any(model) else prev1), True
        return [m[0] * a + m[1] * b + m[2] for m, a, b in zip(model, prev2, prev1)], True

    def score(self, key, seen, predicted, actual):
        fix = lambda v: v if v != 0 else 0.001
        error = sum(abs((fix(p) - fix(a)) / fix(p)) for p, a in zip(predicted, actual)) / RES * 100
        step = 0
        if key != "":
            bad = error > self.s.mape_limit if seen else actual[0] < self.s.cpu_floor
            step = 1 if bad else -1
        self.confidence += step
        now = [100 - 100 * sum(t) / len(t) if t else None for t in self.terms]
        for t, a, p in zip(self.terms, actual, predicted):
            t.append(abs(a - p) / (abs(a) + abs(p) + 1e-8))
        if self.s.variant == "v2":
            now = [100 - 100 * sum(t) / len(t) for t in self.terms]
        return error, step, now

    def fit(self, key, entry):
        old, batch, entry["batch"] = entry["model"], entry["batch"], []
        entry["version"] += 1
        if self.s.algo == "lasso":
            import hashlib

            name = hashlib.md5(key.encode()).hexdigest()
            entry["model"] = []
            for k in range(RES):
                pts = [p[k] for p in batch]
                if old is not None and self.s.replay:
                    pts = pts + synthetic_points(name, entry["version"], k, old[k], self.s.replay, self.s.seed)
                entry["model"].append(fit_points(pts, self.s.alpha))
        elif self.s.algo == "agg" and self.s.variant == "v1":
            before = old or [0.0] * RES
            entry["model"] = [
                (sum(p[k][0] + p[k][1] for p in batch) + before[k]) / (2 * len(batch) + 1) for k in range(RES)
            ]

    def learn(self, key, prev2, prev1, actual, first):
        if key == "":
            return
        profile = [(prev2[k], prev1[k], actual[k]) for k in range(RES)]
        if self.s.variant == "v1":
            if first:
                return
            entry = self.db.get(key)
            if entry is None:
                self.db[key] = {"batch": [profile], "model": None, "version": 0}
            elif len(entry["batch"]) < self.s.batch_size:
                entry["batch"].append(profile)
            else:
                self.fit(key, entry)
            return
        entry = self.db.setdefault(key, {"batch": [], "model": None, "version": 0})
        entry["batch"].append(profile)
        if len(entry["batch"]) == self.s.batch_size:
            self.fit(key, entry)


def snapshots(polls, workers, variant):
    """polls: [(tick, {worker: (line, [function line])})]; yields (tick, values or None, plain set, counted set)."""
    last = {w: [0.0] * RES for w in workers}
    for tick, said in polls:
        total, broken, funcs = [0.0] * RES, False, []
        for w in sorted(workers):
            line, lines = said.get(w, ("0,0", []))
            funcs += lines
            for k, v in enumerate(fields(line)):
                if k >= RES:
                    break
                if v is None:
                    broken = True
                    v = last[w][k]
                last[w][k] = v
                total[k] += v
        values = [round(t, 9) / len(workers) for t in total]
        counted = {f.strip() for f in funcs}
        plain = {f.split("***")[0] for f in counted}
        yield tick, (None if broken and variant == "v1" else values), plain, counted


def evaluate(polls, workers, settings, loops=None, name=None):
    """One run; with ``loops`` it goes on from the phases and snapshots that the last run of that name left."""
    loop, ring = Loop(settings), None
    if loops is not None and name in loops:
        loop.db, ring = loops[name]
    out, zero = [], ([0.0] * RES, set(), set())
    if ring is None or settings.variant == "v1":
        ring = [zero, zero]
    held, first = [], True
    for tick, values, plain, counted in snapshots(polls, workers, settings.variant):
        if values is None:
            held = []
            continue
        held.append((values, plain, counted))
        if len(held) < settings.stride:
            continue
        history = ring + held
        prev2, prev1, curr = history[-3], history[-2], history[-1]
        ring, held = history[-2:], []
        a, b = (prev1[2], curr[2]) if settings.variant == "v1" else (prev1[1], curr[1])
        larger = max(len(a), len(b))
        change = larger > 0 and len(a & b) / larger < settings.threshold
        names = curr[1] if change else prev1[1] & curr[1]
        key = "".join(n + "->" for n in sorted(names))
        predicted, seen = loop.predict(key, prev2[0], prev1[0])
        error, step, acc = loop.score(key, seen, predicted, curr[0])
        loop.learn(key, prev2[0], prev1[0], curr[0], first)
        first = False
        out.append(
            dict(tick=tick, phase=key, seen=seen, cpu=curr[0][0], mem=curr[0][1], predicted_cpu=predicted[0],
                 predicted_mem=predicted[1], mape=error, step=step, confidence=loop.confidence,
                 acc_cpu=acc[0], acc_mem=acc[1])
        )
    if loops is not None:
        loops[name] = loop.db, (ring + held)[-2:]
    return out
