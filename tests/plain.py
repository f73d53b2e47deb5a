"""The semantics once more in plain Python, row by row, to compare with."""

import hashlib
import math

R = 6372.8 / 1.609344


def miles(a, b):
    dlat = math.radians(b["lat"] - a["lat"])
    dlon = math.radians(b["lon"] - a["lon"])
    h = math.sin(dlat / 2) ** 2 + math.sin(dlon / 2) ** 2 * math.cos(
        math.radians(a["lat"])
    ) * math.cos(math.radians(b["lat"]))
    return 2 * R * math.asin(math.sqrt(h))


def turn(a, b):
    return abs((abs(a - b) + 180) % 360 - 180)


def gated(a, b):
    if a["road"].lower() != b["road"].lower() or turn(a["bearing"], b["bearing"]) >= 60:
        return None
    return miles(a, b)


def within(a, b, r):
    d = gated(a, b)
    return d is not None and d <= r


def locations(rows):
    """One entry per place on a road, the lowest id lending its details."""
    out = {}
    for x in sorted(rows, key=lambda x: x["id"]):
        key = (x["road"].lower(), x["lat"], x["lon"])
        if key in out:
            out[key]["n"] += 1
        else:
            out[key] = dict(x, n=1)
    return sorted(out.values(), key=lambda x: x["id"])


def greedy(points, r):
    """Centre id -> [n, locations, miles]; quadratic."""
    centres = {}
    for i, p in enumerate(points):
        if i in centres:
            continue
        to = None
        for j, o in enumerate(points):
            if j != i and (j > i or j in centres) and within(p, o, r):
                to = j
                break
        if to is None:
            centres[i] = [p["n"], 1, 0.0]
        else:
            if to not in centres:
                centres[to] = [points[to]["n"], 1, 0.0]
            c = centres[to]
            c[0] += p["n"]
            c[1] += 1
            c[2] += miles(p, points[to])
    return {points[i]["id"]: v for i, v in centres.items()}


def bucket(i, n):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % n


def bucketed(points, r, n_buckets, compat=False):
    by = [[p for p in points if bucket(p["id"], n_buckets) == b] for b in range(n_buckets)]
    find = {p["id"]: p for p in points}
    rows = []
    for part in by:
        got = greedy(part, r)
        rows.append([[find[i], got[i][0], got[i][1] == 1, i] for i in sorted(got)])
    for b in range(n_buckets):
        for later in range(b + 1, n_buckets):
            for row in rows[later]:
                if not row[2]:
                    continue
                for s in rows[b]:
                    if within(row[0], s[0], r):
                        row[0], row[2] = s[0], False
                        row[1] = 1 if compat else row[1]
                        break
    out = {}
    for part in rows:
        for where, n, _, _ in part:
            out[where["id"]] = out.get(where["id"], 0) + n
    return out


COUNT = {
    "low": lambda n: max((3 - n) / 3, 0),
    "med": lambda n: max(min(n / 3, (8 - n) / 5), 0),
    "high": lambda n: 1.0 if n >= 10 else max((n - 3) / 5, 0),
}
DIST = {
    "low": lambda d: max((0.75 - d) / 0.75, 0),
    "med": lambda d: max(min((d - 0.25) / 0.75, (1.75 - d) / 0.75), 0),
    "high": lambda d: 1.0 if d >= 2.0 else max((d - 1.25) / 0.75, 0),
}


def density(n, d, rules, levels):
    w = {k: min(COUNT[k[0]](n), DIST[k[1]](d)) for k in rules}
    return sum(w[k] * levels[v] for k, v in rules.items()) / sum(w.values())


def new_sd(sd, n, dist_sum, decay, rules, levels):
    if n > 0:
        k = min(max(density(n, dist_sum / n, rules, levels), 0.01), 1.0)
        fresh = 0.15 + (1 - k) * 2.6
        raw = fresh if sd is None else (0.5 * sd + fresh) / 1.5
    else:
        raw = min((1.0 if sd is None else sd) * (1 + decay), 2.75)
    return math.floor(raw * 100 + 0.5) / 100, "DENSE" if raw < 1.45 else "SPARSE"


def sampled(rows, percent):
    k = len(rows) * percent // 100
    order = sorted(rows, key=lambda x: hashlib.md5(str(x["id"]).encode()).hexdigest())
    return order[:k], order[k:]


def place(x):
    return (x["road"].lower(), x["lat"], x["lon"])


def step(state, rows, p, fuzzy=None):
    """`state`: place -> record with id, fitness, age (sd). Returns the next
    state; `fuzzy` holds rules and levels."""
    known = state
    out = {k: dict(v, fitness=v["fitness"] * (1 - p.decay_rate), age=v["age"] + 1, add=[0, 0.0])
           for k, v in state.items()}
    if not state and p.seed_when_empty:
        seeds, rows = sampled(rows, p.seed_percent)
        locs = locations(seeds)
        found = greedy(locs, p.cluster_miles)
        for x in locs:
            if x["id"] in found:
                n, k, m = found[x["id"]]
                out[place(x)] = dict(x, fitness=float(n), age=1, sd=None, add=[k, m])
        known = {k: dict(v) for k, v in out.items()}
    left = []
    for x in sorted(rows, key=lambda x: x["id"]):
        if fuzzy:
            hit = False
            for k, h in known.items():
                d = gated(x, h)
                if d is None or d > p.radius_miles:
                    continue
                mu = min(math.exp(-0.5 * (d / (h["sd"] or 1.0)) ** 2), 1.0)
                if mu >= p.conf_threshold:
                    hit = True
                    out[k]["fitness"] += mu * p.incident_weight
                    out[k]["add"][0] += 1
                    out[k]["add"][1] += d
            if not hit:
                left.append(x)
            continue
        best = [(gated(x, h), h["id"], k) for k, h in known.items() if within(x, h, p.radius_miles)]
        if best:
            out[min(best)[2]]["fitness"] += p.incident_weight
        else:
            left.append(x)
    locs = locations(left)
    found = greedy(locs, p.cluster_miles)
    for x in locs:
        if x["id"] not in found:
            continue
        n, k, m = found[x["id"]]
        at = out.setdefault(place(x), dict(x, fitness=0.0, age=1, sd=None, add=[0, 0.0]))
        at["fitness"] += n * p.incident_weight
        at["add"] = [at["add"][0] + k, at["add"][1] + m]
    if fuzzy:
        for v in out.values():
            v["sd"], v["label"] = new_sd(v["sd"], *v["add"], p.decay_rate, *fuzzy)
    return {k: v for k, v in out.items() if v["fitness"] >= p.delete_threshold}
