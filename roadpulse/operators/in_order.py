"""The in-order pass over one bounded group, run inside a task."""

import math

import numpy as np

EARTH_MILES = 6372.8 / 1.609344  # fixed value
BEARING_LIMIT = 60  # fixed value


def cells(lat, lon, radius):
    """Band of latitude and column of longitude of each place, and the number of
    columns around the globe. Both are at least as wide as the radius spans
    anywhere in the group, so what lies within it is in the same cell or next."""
    slack = 1 + 1e-9
    bands = np.floor((lat + 90.0) / (math.degrees(radius / EARTH_MILES) * slack)).astype(int)
    flattest = max(math.cos(math.radians(np.abs(lat).max())), 1e-12)
    chord = math.sin(min(radius / (2 * EARTH_MILES), math.pi / 2))
    width = math.degrees(math.asin(min(chord / flattest, 1.0))) * 2 * slack
    around = int(360.0 // width)
    around = around if around >= 3 else 1
    columns = np.minimum(np.mod(lon + 180.0, 360.0) / 360.0 * around, around - 1).astype(int)
    return bands.tolist(), columns.tolist(), around


class Nearby:
    """The locations of a group, and which of some are near one of them."""

    def __init__(self, lat, lon, bearing, radius):
        self.phi, self.lam = np.radians(lat), np.radians(lon)
        self.cos_phi = np.cos(self.phi)
        self.bearing, self.radius = bearing, radius
        self.bands, self.columns, self.around = cells(lat, lon, radius)
        self.at = list(zip(self.bands, self.columns, strict=True))
        self.sides = (-1, 0, 1) if self.around > 1 else (0,)

    def of(self, i, pool):
        """Locations of a pool (by cell) within the radius of i, and the miles."""
        found = []
        for b in (self.bands[i] - 1, self.bands[i], self.bands[i] + 1):
            for s in self.sides:
                found += pool.get((b, (self.columns[i] + s) % self.around), ())
        if not found:
            return found, ()
        j = np.array(found)
        turn = np.abs((np.abs(self.bearing[j] - self.bearing[i]) + 180) % 360 - 180)
        a = (
            np.sin((self.phi[j] - self.phi[i]) / 2) ** 2
            + np.sin((self.lam[j] - self.lam[i]) / 2) ** 2 * self.cos_phi[j] * self.cos_phi[i]
        )
        d = 2 * EARTH_MILES * np.arcsin(np.sqrt(a))
        hit = (turn < BEARING_LIMIT) & (d <= self.radius)
        return j[hit], d[hit]


WAITS, CENTRE = 1, 2  # roles; 0 joins another
STANDS = 1


def settle(lat, lon, bearing, radius, covered=None, given=None):
    """Where each location goes, the miles there, and its role when it was read.

    The locations come in order. Only centres and locations still waiting for a
    later neighbour are compared with, kept by cell. A location
    that ends waiting goes to itself. A `covered` one has an earlier centre
    outside the group: it can only be called on by one that waits, and goes
    nowhere (-1) otherwise. A role that is `given` (not negative) is taken as it
    is; the location is still what earlier ones call on.
    """
    near = Nearby(lat, lon, bearing, radius)
    at = near.at
    n = len(lat)
    target, miles, role = np.arange(n), np.zeros(n), np.zeros(n, dtype=np.int32)
    centres: dict[tuple[int, int], list[int]] = {}
    waiting: dict[tuple[int, int], list[int]] = {}

    for i in range(n):
        callers, away = near.of(i, waiting)
        if len(callers):  # the first later neighbour of each of these
            target[callers], miles[callers] = i, away
            for k in callers:
                waiting[at[k]].remove(k)
        if given is not None and given[i] >= 0:
            role[i] = given[i]
            if given[i]:
                (centres if given[i] == CENTRE else waiting).setdefault(at[i], []).append(i)
            continue
        if len(callers):
            centres.setdefault(at[i], []).append(i)
            role[i] = CENTRE
            continue
        if covered is not None and covered[i]:
            target[i] = -1
            continue
        known, away = near.of(i, centres)
        if len(known):
            first = int(np.argmin(known))
            target[i], miles[i] = known[first], away[first]
        else:
            waiting.setdefault(at[i], []).append(i)
            role[i] = WAITS
    return target, miles, role


def suppress(lat, lon, bearing, radius, bucket, lone, given=None):
    """Where each location goes, the miles there, and whether it stands (role).

    The locations come in order of their buckets. A lone one goes to the first
    location of an earlier bucket that stands within the radius.
    """
    near = Nearby(lat, lon, bearing, radius)
    n = len(lat)
    target, miles, role = np.arange(n), np.zeros(n), np.zeros(n, dtype=np.int32)
    standing: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        stands = True
        if given is not None and given[i] >= 0:
            stands = given[i] == STANDS
        elif lone[i]:
            known, away = near.of(i, standing)
            earlier = [k for k, j in enumerate(known) if bucket[j] < bucket[i]]
            if earlier:
                first = min(earlier, key=lambda k: known[k])
                target[i], miles[i], stands = known[first], away[first], False
        if stands:
            standing.setdefault(near.at[i], []).append(i)
            role[i] = STANDS
    return target, miles, role


def group_starts(frame, groups):
    """First positions of the groups of a sorted frame."""
    keys = frame[groups]
    return np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())


def suppress_groups(frame, groups, radius, given=None):
    """`suppress` for every group of a frame sorted by `groups`, then bucket and
    seq; positions are those of the whole frame."""
    n = len(frame)
    target, miles, role = np.arange(n), np.zeros(n), np.zeros(n, dtype=np.int32)
    columns = [frame[c].to_numpy() for c in ("lat", "lon", "bearing", "bucket_id", "lone")]
    starts = group_starts(frame, groups)
    for a, b in zip(starts, [*starts[1:], n]):
        lat, lon, bearing, bucket, lone = (c[a:b] for c in columns)
        told = None if given is None else given[a:b]
        t, miles[a:b], role[a:b] = suppress(lat, lon, bearing, radius, bucket, lone, told)
        target[a:b] = t + a
    return target, miles, role


def settle_groups(frame, groups, radius, covered=None, given=None):
    """`settle` for every group of a frame sorted by `groups` and then seq;
    positions are those of the whole frame."""
    n = len(frame)
    lat, lon = frame["lat"].to_numpy(), frame["lon"].to_numpy()
    bearing = frame["bearing"].to_numpy()
    target, miles, role = np.arange(n), np.zeros(n), np.full(n, WAITS, dtype=np.int32)
    starts = group_starts(frame, groups)
    for a, b in zip(starts, [*starts[1:], n]):
        if b - a == 1 and given is None:
            if covered is not None and covered[a]:
                target[a], role[a] = -1, 0
            continue
        part = slice(a, b)
        hidden = None if covered is None else covered[part]
        told = None if given is None else given[part]
        t, miles[part], role[part] = settle(lat[part], lon[part], bearing[part], radius, hidden, told)
        target[part] = np.where(t >= 0, t + a, -1)
    return target, miles, role


# Pairs that are looked at in one go, and how far around the radius a pair is
# left to the exact check.
PAIRS = 500_000
CLOSE = 1e-9


def look_ahead(spans, held, keys, order, bound, radius):
    """Positions in `spans` and `held` of pairs within the radius: for every span
    the first row of its group after it, up to its bound if it has one. Pairs too
    close to the radius to tell come along, and do not end the search."""
    k, m = len(spans), len(held)
    if not k or not m:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    group = [f["group_id"].to_numpy() for f in (spans, held)]
    columns = [np.concatenate([held[c].to_numpy(), spans[c].to_numpy(), spans[b].to_numpy()]) for c, b in zip(order, bound)]
    columns.insert(0, np.concatenate([group[1], group[0], group[0]]))
    sorted_rows = np.lexsort(columns[::-1])
    steps = np.zeros(m + 2 * k, dtype=bool)
    for c in columns:
        c = c[sorted_rows]
        steps[1:] |= c[1:] != c[:-1]
    code = np.empty(m + 2 * k, dtype=np.int64)
    code[sorted_rows] = np.cumsum(steps)
    row = np.argsort(code[:m], kind="stable")
    in_turn = code[:m][row]
    at = np.searchsorted(in_turn, code[m : m + k], "right")
    end = np.searchsorted(in_turn, code[m + k :], "right")
    open_end = np.searchsorted(group[1][row], group[0], "right")
    end = np.where(spans["bounded"].to_numpy(dtype=bool), end, open_end)

    lat, lon, way = (held[c].to_numpy()[row] for c in ("lat", "lon", "bearing"))
    lat0, lon0, way0 = (spans[c].to_numpy() for c in ("lat", "lon", "bearing"))
    cos, cos0 = np.cos(np.radians(lat)), np.cos(np.radians(lat0))
    names = [(spans[c].to_numpy(), held[c].to_numpy()[row]) for c in keys]
    found = []
    todo, width = np.flatnonzero(at < end), 16
    while len(todo):
        left = []
        for a in range(0, len(todo), max(1, PAIRS // width)):
            some = todo[a : a + max(1, PAIRS // width)]
            take = np.minimum(end[some] - at[some], width)
            i = np.repeat(some, take)
            j = np.arange(len(i)) + np.repeat(at[some] - (np.cumsum(take) - take), take)
            turn = np.abs((np.abs(way0[i] - way[j]) + 180) % 360 - 180)
            ahead = turn < BEARING_LIMIT
            i, j = i[ahead], j[ahead]
            h = (
                np.sin(np.radians(lat[j] - lat0[i]) / 2) ** 2
                + np.sin(np.radians(lon[j] - lon0[i]) / 2) ** 2 * cos0[i] * cos[j]
            )
            d = np.arcsin(np.sqrt(h)) * 2 * EARTH_MILES
            hit = d <= radius * (1 + CLOSE)
            i, j, d = i[hit], j[hit], d[hit]
            for own, other in names:
                same = own[i] == other[j]
                i, j, d = i[same], j[same], d[same]
            sure = d <= radius * (1 - CLOSE)
            done, first = np.unique(i[sure], return_index=True)
            found.append((i[~sure], j[~sure]))
            found.append((done, j[sure][first]))
            at[some] += take
            some = some[at[some] < end[some]]
            left.append(some[~np.isin(some, done)])
        todo, width = np.concatenate(left), min(2 * width, 4096)
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    return np.concatenate([f[0] for f in found]), row[np.concatenate([f[1] for f in found])]
