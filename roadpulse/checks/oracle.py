"""The same answers in plain SQL, written independently of the operators."""

from __future__ import annotations

from roadpulse.checks import queries as q
from roadpulse.checks.inputs import BEARING, LAT, LON

# The rule tables once more, by count term and distance term.
LEVELS = {"VL": 0.1, "L": 0.35, "M": 0.55, "H": 0.75, "VH": 1.0}
RULE_TEXT = {
    "tight": "med low H, high low VH, low med VL, med med L, high med L, low high VL,"
    " med high VL, high high L",
    "initial": "low low M, med low H, high low VH, low med L, med med M, high med H,"
    " low high VL, med high L, high high M",
}
RULES = {
    base: {(r[0], r[1]): r[2] for r in (rule.split() for rule in text.split(","))}
    for base, text in RULE_TEXT.items()
}

ROAD = "concat(case when event_id % 3 = 0 then 'm' else 'M' end, cast(user_id % 4 as varchar))"


def inc(days: int = 1) -> str:
    return f"""select event_id as incident_id, event_id as seq,
  cast(floor((day(ts) - 1) / {days}) + 1 as int) as interval_id,
  {LAT} as lat, {LON} as lon, {BEARING} as bearing, {ROAD} as road,
  lower({ROAD}) as road_key, ts from events"""


def hs(per_degree: int = 5) -> str:
    by = f"partition by road_key, floor(lat * {per_degree}), bearing >= 180"
    return f"""select incident_id as hs_id, road_key, road, lat, lon, bearing, fitness, 1 as age, sd from (
  select *, cast(count(*) over w as double) as fitness,
    cast(0.5 + (incident_id % 4) * 0.5 as double) as sd,
    row_number() over ({by} order by incident_id) as rn
  from inc window w as ({by})) t
where rn = 1"""


HS = hs()

STATE = f"""select event_id as hs_id, lower({ROAD}) as road_key, {ROAD} as road, {LAT} as lat,
  {LON} as lon, {BEARING} as bearing, value as fitness, cast(user_id % 9 as int) as age,
  case when event_id % 7 = 0 then null else cast(15 + event_id % 261 as double) / 100 end as sd,
  cast(event_id % 13 as bigint) as n_added,
  cast(event_id % 13 as double) * ((event_id * 31) % 250) / 100 as dist_sum from events"""


def delta(a: str, b: str) -> str:
    return f"abs((abs({a}.bearing - {b}.bearing) + 180) % 360 - 180)"


def miles(a: str, b: str) -> str:
    return (
        f"(2 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
        f" * cos(radians({a}.lat)) * cos(radians({b}.lat)))) * (6372.8 / 1.609344))"
    )


def gate(a: str, b: str, r: float) -> str:
    return f"{a}.road_key = {b}.road_key and {delta(a, b)} < 60 and {miles(a, b)} <= {r}"


def member(m: str, sd: str, top: float) -> str:
    return (
        f"(case when {m} <= {top} then"
        f" least(exp(-0.5 * pow({m} / coalesce({sd}, 1.0), 2)), 1.0) else 0.0 end)"
    )


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} as materialized ({sql})" for name, sql in ctes)
    return f"with recursive {body}\n{final}"


def over_inc(final: str, days: int = 1) -> str:
    return with_([("inc", inc(days)), ("hs", HS)], final)


def over_state(final: str, *more: tuple[str, str]) -> str:
    return with_([("s", STATE), *more], final)


# --- stage 1 ------------------------------------------------------------------


def nearest(prefix: str, batch: str, state: str, r: float, order: str = "m, hs_id"):
    return [
        (
            f"{prefix}_as",
            f"""select i.*, p.hs_id, p.m, p.hs_lat, p.hs_lon from {batch} i left join (
    select i.incident_id, h.hs_id, h.lat as hs_lat, h.lon as hs_lon, {miles("i", "h")} as m,
      row_number() over (partition by i.incident_id order by {order}) as rn
    from {batch} i join {state} h on {gate("i", "h", r)}) p
  on p.incident_id = i.incident_id and p.rn = 1""",
        ),
        (f"{prefix}_loc", locations(f"(select * from {prefix}_as where hs_id is null)")),
    ]


def locations(batch: str) -> str:
    return f"""select min(seq) as seq, road_key, arg_min(road, seq) as road, lat, lon,
  arg_min(bearing, seq) as bearing, cast(count(*) as bigint) as n
  from {batch} group by road_key, lat, lon"""


# --- stage 2 ------------------------------------------------------------------

# Places lie further apart than any radius used here and the two directions
# never meet, so the pass may run place by place.
PLACE = "road_key || '/' || floor(lat * 5) || '/' || (bearing >= 180)"


def greedy(prefix: str, points: str, r: float, extra: str = "''"):
    """Centres of the in-order pass as {prefix}_c(seq, n, n_added, dist_sum)."""
    p = prefix
    return [
        (
            f"{p}_p",
            f"""select *, row_number() over (partition by pk order by seq) as i from
    (select *, {PLACE} || '/' || {extra} as pk from {points}) t""",
        ),
        (
            f"{p}_q",
            f"""select p.pk, p.i, p.seq, p.n, coalesce(nb.ns, []::bigint[]) as ns from {p}_p p
    left join (select a.pk, a.i, list(b.i order by b.i) as ns from {p}_p a join {p}_p b
      on a.pk = b.pk and a.i <> b.i and {gate("a", "b", r)} group by 1, 2) nb
    on nb.pk = p.pk and nb.i = p.i""",
        ),
        (
            f"{p}_st",
            f"""select pk, 0::bigint as i, []::bigint[] as centres, null::bigint as target
    from (select distinct pk from {p}_q) t
    union all
    select s.pk, q.i,
      case when list_contains(s.centres, q.i) then s.centres
           when f.t is null then list_append(s.centres, q.i)
           when list_contains(s.centres, f.t) then s.centres
           else list_append(s.centres, f.t) end,
      case when list_contains(s.centres, q.i) then q.i else coalesce(f.t, q.i) end
    from {p}_st s join {p}_q q on q.pk = s.pk and q.i = s.i + 1,
    lateral (select list_min(list_filter(q.ns,
      lambda j: j > q.i or list_contains(s.centres, j))) as t) f""",
        ),
        (
            f"{p}_c",
            f"""select c.seq, c.road_key, c.road, c.lat, c.lon, c.bearing, c.pk,
      cast(sum(o.n) as bigint) as n, cast(count(*) as bigint) as n_added,
      sum(case when o.i = c.i then 0 else {miles("o", "c")} end) as dist_sum
    from {p}_st st join {p}_p o on o.pk = st.pk and o.i = st.i
    join {p}_p c on c.pk = st.pk and c.i = st.target
    group by all""",
        ),
    ]


BUCKET = f"(('0x' || substr(md5(cast(seq as varchar)), 1, 8))::bigint % {q.BUCKETS})"


def bucketed(prefix: str, points: str, r: float):
    """Buckets by themselves, then earlier ones take in lone later points."""
    p = prefix
    return [
        *greedy(f"{p}a", points, r, BUCKET),
        (
            f"{p}_b",
            f"""select *, row_number() over (partition by place order by bucket, seq) as i from
    (select *, {BUCKET} as bucket, {PLACE} as place, n_added = 1 as lone from {p}a_c) t""",
        ),
        (
            f"{p}_e",
            f"""select b.place, b.i, b.lone, coalesce(nb.ns, []::bigint[]) as ns from {p}_b b
    left join (select a.place, a.i, list(b.i order by b.i) as ns from {p}_b a join {p}_b b
      on a.place = b.place and b.bucket < a.bucket and {gate("a", "b", r)} group by 1, 2) nb
    on nb.place = b.place and nb.i = b.i""",
        ),
        (
            f"{p}_st",
            f"""select place, 0::bigint as i, []::bigint[] as stands, null::bigint as target
    from (select distinct place from {p}_b) t
    union all
    select s.place, e.i,
      case when e.lone and f.t is not null then s.stands else list_append(s.stands, e.i) end,
      case when e.lone then coalesce(f.t, e.i) else e.i end
    from {p}_st s join {p}_e e on e.place = s.place and e.i = s.i + 1,
    lateral (select list_min(list_filter(e.ns, lambda j: list_contains(s.stands, j))) as t) f""",
        ),
        (
            f"{p}_c",
            f"""select c.seq, c.road_key, c.road, c.lat, c.lon, c.bearing,
      cast(sum(o.n) as bigint) as n, 0::bigint as n_added, 0.0::double as dist_sum
    from {p}_st st join {p}_b o on o.place = st.place and o.i = st.i
    join {p}_b c on c.place = st.place and c.i = st.target
    group by all""",
        ),
    ]


# --- fuzzy update -------------------------------------------------------------


def triangle(x: str, a: float | None, b: float, c: float | None, flat: float) -> str:
    if a is None:
        return f"greatest(({c} - {x}) / ({c} - {b}), 0.0)"
    if c is None:
        return f"case when {x} >= {flat} then 1.0 else greatest(({x} - {a}) / ({b} - {a}), 0.0) end"
    return f"greatest(least(({x} - {a}) / ({b} - {a}), ({c} - {x}) / ({c} - {b})), 0.0)"


def terms(n: str, d: str) -> str:
    n = f"cast({n} as double)"
    return ", ".join(
        [
            f"{triangle(n, None, 0.0, 3.0, 10.0)} as n_low",
            f"{triangle(n, 0.0, 3.0, 8.0, 10.0)} as n_med",
            f"{triangle(n, 3.0, 8.0, None, 10.0)} as n_high",
            f"{triangle(d, None, 0.0, 0.75, 2.0)} as d_low",
            f"{triangle(d, 0.25, 1.0, 1.75, 2.0)} as d_med",
            f"{triangle(d, 1.25, 2.0, None, 2.0)} as d_high",
        ]
    )


def density(base: str) -> str:
    w = {r: f"least(n_{r[0]}, d_{r[1]})" for r in RULES[base]}
    top = " + ".join(f"{w[r]} * {LEVELS[v]}::double" for r, v in RULES[base].items())
    low = " + ".join(w.values())
    return f"(({top}) / nullif({low}, 0))"


def spread(source: str, decay: float, base: str = "tight") -> str:
    """`source` with new sd and label; sums start over."""
    return f"""select t.* exclude (sd, n_added, dist_sum, n_low, n_med, n_high, d_low, d_med, d_high,
      fresh, raw), floor(raw * 100.0 + 0.5) / 100.0 as sd,
    case when raw < 1.45 then 'DENSE' else 'SPARSE' end as density_label,
    0::bigint as n_added, 0.0::double as dist_sum from (
  select *, case when n_added > 0 then
      case when sd is null then fresh else (0.5 * sd + fresh) / 1.5 end
      else least(coalesce(sd, 1.0) * {1.0 + decay}::double, 2.75) end as raw from (
  select *, 0.15::double + (1.0 - least(greatest({density(base)}, 0.01), 1.0)) * 2.6::double as fresh
  from (select *, {terms("n_added", "(case when n_added > 0 then dist_sum / n_added end)")}
        from {source}) a) b) t"""


# --- one step -----------------------------------------------------------------


def crisp_step(prefix, batch, state, params, interval, seeds=None):
    """Outcome of an interval as {prefix}_out. `seeds` names centres that take
    the place of an empty state."""
    p, r, keep = prefix, params.radius_miles, 1.0 - params.decay_rate
    known = state
    ctes = []
    if seeds:
        known = f"{p}_kn"
        ctes.append((known, f"select seq as hs_id, * exclude (seq) from {seeds}"))
    ctes += nearest(p, batch, known, r)
    if params.cluster_mode == "bucketed":
        ctes += bucketed(f"{p}n", f"{p}_loc", r)
    else:
        ctes += greedy(f"{p}n", f"{p}_loc", r)
    parts = [
        f"""select road_key, hs_lat as lat, hs_lon as lon, null as hs_id, null as bearing,
      cast(count(*) as double) as fitness, 1 as age, count(*) as n_assigned, null as is_new
      from {p}_as where hs_id is not null group by 1, 2, 3""",
        f"""select road_key, lat, lon, seq, bearing, cast(n as double), 1, 0, true from {p}n_c""",
    ]
    if seeds:
        parts.append(
            f"select road_key, lat, lon, seq, bearing, cast(n as double), 1, 0, false from {seeds}"
        )
    if state:
        parts.append(
            f"""select road_key, lat, lon, hs_id, bearing, fitness * {keep}::double, age + 1, 0, false
      from {state}"""
        )
    ctes.append(
        (
            f"{p}_out",
            f"""select *, case when fitness < {params.delete_threshold} then 'deleted'
      when fitness >= {params.hotspot_threshold} then 'reported' else 'kept' end as status from (
    select road_key, lat, lon, arg_min(hs_id, (coalesce(is_new, false), hs_id)) as hs_id,
      arg_min(bearing, (coalesce(is_new, false), hs_id)) as bearing, sum(fitness) as fitness,
      cast(max(age) as int) as age, cast(sum(n_assigned) as bigint) as n_assigned,
      bool_and(coalesce(is_new, false)) as is_new
    from ({" union all ".join(parts)}) u group by road_key, lat, lon) t""",
        )
    )
    return ctes


def fuzzy_step(prefix, batch, state, params, interval, seeds=None):
    p, top, keep = prefix, params.radius_miles, 1.0 - params.decay_rate
    known = state
    ctes = []
    if seeds:
        known = f"{p}_kn"
        ctes.append((known, f"select seq as hs_id, * exclude (seq), null::double as sd from {seeds}"))
    ctes += [
        (
            f"{p}_pr",
            f"""select * from (select i.incident_id, h.road_key, h.lat as hs_lat, h.lon as hs_lon,
      {miles("i", "h")} as m, {member(miles("i", "h"), "h.sd", top)} as mu
      from {batch} i join {known} h on {gate("i", "h", top)}) t where mu >= {params.conf_threshold}""",
        ),
        (
            f"{p}_loc",
            locations(
                f"(select * from {batch} where incident_id not in (select incident_id from {p}_pr))"
            ),
        ),
        *greedy(f"{p}n", f"{p}_loc", params.init_miles),
    ]
    parts = [
        f"""select road_key, hs_lat as lat, hs_lon as lon, null as hs_id, null as bearing,
      sum(mu) as fitness, 1 as age, count(*) as n_assigned, null as is_new,
      count(*) as n_added, sum(m) as dist_sum, null::double as sd
      from {p}_pr group by 1, 2, 3""",
        f"""select road_key, lat, lon, seq, bearing, cast(n as double), 1, 0, true, n_added, dist_sum,
      null from {p}n_c""",
    ]
    if seeds:
        parts.append(
            f"""select road_key, lat, lon, seq, bearing, cast(n as double), 1, 0, false, n_added,
      dist_sum, null from {seeds}"""
        )
    if state:
        parts.append(
            f"""select road_key, lat, lon, hs_id, bearing, fitness * {keep}::double, age + 1, 0, false,
      0, 0.0, sd from {state}"""
        )
    ctes += [
        (
            f"{p}_mg",
            f"""select road_key, lat, lon, arg_min(hs_id, (coalesce(is_new, false), hs_id)) as hs_id,
      arg_min(bearing, (coalesce(is_new, false), hs_id)) as bearing, sum(fitness) as fitness,
      cast(max(age) as int) as age, cast(sum(n_assigned) as bigint) as n_assigned,
      bool_and(coalesce(is_new, false)) as is_new, sum(n_added) as n_added,
      sum(dist_sum) as dist_sum, max(sd) as sd
    from ({" union all ".join(parts)}) u group by road_key, lat, lon""",
        ),
        (
            f"{p}_out",
            f"""select *, case when fitness < {params.delete_threshold} then 'deleted'
      when fitness >= {params.hotspot_threshold} then 'reported' else 'kept' end as status
    from ({spread(f"{p}_mg", params.decay_rate, params.rule_base)}) t""",
        ),
    ]
    return ctes


def sample(batch: str, percent: int) -> str:
    return f"""select *, row_number() over (order by md5(cast(incident_id as varchar)), incident_id)
    <= (select floor(count(*) * {percent} / 100) from {batch}) as seeded from {batch}"""


def chain(params, step, days: int, intervals: int):
    """All intervals one after the other, the first one seeded."""
    loc_radius = params.cluster_miles
    ctes = [
        ("inc", inc(days)),
        ("b1", "select * from inc where interval_id = 1"),
        ("sd1", sample("b1", params.seed_percent)),
        ("r1", "select * from sd1 where not seeded"),
        ("sl1", locations("(select * from sd1 where seeded)")),
        *greedy("sg1", "sl1", loc_radius),
        *step("k1", "r1", None, params, 1, seeds="sg1_c"),
        ("a1", "select * from k1_out where status <> 'deleted'"),
    ]
    for t in range(2, intervals + 1):
        ctes += [
            (f"b{t}", f"select * from inc where interval_id = {t}"),
            *step(f"k{t}", f"b{t}", f"a{t - 1}", params, t),
            (f"a{t}", f"select * from k{t}_out where status <> 'deleted'"),
        ]
    return ctes


def chain_gaps(params, days: int):
    """The intervals 1, 3, 4 and, `FAR` later, 5 and 6: the one without incidents
    ages the state, the many after 4 empty it, and it is seeded again."""
    keep, least = 1.0 - params.decay_rate, params.delete_threshold

    def seeded(t):
        return [
            (f"b{t}", f"select * from inc where interval_id = {t}"),
            (f"sd{t}", sample(f"b{t}", params.seed_percent)),
            (f"r{t}", f"select * from sd{t} where not seeded"),
            (f"sl{t}", locations(f"(select * from sd{t} where seeded)")),
            *greedy(f"sg{t}", f"sl{t}", params.cluster_miles),
            *crisp_step(f"k{t}", f"r{t}", None, params, t, seeds=f"sg{t}_c"),
            (f"a{t}", f"select * from k{t}_out where status <> 'deleted'"),
        ]

    def stepped(t, state):
        return [
            (f"b{t}", f"select * from inc where interval_id = {t}"),
            *crisp_step(f"k{t}", f"b{t}", state, params, t),
            (f"a{t}", f"select * from k{t}_out where status <> 'deleted'"),
        ]

    aged = f"select * replace (fitness * {keep}::double as fitness, age + 1 as age) from a1"
    idle = f"select * from ({aged}) x where fitness >= {least}"
    return [("inc", inc(days)), *seeded(1), ("i2", idle), *stepped(3, "i2"), *stepped(4, "a3"), *seeded(5), *stepped(6, "a5")]


INTERVALS = 6  # the events span 30 days


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) as {c.split('.')[-1]}" for c in cols)


SPARK_HOURS = "cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 14400) + 1 as int)"


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    step_r = q.STEP_CRISP.radius_miles
    bad = "case when event_id % 97 = 0 then 'bearing' when event_id % 89 = 0 then 'road' end"
    out["parse_incident_lines"] = f"""select cast(event_id as varchar) as incident_id,
  round({LAT}, 6) as lat, round({LON}, 6) as lon,
  case when event_id % 97 <> 0 then {BEARING} end as bearing,
  case when event_id % 89 <> 0 then {ROAD} end as road,
  case when event_id % 89 <> 0 then cast(cast(ts as date) as varchar) end as date,
  {bad} as bad_reason from events"""
    out["read_incident_csv"] = f"""select cast(day(ts) as int) as interval_id,
  cast(event_id as varchar) as incident_id,
  case when b is null then round({LAT}, 6) end as lat,
  case when b is null then round({LON}, 6) end as lon,
  case when b is null then {BEARING} end as bearing,
  case when b is null then {ROAD} end as road, b as bad_reason
  from (select *, {bad} as b from events) t"""
    out["keyed_incidents"] = over_inc(
        f"select incident_id, {r6('lat', 'lon')}, bearing, road_key, 0 as age from inc"
    )
    out["assign_interval"] = over_inc(f"select incident_id, {SPARK_HOURS} as interval_id from inc")
    out["read_hotspot_history"] = over_state(
        "select age + 1 as dayid, road, bearing, round(lat, 6) as latitude,"
        " round(lon, 6) as longitude, round(fitness, 6) as fitness, age from s"
    )

    road = f"from inc i join hs h on i.road_key = h.road_key and {miles('i', 'h')} <= 5.0"
    out["bearing_pairs"] = over_inc(
        f"select i.incident_id, h.hs_id, cast({delta('i', 'h')} as int) as delta,"
        f" {delta('i', 'h')} < 60 as compatible {road}"
    )
    out["haversine_pairs"] = over_inc(
        f"select i.incident_id, h.hs_id, round({miles('i', 'h')}, 6) as miles {road}"
    )
    out["gated_pairs"] = over_inc(
        f"select i.incident_id, h.hs_id, case when {delta('i', 'h')} < 60 then"
        f" round({miles('i', 'h')}, 6) end as miles {road}"
    )
    close = f"from inc i join hs h on {gate('i', 'h', 5.0)}"
    out["candidate_pairs"] = over_inc(
        f"select i.incident_id, h.hs_id, round({miles('i', 'h')}, 6) as miles {close}"
    )

    def assigned(final, r=step_r, order="m, hs_id"):
        return with_([("inc", inc()), ("hs", HS), *nearest("k", "inc", "hs", r, order)], final)

    out["assign_nearest"] = assigned(
        "select incident_id, hs_id, round(m, 6) as miles from k_as"
    )
    out["assign_nearest_join"] = out["assign_nearest"]
    many = [("inc", inc()), ("hs", hs(q.MANY))]
    out["assign_nearest_many"] = with_(
        [*many, *nearest("k", "inc", "hs", step_r)],
        "select incident_id, hs_id, round(m, 6) as miles from k_as",
    )
    out["assign_first"] = assigned(
        "select incident_id, hs_id, round(m, 6) as miles from k_as", 5.0, "hs_id"
    )
    out["unassigned_incidents"] = assigned(
        "select incident_id, road_key from k_as where hs_id is null"
    )
    out["split_assigned"] = assigned(
        "select incident_id, case when hs_id is null then 'left' else 'taken' end as part from k_as"
    )
    out["count_updates"] = assigned(
        "select hs_id, count(*) as n from k_as where hs_id is not null group by 1"
    )
    out["new_locations"] = assigned(
        f"select seq, road_key, road, {r6('lat', 'lon')}, bearing, n from k_loc"
    )
    out["all_updates"] = assigned(
        """select hs_id, null as road_key, count(*) as n from k_as where hs_id is not null group by 1
  union all select seq, road_key, n from k_loc"""
    )
    out["weight_updates"] = assigned(
        """select hs_id, round(count(*) * 1.5::double, 6) as fitness, 1 as age from k_as
  where hs_id is not null group by 1"""
    )
    mu = member(miles("i", "h"), "h.sd", 5.0)
    out["fuzzy_membership"] = over_inc(
        f"select i.incident_id, h.hs_id, round({mu}, 6) as membership {close}"
    )
    out["assign_fuzzy"] = over_inc(
        f"select i.incident_id, h.hs_id, round({mu}, 6) as membership,"
        f" round({miles('i', 'h')}, 6) as miles {close} where {mu} >= 0.2"
    )
    out["assign_fuzzy_many"] = with_(
        many,
        f"select i.incident_id, h.hs_id, round({mu}, 6) as membership,"
        f" round({miles('i', 'h')}, 6) as miles {close} where {mu} >= 0.2",
    )
    out["unassigned_fuzzy"] = over_inc(
        f"select incident_id, road_key from inc where incident_id not in"
        f" (select i.incident_id {close} where {mu} >= 0.2)"
    )
    out["count_updates_fuzzy"] = over_inc(
        f"select h.hs_id, round(sum({mu}), 6) as fit, count(*) as n_added,"
        f" round(sum({miles('i', 'h')}), 6) as dist_sum {close} where {mu} >= 0.2 group by 1"
    )

    pts = [("inc", inc()), ("loc", locations("inc"))]
    for name, keep in (("seed_sample", "seeded"), ("seed_remainder", "not seeded")):
        out[name] = with_(
            [("inc", inc()), ("t", sample("inc", 10))],
            f"select incident_id, road_key from t where {keep}",
        )
    near = gate("p", "o", q.CLUSTER_MILES)
    out["first_neighbour"] = with_(
        [*pts],
        f"""select p.seq, n.seq as next_seq, round({miles("p", "n")}, 6) as miles
  from loc p left join (
    select p.seq as at, min(o.seq) as seq from loc p
    join loc o on o.seq > p.seq and {near} group by 1) f on f.at = p.seq
  left join loc n on n.seq = f.seq""",
    )
    gap = f"degrees({q.CLUSTER_MILES} / (6372.8 / 1.609344)) * (1 + 1e-9)"
    out["islands"] = with_(
        [*pts],
        f"""select seq, road_key, cast(sum(opens) over (partition by road_key order by lat
    range between unbounded preceding and current row) as int) as island_id from (
    select *, case when lat - lag(lat) over (partition by road_key order by lat) > {gap}
      then 1 else 0 end as opens from loc) t""",
    )
    side = f"(2 * sin({q.CLUSTER_MILES} / (2 * 6372.8 / 1.609344)) * (1 + 1e-9) + 1e-14)"
    at = {
        "x": "cos(radians(lat)) * cos(radians(lon))",
        "y": "cos(radians(lat)) * sin(radians(lon))",
        "z": "sin(radians(lat))",
    }
    cells = ", ".join(f"floor({e} / {side}) as {c}" for c, e in at.items())
    out["ground_islands"] = with_(
        [
            *pts,
            ("placed", f"select seq, road_key, {cells} from loc"),
            ("cell", "select road_key, x, y, z, min(seq) as s from placed group by all"),
            (
                "reach",
                """select road_key, x, y, z, s from cell union
    select c.road_key, c.x, c.y, c.z, r.s from reach r join cell c on c.road_key = r.road_key
      and abs(c.x - r.x) <= 1 and abs(c.y - r.y) <= 1 and abs(c.z - r.z) <= 1""",
            ),
            ("named", "select road_key, x, y, z, min(s) as island from reach group by all"),
        ],
        "select seq, road_key, island from placed join named using (road_key, x, y, z)",
    )
    clustered = [*pts, *greedy("g", "loc", q.CLUSTER_MILES)]
    out["greedy_cluster"] = with_(
        clustered, f"select seq as hs_id, road_key, {r6('lat', 'lon')}, bearing, n from g_c"
    )
    for name in ("greedy_cluster_sums", "greedy_cluster_rounds"):
        out[name] = with_(clustered, f"select seq as hs_id, n, n_added, {r6('dist_sum')} from g_c")
    out["greedy_cluster_bucketed"] = with_(
        [*pts, *bucketed("g", "loc", q.CLUSTER_MILES)],
        f"select seq as hs_id, road_key, {r6('lat', 'lon')}, n from g_c",
    )

    keep = 1.0 - q.CRISP.decay_rate
    out["decay_hotspots"] = over_state(
        f"select hs_id, round(fitness * {keep}::double, 6) as fitness, age + 1 as age from s"
    )
    raw = "least({} * 1.3::double, 2.75)"
    rounded = "floor({} * 100.0 + 0.5) / 100.0"
    once = rounded.format(raw.format("coalesce(sd, 1.0::double)"))
    twice = rounded.format(raw.format(f"({once})"))
    third = raw.format(f"({twice})")
    out["decay_gap"] = over_state(
        f"""select hs_id, round(fitness * {keep}::double * {keep}::double * {keep}::double, 6) as fitness,
  age + 3 as age, {rounded.format(third)} as sd,
  case when {third} < 1.45 then 'DENSE' else 'SPARSE' end as density_label
  from s"""
    )
    out["merge_state"] = with_(
        [("inc", inc()), ("s", STATE), ("loc", locations("inc"))],
        f"""select min(case when not fresh then hs_id end) as hs_id, road_key, {r6('lat', 'lon')},
  round(sum(fitness), 6) as fitness, cast(max(age) as int) as age from (
    select hs_id, road_key, lat, lon, fitness * {keep}::double as fitness, age + 1 as age,
      false as fresh from s
    union all select seq, road_key, lat, lon, cast(n as double), 1, true from loc) t
  group by road_key, t.lat, t.lon""",
    )
    out["merge_state_fuzzy"] = with_(
        [("inc", inc()), ("s", STATE), ("loc", locations("inc"))],
        f"""select min(case when not fresh then hs_id end) as hs_id, round(sum(fitness), 6) as fitness,
  cast(max(age) as int) as age, cast(sum(n_added) as bigint) as n_added,
  round(sum(dist_sum), 6) as dist_sum, round(max(sd), 6) as sd from (
    select hs_id, road_key, lat, lon, fitness * {keep}::double as fitness, age + 1 as age,
      n_added, dist_sum, sd, false as fresh from s
    union all select seq, road_key, lat, lon, cast(n as double), 1, n, n * 0.25::double, null, true
      from loc) t
  group by road_key, t.lat, t.lon""",
    )
    out["prune_hotspots"] = over_state(
        "select hs_id, round(fitness, 6) as fitness from s where fitness >= 1.9"
    )
    out["report_hotspots"] = over_state(
        "select hs_id, round(fitness, 6) as fitness from s where fitness >= 5.0"
    )

    out["fuzzy_density"] = over_state(
        f"""select hs_id, round({density("tight")}, 9) as tight, round({density("initial")}, 9) as initial
  from t""",
        ("t", f"select hs_id, {terms('n_added', '(case when n_added > 0 then dist_sum / n_added end)')} from s"),
    )
    updated = ("u", spread("s", q.FUZZY.decay_rate))
    out["update_sd"] = over_state(
        "select hs_id, round(sd, 6) as sd, density_label, n_added, round(dist_sum, 6) as dist_sum"
        " from u",
        updated,
    )
    out["density_labels"] = over_state(
        "select density_label, count(*) as n_hotspots from u where fitness >= 5.0 group by 1", updated
    )
    out["interval_metrics"] = over_state(
        """select age as interval_id, count(*) filter (age = 1) as n_new,
  cast(sum(hs_id % 5) as bigint) as n_assigned, count(*) filter (fitness < 20) as n_deleted,
  count(*) filter (fitness >= 20) as n_state, count(*) filter (fitness >= 40) as n_reported,
  round(min(fitness) filter (fitness >= 20), 6) as fv_min,
  round(max(fitness) filter (fitness >= 20), 6) as fv_max,
  count(*) filter (fitness >= 40 and density_label = 'DENSE') as n_dense,
  count(*) filter (fitness >= 40 and density_label = 'SPARSE') as n_sparse,
  round(min(sd) filter (fitness >= 20), 6) as sd_min,
  round(max(sd) filter (fitness >= 20), 6) as sd_max from u group by 1""",
        updated,
    )
    counts = {
        "n_new": "age = 1", "n_deleted": "fitness < 20", "n_state": "fitness >= 20",
        "n_reported": "fitness >= 40", "n_dense": "fitness >= 40 and density_label = 'DENSE'",
        "n_sparse": "fitness >= 40 and density_label = 'SPARSE'",
    }
    figures = [f"select '{k}' as metric, cast(count(*) filter ({v}) as varchar) as text from u" for k, v in counts.items()]
    figures.append("select 'n_assigned', cast(cast(sum(hs_id % 5) as bigint) as varchar) from u")
    figures += [
        f"select '{name}_{end}', printf('%.2f', {end}({col}) filter (fitness >= 20)) from u"
        for name, col in (("fv", "fitness"), ("sd", "sd"))
        for end in ("min", "max")
    ]
    out["format_metrics"] = over_state(" union all ".join(figures), updated)
    for col in ("fitness", "sd"):
        out[f"rank_quantiles_{col}"] = over_state(
            f"""select p.p, round(r.v, 6) as value from
  (select unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::double as p) p
  join (select {col} as v, row_number() over (order by {col}) - 1 as i,
    count(*) over () as n from s where {col} is not null) r on r.i = floor(p.p * r.n)"""
        )
    line = "concat_ws(chr(9), cast(lat as varchar), cast(lon as varchar), cast(fitness as varchar), cast(age as varchar)"
    out["format_hotspots"] = over_state(f"select {line}) as line from s where fitness >= 5.0")
    out["write_latest"] = over_state(f"select {line}) as value from s where fitness >= 5.0")
    out["stream_progress"] = "select cast(0 as bigint) as batch_id, count(*) as n_rows from events"
    out["write_hotspots"] = over_state(
        f"select {line}) as value, age + 1 as interval_id from s where fitness >= 5.0"
    )
    out["format_hotspots_fuzzy"] = over_state(
        f"select {line}, cast(sd as varchar), density_label, cast(n_added as varchar)) as line"
        " from u where fitness >= 5.0",
        updated,
    )
    out["heatmap_frames"] = over_state(
        """select cast(d as int) as day_id, round(lat, 6) as latitude, round(lon, 6) as longitude
  from (select *, count(*) over (partition by d) as c from t where d between 1 and 150) x
  where c > 50""",
        ("t", "select *, (hs_id * 7 + age * 3) % 200 as d from s"),
    )

    shown = (
        f"hs_id, road_key, {r6('lat', 'lon')}, bearing, {r6('fitness')}, age, n_assigned, is_new,"
        " status"
    )
    base = [("inc", inc()), ("hs", HS)]
    out["step_crisp"] = with_(
        [*base, *crisp_step("k", "inc", "hs", q.STEP_CRISP, 1)], f"select {shown} from k_out"
    )
    mode = q.CrispParams(radius_miles=step_r, cluster_mode="bucketed")
    out["step_bucketed"] = with_(
        [*base, *crisp_step("k", "inc", "hs", mode, 1)], f"select {shown} from k_out"
    )
    out["step_fuzzy"] = with_(
        [*base, *fuzzy_step("k", "inc", "hs", q.STEP_FUZZY, 1)],
        f"select {shown}, round(sd, 6) as sd, density_label from k_out",
    )
    last = f"a{INTERVALS}"
    crisp = chain(q.REPLAY_CRISP, crisp_step, q.REPLAY_DAYS, INTERVALS)
    final = f"select hs_id, road_key, {r6('lat', 'lon', 'fitness')}, age from {last}"
    out["replay_crisp"] = with_(crisp, final)

    def figures_of(t: int, named: int | None = None) -> str:
        return f"""select {named or t} as interval_id, (select count(*) from b{t}) as n_incidents,
  cast(sum(n_assigned) as bigint) as n_assigned, count(*) filter (is_new) as n_new,
  count(*) filter (status = 'deleted') as n_deleted,
  count(*) filter (status <> 'deleted') as n_state,
  count(*) filter (status = 'reported') as n_reported from k{t}_out"""

    counts = " union all ".join(figures_of(t) for t in range(1, INTERVALS + 1))
    out["replay_metrics"] = with_(crisp, counts)
    gaps = chain_gaps(q.REPLAY_CRISP, q.REPLAY_DAYS)
    out["replay_gaps"] = with_(
        gaps, f"select hs_id, road_key, {r6('lat', 'lon', 'fitness')}, age from a6"
    )
    came = {1: 1, 3: 3, 4: 4, 5: 5 + q.FAR, 6: 6 + q.FAR}
    out["replay_gaps_metrics"] = with_(gaps, " union all ".join(figures_of(t, n) for t, n in came.items()))
    out["replay_fuzzy"] = with_(
        chain(q.REPLAY_FUZZY, fuzzy_step, q.REPLAY_DAYS, INTERVALS),
        f"select hs_id, road_key, {r6('fitness')}, age, {r6('sd')}, density_label from {last}",
    )
    good = "event_id % 97 <> 0 and event_id % 89 <> 0"
    fed = [
        (n, s.replace("from events", f"from events where {good}") if n == "inc" else s)
        for n, s in crisp
    ]
    out["stream_replay"] = with_(fed, final)
    out["incident_accounting"] = f"""select interval_id, went, count(*) as n from (
    select case when event_id % 83 <> 0 then cast(floor((day(ts) - 1) / {q.REPLAY_DAYS}) + 1 as int) end
      as interval_id,
      case when event_id % 83 = 0 or not ({good}) then 'quarantine'
        when event_id % 5 = 0 then 'late' else 'counted' end as went from events) t
  group by 1, 2"""
    return out
