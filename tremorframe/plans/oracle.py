"""The registered queries as ANSI SQL over the same test tables."""

from __future__ import annotations

import re

from tremorframe.operators.models import REGRESSION_COLUMNS, VECTOR_COLUMNS
from tremorframe.plans.queries import CV_FOLDS, DIGITS, LOADED_BEFORE_US, OMORI_MIN_MAG

D01 = "cast('0.1' as double)"


def _arc(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Central angle in radians."""
    dlat = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    dlon = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    chord = f"least(1.0::double, {dlat}*{dlat} + cos(radians({lat1}))*cos(radians({lat2}))*{dlon}*{dlon})"
    return f"2 * atan2(sqrt({chord}), sqrt(1 - {chord}))"


EV = """ev as (
  select user_id as eq_id, event_id, epoch_us(ts) as t_us,
         ((user_id*37)%1200)/10::double - 60 + ((event_id*17)%61 - 30)/10::double as lat,
         ((user_id*73)%3600)/10::double - 180 + ((event_id*29)%61 - 30)/10::double as lon,
         case when event_id%50 <> 0 then ((event_id*13)%700)/10::double end as depth,
         (floor(value/11.5::double) + 30)/10::double as mag,
         event_type as mag_type
  from events)"""
CAT = """cat as (
  select eq_id, t_us as t0_us, mag + 4 as mainshock_mag, depth as mainshock_depth,
         lat as mainshock_lat, lon as mainshock_lon,
         cast(year(make_timestamp(t_us)) as integer) as year
  from (select *, row_number() over (partition by eq_id order by t_us, event_id) as rn from ev)
  where rn = 1)"""
JOINED = f"""joined as (
  select ev.*, cat.* exclude (eq_id), (t_us - t0_us)/3.6e9::double as hours,
         6371.0::double * {_arc('mainshock_lat', 'mainshock_lon', 'lat', 'lon')} as dist_km
  from ev join cat using (eq_id))"""
AFTER = "aft as (select * from joined where t_us > t0_us)"
COUNTS = "counts as (select eq_id, mag, count(*) as n from aft group by eq_id, mag)"
MC = f"""span as (
  select *, (lo + {D01}) - lo as d,
         ceil((ceil(mx*10)/10::double + {D01} - lo)/{D01}) - 1 as last
  from (select eq_id, min(mag) as mn, max(mag) as mx, sum(n) as total,
               floor(min(mag)*10)/10::double as lo from counts group by eq_id)),
guess as (
  select c.*, lo, d, last, floor((mag - lo)/d) as g from counts c join span using (eq_id)),
binned as (
  select eq_id, n, lo, d, last, mag,
         case when mag = lo + last*d then last - 1
              when mag < lo + g*d then g - 1
              when mag >= lo + (g + 1)*d then g + 1 else g end as bin
  from guess),
fullest as (
  select eq_id, lo + bin*d as edge,
         row_number() over (partition by eq_id order by n desc, bin) as rn
  from (select eq_id, lo, d, bin, sum(n) as n from binned where bin < last and bin >= 0
        group by eq_id, lo, d, bin)),
mc as (
  select s.eq_id, case when s.total < 10 then s.mn else round(f.edge, 1) end as mc, s.mn, s.total, f.edge
  from span s left join fullest f on f.eq_id = s.eq_id and f.rn = 1)"""


def _b(threshold: str, name: str) -> str:
    return f"""{name} as (
  select eq_id, mc, case when sum(n) filter (where mag >= mc) >= 5 then
      1/(ln(10::double)*(sum(n*mag) filter (where mag >= mc) / sum(n) filter (where mag >= mc)
         - mc + cast('0.05' as double))) end as b_value
  from counts join (select eq_id, {threshold} as mc from mc) using (eq_id) group by eq_id, mc)"""


def _stats(source: str, spread: str, median: str) -> str:
    return f"""stats as (
  select eq_id, count(*) as aftershock_count,
         avg(mag) as mag_mean, {spread}(mag) as mag_std, max(mag) as mag_max, min(mag) as mag_min,
         {median}(mag, 0.5) as mag_median,
         avg(depth) as depth_mean, {spread}(depth) as depth_std, max(depth) as depth_max,
         avg(dist_km) as dist_mean, {spread}(dist_km) as dist_std, max(dist_km) as dist_max,
         {median}(dist_km, 0.5) as dist_median, {median}(dist_km, 0.9) as spatial_spread,
         max(hours) as time_span_hours, avg(hours) as time_mean_hours,
         count(*) filter (where hours <= 24) as count_24h,
         count(*) filter (where hours <= 72) as count_72h,
         count(*) filter (where hours <= 168) as count_168h,
         count(*) filter (where mag >= 4) as n_mag_ge_4,
         count(*) filter (where mag >= 5) as n_mag_ge_5,
         count(*) filter (where mag >= 6) as n_mag_ge_6
  from {source} group by eq_id)"""


def _features(flavor: str, source: str = "aft") -> str:
    exact = flavor == "exact"
    counts = COUNTS.replace("from aft", f"from {source}")
    counted = ["aftershock_count", "count_24h", "count_72h", "count_168h",
               "n_mag_ge_4", "n_mag_ge_5", "n_mag_ge_6"]
    plain = [
        "mag_mean", "mag_std", "mag_max", "mag_min", "mag_median", "depth_mean", "depth_std", "depth_max",
        "dist_mean", "dist_std", "dist_max", "dist_median", "spatial_spread",
        "time_span_hours", "time_mean_hours",
    ]
    if not exact:
        mc = "case when mc.total < 10 then null else mc.mc end"
        b, tail = _b("mn", "b"), ", count_168h, year"
    else:
        mc, b, tail = "mc.mc", _b("mc", "b"), ""
    return f"""{counts}, {MC}, {b},
{_stats(source, 'stddev_pop' if exact else 'stddev_samp', 'quantile_cont' if exact else 'quantile_disc')},
wide as (
  select cat.eq_id, mainshock_mag, mainshock_depth, mainshock_lat, mainshock_lon, year,
         {', '.join(f'coalesce({c}, 0) as {c}' for c in counted)}, {', '.join(plain)},
         mag_max - mag_min as mag_range, mainshock_mag - mag_max as mag_diff_main_max,
         count_24h / aftershock_count::double as ratio_24h, {mc} as mc, b_value
  from cat {'left' if exact else ''} join stats using (eq_id)
  left join mc using (eq_id) left join b using (eq_id)),
features as (
  select eq_id, mainshock_mag, mainshock_depth, mainshock_lat, mainshock_lon, aftershock_count,
         {', '.join(plain)}, mag_range, mag_diff_main_max, count_24h, count_72h, ratio_24h, mc, b_value,
         n_mag_ge_4, n_mag_ge_5, n_mag_ge_6{tail} from wide)"""


_FLOAT_FEATURES = [
    "mainshock_mag", "mainshock_depth", "mainshock_lat", "mainshock_lon",
    "mag_mean", "mag_std", "mag_max", "mag_min", "mag_median", "depth_mean", "depth_std", "depth_max",
    "dist_mean", "dist_std", "dist_max", "dist_median", "spatial_spread",
    "time_span_hours", "time_mean_hours", "mag_range", "mag_diff_main_max", "ratio_24h", "mc", "b_value",
]
_REPLACED = "select * replace (" + ", ".join(
    f"round({c}, {DIGITS.get(c, 6)}) as {c}" for c in _FLOAT_FEATURES
) + ") from features"

WINDOWS = "win as (select * from (values ('T1', 0, 24), ('T2', 24, 72), ('T3', 72, 168)) w(window, t1, t2))"


def _window_max(name: str, source: str, limit_h: float | None = None) -> str:
    known = "" if limit_h is None else f" and t_us - t0_us <= {int(limit_h * 3_600_000_000)}"
    return f"""{name} as (
  select eq_id, window, mag as max_mag, t_us, mag_type, n_events from (
    select eq_id, win.window, mag, t_us, coalesce(nullif(trim(mag_type), ''), 'Mw') as mag_type,
           count(*) over (partition by eq_id, win.window) as n_events,
           row_number() over (partition by eq_id, win.window
             order by mag desc, t_us, coalesce(nullif(trim(mag_type), ''), 'Mw')) as rn
    from {source} join win on t_us - t0_us > t1 * 3600000000 and t_us - t0_us <= t2 * 3600000000{known})
  where rn = 1)"""


RJ_HATS = """hats as (
  select eq_id, count(*) as n_obs,
         log10(count(*)) - 0.91::double*(any_value(mainshock_mag) - 4)
           - log10((pow(30.05::double, -0.08::double) - pow(0.05::double, -0.08::double))/(-0.08::double)) as a_hat
  from aft where t_us - t0_us <= 30*86400000000 and mag >= 4 group by eq_id)"""
RJ_A = "rj as (select round(coalesce(quantile_cont(a_hat, 0.5), -1.67), 3) as a from hats)"
RJ_INTEGRAL = """((pow(t2/24::double + 0.05::double, -0.08::double)
  - pow(greatest(t1/24::double, 1e-9::double) + 0.05::double, -0.08::double))/(-0.08::double))"""


def _rj_mag(a: str) -> str:
    return f"""case when {a} is not null then least(greatest(
  mainshock_mag - (log10(ln(2::double)/greatest({RJ_INTEGRAL}, 1e-10::double)) - {a})/0.91::double,
  3::double), mainshock_mag - {D01}) end"""


BINS = f"""bins as (
  select eq_id, cast(least(floor((t_us - t0_us)/86400000000::double/0.5::double), 59) as integer) as bin,
         count(*) as n
  from aft where mag >= {OMORI_MIN_MAG} group by 1, 2)"""
# coarse grid, then quarter steps around the best point
FIT = """grid as (
  select 1e-5::double * pow(5e5::double, i/59::double) as c, 0.3::double + 2.2::double*(j/44::double) as p
  from generate_series(0, 59) a(i), generate_series(0, 44) b(j)),
gshape as (
  select c, p, bin, 0.5::double/pow((bin + 0.5::double)*0.5::double + c, p) as g
  from grid, generate_series(0, 59) s(bin)),
gnorm as (select c, p, sum(g*g) as gg from gshape group by c, p),
ysum as (select eq_id, sum(n)::double as total, sum(n*n)::double as yy from bins group by eq_id having sum(n) >= 10),
coarse as (
  select eq_id, c, p, least(greatest(yg/gg, 1e-3::double), 1e6::double) as k, yg, gg from (
    select eq_id, c, p, sum(n*g) as yg from bins join gshape using (bin)
    where eq_id in (select eq_id from ysum) group by eq_id, c, p) join gnorm using (c, p)),
best as (
  select eq_id, c, p from (
    select eq_id, c, p, row_number() over (partition by eq_id order by yy - 2*k*yg + k*k*gg, c, p) as rn
    from coarse join ysum using (eq_id)) where rn = 1),
near as (
  select distinct eq_id,
         least(greatest(c*pow(pow(5e5::double, 1/59::double), u/4::double), 1e-5::double), 5::double) as c,
         least(greatest(p + (2.2::double/44)*(v/4::double), 0.3::double), 2.5::double) as p
  from best, generate_series(-4, 4) a(u), generate_series(-4, 4) b(v)),
nshape as (
  select eq_id, c, p, bin, 0.5::double/pow((bin + 0.5::double)*0.5::double + c, p) as g
  from near, generate_series(0, 59) s(bin)),
fine as (
  select eq_id, c, p, least(greatest(yg/gg, 1e-3::double), 1e6::double) as k, yg, gg from (
    select s.eq_id, c, p, sum(coalesce(n, 0)*g) as yg, sum(g*g) as gg
    from nshape s left join bins b on b.eq_id = s.eq_id and b.bin = s.bin group by s.eq_id, c, p)),
fitted as (
  select eq_id, k, c, p, sse from (
    select *, row_number() over (partition by eq_id order by sse, c, p) as rn from (
      select eq_id, k, c, p, yy - 2*k*yg + k*k*gg as sse from fine join ysum using (eq_id))) where rn = 1),
fit as (
  select cat.eq_id, coalesce(k, 50) as k, coalesce(c, 0.01::double) as c, coalesce(p, 1) as p, sse
  from cat left join fitted using (eq_id))"""
MEDIANS = """med as (
  select quantile_cont(k, 0.5) as k, quantile_cont(c, 0.5) as c, quantile_cont(p, 0.5) as p from fit)"""
FIRST_HOUR = f"""steps as (
  select window, t1, t2, t1 + s*{D01} as hour, s,
         k/pow(greatest((t1 + s*{D01})/24::double + c, 1e-9::double), p)*{D01}/24::double as r
  from win, med, generate_series(0, 959) g(s) where s < (t2 - t1)*10),
running as (select *, sum(r) over (partition by window order by s) as expected from steps),
first_hour as (
  select window, least(coalesce(min(hour) filter (where expected >= 0.5), any_value(t1)),
                       (any_value(t1) + any_value(t2))/2::double) as first_hour
  from running group by window)"""


def _etas(source: str, slots: str, step: str = "1::double", limit_h: float | None = None) -> str:
    """Summed hourly rates over every (sequence, window) of ``slots``."""
    known = "" if limit_h is None else f" and t_us - t0_us <= {int(limit_h * 3_600_000_000)}"
    return f"""added as (
  select eq_id, w.window, sum(0.03::double*exp(mag - 3)
           / pow((h - (t_us - t0_us)/3.6e9::double)/24::double + 0.01::double, 1.1::double)) as added
  from {source} join win w on t_us - t0_us < w.t1 * 3600000000{known}
  join generate_series(0, 167) g(h) on h >= w.t1 and h < w.t2
  group by eq_id, w.window),
total as (
  select s.eq_id, window, ((t2 - t1)*0.01::double + coalesce(added, 0))*{step} as total
  from {slots} s join win using (window) left join added using (eq_id, window)),
etas as (
  select eq_id, window, case when total < 0.01 then 3::double
    else least(greatest(3 + ln(total)/(0.91::double*ln(10::double)), 3), 9.5) end as etas_mag from total)"""


def _predictions(limit_h: float | None = None, a: str = "(select a from rj)") -> str:
    stamp = "strftime(make_timestamp(pred_t_us), '%Y%m%d%H') as pred_time"
    return f"""{RJ_HATS}, {RJ_A}, {BINS}, {FIT}, {MEDIANS}, {WINDOWS}, {FIRST_HOUR},
{_window_max('seen', 'aft', limit_h)},
slots as (select eq_id, window from cat, win), {_etas('joined', 'slots', limit_h=limit_h)},
raw as (
  select cat.*, window, t1, t2, max_mag, seen.t_us, mag_type, n_events, first_hour,
         round(0.6::double*({_rj_mag(a)}) + 0.4::double*etas_mag, 1) as s2
  from cat cross join win left join seen using (eq_id, window)
  join etas using (eq_id, window) join first_hour using (window)),
pred as (
  select *, {stamp} from (
    select eq_id, mainshock_mag, window,
           case when max_mag is not null then round(max_mag, 1) when s2 is not null then s2
                else round(mainshock_mag - 1.2::double, 1) end as pred_mag,
           case when max_mag is not null then t_us
                when s2 is not null then t0_us + cast(round(first_hour*3.6e9) as bigint)
                else t0_us + cast((t1 + t2)/2::double*3.6e9 as bigint) end as pred_t_us,
           coalesce(mag_type, 'Mw') as mag_type, coalesce(n_events, 0) as n_events,
           case when max_mag is not null then 'S1_data' when s2 is not null then 'S2_RJ+ETAS'
                else 'S3_Bath' end as source
    from raw))"""


STAMP = "strftime(make_timestamp(t0_us), '%Y%m%d%H%M%S')"
LINES = f"""lines as (
  select pred.eq_id, {STAMP} || case when nth > 1 then '-' || nth else '' end || case when window = 'T3' then '-T3.csv' else '-T1-T2.csv' end as file_name,
         cast(case when window = 'T2' then 2 else 1 end as integer) as line_no,
         {STAMP} || ' ' || printf('%.4f', mainshock_lon) || ' ' || printf('%.4f', mainshock_lat) || ' '
           || printf('%.1f', cat.mainshock_mag) || ' ' || printf('%.1f', pred_mag) || ' ' || mag_type
           || ' ' || pred_time as line
  from pred join (select *, row_number() over (partition by {STAMP} order by eq_id) as nth from cat) cat
    using (eq_id))"""

PAIRS = f"""pairs as (
  select cat.eq_id, ev.event_id, ev.t_us, ev.mag,
         degrees({_arc('mainshock_lat', 'mainshock_lon', 'lat', 'lon')}) as arc_deg
  from cat join ev on ev.t_us >= t0_us//1000000*1000000
    and ev.t_us <= t0_us//1000000*1000000 + 168*3600000000 and ev.mag >= 2
    and degrees({_arc('mainshock_lat', 'mainshock_lon', 'lat', 'lon')}) <= 3 + 1e-9::double)"""
STATUS = f"""found as (select eq_id, least(count(*), 110) as n from pairs group by eq_id),
status as (
  select cat.eq_id, mainshock_mag as mag, mainshock_lat as lat, mainshock_lon as lon,
         coalesce(n, 0) as n_events,
         case when n is not null and t0_us < {LOADED_BEFORE_US} then 'cached'
              when coalesce(n, 0) = 0 then 'empty' when n >= 10 then 'truncated' else 'ok' end as status
  from cat left join found using (eq_id))"""


def _histogram(col: str, bins: int) -> str:
    return f"""with {EV}, v as (select {col} as v from ev where {col} is not null),
span as (select min(v) as mn, (max(v) - min(v))/{bins}::double as width, avg(v) as mean from v),
guess as (select v, mn, width, least(floor((v - mn)/width), {bins - 1}) as g from v, span),
placed as (
  select case when v < mn + g*width then g - 1
              when v >= mn + (g + 1)*width and g < {bins - 1} then g + 1 else g end as bin from guess)
select b.bin as bin, round(mn + b.bin*width, 6) as lo, round(mn + (b.bin + 1)*width, 6) as hi,
       coalesce(n, 0) as n, round(mean, 6) as mean
from generate_series(0, {bins - 1}) b(bin) cross join span
left join (select bin, count(*) as n from placed group by bin) p on p.bin = b.bin"""


def _metrics(source: str) -> str:
    parts = []
    for truth, guess, digits, names in (
        ("pow(10, y)", "pow(10, y_hat)", 1, ("MAE", "RMSE", "R2")),
        ("y", "y_hat", 4, ("logMAE", "logRMSE", "logR2")),
    ):
        err = f"({guess} - {truth})"
        parts += [
            f'round(avg(abs({err})), {digits}) as "{names[0]}"',
            f'round(sqrt(avg({err}*{err})), {digits}) as "{names[1]}"',
            f'round(1 - avg({err}*{err})/var_pop({truth}), 4) as "{names[2]}"',
        ]
    return f"select model, {', '.join(parts)} from {source} group by model"


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


UNUSABLE = f"""files as (
  select {STAMP} as stamp, bool_or(eq_id = f) as lost, bool_or(eq_id <> f and eq_id % 7 not in (1, 2)) as headed,
    bool_or(eq_id <> f and eq_id % 7 = 1) as bare,
    coalesce(sum(n) filter (where eq_id <> f and eq_id % 7 <> 2), 0) as n
  from cat join (select eq_id, count(*) as n from ev group by eq_id) using (eq_id), (select min(eq_id) as f from cat) group by 1),
status as (
  select stamp as eq_id, mainshock_mag as mag, round(mainshock_lat, 6) as lat, round(mainshock_lon, 6) as lon,
    cast(case when headed then n else 0 end as bigint) as n_events,
    case when lost then 'failed' when headed then 'ok' when bare then 'parse_error' else 'empty' end as status
  from cat join files on stamp = {STAMP})"""
MALFORMED = f"""malformed as (
  select {STAMP} as eq_id, count(*) filter (where depth is null and mag <= 5) as n_malformed,
    count(*) filter (where mag > 5) as n_unreadable from joined group by 1)
"""


def _models() -> str:
    """Complete rows, their folds, and Ridge with one row left out, by elimination."""
    cols = REGRESSION_COLUMNS
    vector = ", ".join(f"cast({c} as double)" for c in cols)
    complete = " and ".join(f"{c} is not null" for c in cols)
    return f"""rows_ as (
  select eq_id, log10(aftershock_count::double) as y, [{vector}] as x,
    ('0x' || substr(md5(eq_id::varchar), 1, 8))::bigint % {CV_FOLDS} as fold
  from features where aftershock_count > 0 and {complete})"""


RIDGE = f"""long_ as (
  select eq_id, y, unnest(x) as x, unnest(range(1, {len(REGRESSION_COLUMNS)} + 1)) as j from rows_),
shift as (
  select j, avg(x) as m, stddev_pop(x) as s from long_ group by j),
scaled as (
  select eq_id, j, case when s > 1e-5 * greatest(abs(m), 1e-12) then (x - m) / s else 0 end as z from long_ join shift using (j)),
label as (
  select avg(y) as ym, count(*) as n from rows_),
one as (
  select eq_id, j, z from scaled union all select eq_id, {len(REGRESSION_COLUMNS) + 1}, y - ym from rows_, label),
sums as (
  select a.j as a, b.j as b, sum(a.z * b.z) as g from one a join one b using (eq_id) group by 1, 2),
totals as (
  select j, sum(z) as t from one group by j),
left_out as (
  select o.eq_id, o.j, (t - z) / (n - 1) as m from one o join totals using (j), label),
cells as (
  select x.eq_id, x.j as a, y.j as b, (g - x.z * y.z) / (n - 1) - p.m * q.m as c
  from one x join one y using (eq_id) join sums on a = x.j and b = y.j
  join left_out p on p.eq_id = x.eq_id and p.j = x.j join left_out q on q.eq_id = x.eq_id and q.j = y.j, label),
dev as (
  select eq_id, a as j, case when sqrt(greatest(c, 0)) > 1e-5 then sqrt(greatest(c, 0)) end as d from cells where a = b),
system as (
  select k.eq_id, k.a, k.b, case when k.b > {len(REGRESSION_COLUMNS)} then coalesce(c / p.d, 0)
    else coalesce(c / p.d / q.d, 0) + case when k.a = k.b then 1.0::double / (n - 1) else 0 end end as c
  from cells k join dev p on p.eq_id = k.eq_id and p.j = k.a join dev q on q.eq_id = k.eq_id and q.j = k.b, label
  where k.a <= {len(REGRESSION_COLUMNS)}),
matrix as (
  select eq_id, list(line order by a) as m from (
    select eq_id, a, list(c order by b) as line from system group by eq_id, a) group by eq_id),
steps as (
  select eq_id, 1 as k, m from matrix
  union all
  select eq_id, k + 1, list_transform(m, lambda line, i: case when i = k
      then list_transform(line, lambda v: v / line[k])
      else list_transform(line, lambda v, j: v - line[k] / m[k][k] * m[k][j]) end)
  from steps where k <= {len(REGRESSION_COLUMNS)}),
solved as (
  select eq_id, unnest(m) as line, unnest(range(1, {len(REGRESSION_COLUMNS)} + 1)) as j from steps
  where k = {len(REGRESSION_COLUMNS)} + 1),
fitted as (
  select eq_id, sum(coalesce(line[{len(REGRESSION_COLUMNS) + 1}] / d * (z - m), 0)) as g
  from solved join dev using (eq_id, j) join one using (eq_id, j) join left_out using (eq_id, j) group by eq_id)
"""


def all_oracles() -> dict[str, str]:
    base = (EV, CAT, JOINED, AFTER)
    exact = _with(*base, _features("exact"))
    sample = _with(*base, _features("spark"))
    mc = _with(*base, COUNTS, MC)
    trained = _with(*base, _features("exact"), _models())
    forecast = _with(*base, _predictions())
    fit = _with(*base, BINS, FIT)
    iso_events = (
        f"select {STAMP} as eq_id, t_us, round(lat, 6) as lat, round(lon, 6) as lon, depth, mag, mag_type from joined"
    )
    # equal rows of one file are one event
    once = iso_events.replace(f"select {STAMP} as", f"select distinct left({STAMP}, 9) || '00000' as") + ""
    pred_columns = "eq_id, mainshock_mag, window, pred_mag, pred_t_us, mag_type, n_events, source, pred_time"
    out = {
        "window_max_per_sequence": _with(*base, WINDOWS, _window_max("best", "aft")) + "select * from best",
        "window_max_of_profile": _with(*base, WINDOWS, _window_max("best", "aft")) + "select * from best",
        "aftershocks_enriched": _with(*base)
        + "select eq_id, event_id, round(hours, 10) as hours, round(dist_km, 6) as dist_km, mag, depth from aft",
        "aftershocks_first_row_rule": _with(*base)
        + """select eq_id, event_id, round((t_us//1000000 - t0_us//1000000)/3600::double, 10) as hours, mag from (
  select *, row_number() over (partition by eq_id order by t_us, event_id) as rn from joined) where rn > 1""",
        "sequence_stats": _with(*base)
        + """select eq_id, t0_us, mainshock_mag, mainshock_depth, round(mainshock_lat, 6) as mainshock_lat,
  round(mainshock_lon, 6) as mainshock_lon, year, coalesce(n, 0) as record_count
from cat left join (select eq_id, count(*) as n from ev group by eq_id) using (eq_id)""",
        "sequence_features": exact + _REPLACED,
        "sequence_features_sample": sample + _REPLACED,
        "sequence_features_as_of_72h": _with(
            *base, "early as (select * from aft where hours <= 72)", _features("exact", "early")
        )
        + _REPLACED,
        "associated_features": _with(
            *base, PAIRS,
            """near as (
  select cat.eq_id, e.mag, e.depth, (e.t_us - t0_us)/3.6e9::double as hours,
         6371.0::double * radians(arc_deg) as dist_km
  from pairs join (select * exclude (eq_id) from ev) e using (event_id) join cat on cat.eq_id = pairs.eq_id
  where e.t_us > t0_us)""",
            _features("spark", "near"),
        )
        + _REPLACED,
        "sequence_features_merged": sample + _REPLACED.replace("select *", "select * exclude (mc)").replace("round(mc, 6) as mc, ", ""),
        "single_file_round_trip": _with(EV, CAT)
        + """select eq_id, mainshock_mag, round(mainshock_lat, 6) as mainshock_lat, round(mainshock_lon, 6) as mainshock_lon,
  year, 1 as n_files from cat""",
        "completeness_edge": mc + "select eq_id, mc from mc",
        "completeness_grid": _with(*base)
        + """select eq_id, case when total < 10 then null else bin/10::double end as mc from (
  select eq_id, bin, sum(n) over (partition by eq_id) as total,
         row_number() over (partition by eq_id order by n desc, bin) as rn
  from (select eq_id, round(mag*10) as bin, count(*) as n from aft group by 1, 2)) where rn = 1""",
        "b_value_above_mc": _with(*base, COUNTS, MC, _b("mc", "b"))
        + "select eq_id, mc, round(b_value, 6) as b_value from b",
        "b_value_above_min": _with(*base, COUNTS, MC, _b("mn", "b"))
        + "select eq_id, mc, round(b_value, 6) as b_value from b",
        "global_summary": sample
        + """select count(*) as total, round(avg(mainshock_mag), 2) as avg_main_mag,
  round(max(mainshock_mag), 1) as max_main_mag, round(avg(aftershock_count), 0) as avg_aft_count,
  max(aftershock_count) as max_aft_count, round(avg(b_value), 3) as avg_b_value from features""",
        "mag_class_summary": sample
        + """select case when mainshock_mag >= 8 then 'M8+' when mainshock_mag >= 7 then 'M7-8'
    when mainshock_mag >= 6.5 then 'M6.5-7' else 'M6-6.5' end as mag_bin,
  count(*) as n, round(avg(aftershock_count), 0) as avg_aft, max(aftershock_count) as max_aft,
  round(avg(b_value), 3) as avg_b, round(avg(ratio_24h), 3) as avg_24h_ratio
from features group by 1 order by 1 desc""",
        "top_sequences": sample
        + """select eq_id, year, round(mainshock_mag, 1) as mag, aftershock_count, round(mag_max, 1) as max_aft_mag,
  round(b_value, 3) as b_value, cast(rank_by_count as integer) as rank_by_count from (
  select *, rank() over (order by aftershock_count desc) as rank_by_count from features)
order by aftershock_count desc, eq_id limit 10""",
        "sequence_ranks": exact
        + """select eq_id, coalesce(aftershock_count, 0) as aftershock_count,
  rank() over (order by coalesce(aftershock_count, 0) desc) as rank_by_count from features""",
        "feature_corr": sample
        + """select round(corr(mainshock_mag, aftershock_count), 4) as corr_mag_count,
  round(corr(mainshock_mag, mag_max), 4) as corr_mag_maxaft,
  round(corr(mainshock_depth, aftershock_count), 4) as corr_depth_count,
  round(corr(b_value, aftershock_count), 4) as corr_bval_count from features""",
        "mag_histogram": _histogram("mag", 30),
        "depth_histogram": _histogram("depth", 50),
        "yearly_frequency": _with(EV, CAT) + "select year, count(*) as n from cat group by year",
        "mag_count_fit": _with(*base)
        + """select round(regr_slope(log10(n), mainshock_mag), 6) as slope,
  round(regr_intercept(log10(n), mainshock_mag), 6) as intercept, count(*) as n
from cat join (select eq_id, count(*) as n from ev group by eq_id) using (eq_id)""",
        "mag_count_fit_metrics": _with(
            *base,
            """pts as (select mainshock_mag as m, log10(n) as y
  from cat join (select eq_id, count(*) as n from ev group by eq_id) using (eq_id))""",
            "line as (select regr_slope(y, m) as s, regr_intercept(y, m) as i from pts)",
            "model_rows as (select 'Line' as model, y, s*m + i as y_hat from pts, line)",
        )
        + _metrics("model_rows"),
        "bath_constant": _with(*base)
        + """select round(quantile_cont(d, 0.5), 6) as bath_delta from (
  select max(mag) - any_value(mainshock_mag) as d from aft group by eq_id)""",
        "rj_a_per_sequence": _with(*base, RJ_HATS) + "select eq_id, n_obs, round(a_hat, 6) as a_hat from hats",
        "rj_a": _with(*base, RJ_HATS, RJ_A) + "select a from rj",
        "rj_estimates": _with(*base, RJ_HATS, RJ_A, WINDOWS)
        + f"""select eq_id, window,
  round(pow(10, (select a from rj) + 0.91::double*(mainshock_mag - 4))*greatest({RJ_INTEGRAL}, 0), 6) as rj_count,
  round({_rj_mag('(select a from rj)')}, 6) as rj_mag from cat, win""",
        "etas_rate": _with(*base, WINDOWS)
        + """select s.eq_id, s.window, cast(s.h as integer) as hour, round(0.01::double + coalesce(added, 0), 6) as rate
from (select eq_id, window, h from cat, win join generate_series(0, 167) g(h) on h >= t1 and h < t2) s
left join (
  select eq_id, w.window, h, sum(0.03::double*exp(mag - 3)
           / pow((h - hours)/24::double + 0.01::double, 1.1::double)) as added
  from joined join win w on t_us - t0_us < w.t1 * 3600000000
  join generate_series(0, 167) g(h) on h >= w.t1 and h < w.t2 group by all) a
on a.eq_id = s.eq_id and a.window = s.window and a.h = s.h""",
        "etas_max_mag": _with(
            *base, WINDOWS, "slots as (select eq_id, window from cat, win)", _etas("joined", "slots")
        )
        + "select eq_id, window, round(etas_mag, 6) as etas_mag from etas",
        "etas_max_mag_days": _with(
            *base, WINDOWS, "slots as (select eq_id, window from cat, win)",
            _etas("joined", "slots", "(1/24::double)"),
        )
        + "select eq_id, window, round(etas_mag, 6) as etas_mag from etas",
        "omori_bins": _with(*base, BINS)
        + """select eq_id, cast(b as integer) as bin, coalesce(n, 0) as n
from (select distinct eq_id from aft) cross join generate_series(0, 59) s(b)
left join bins on bins.eq_id = aft.eq_id and bins.bin = b""".replace("aft.eq_id and", "ids.eq_id and").replace("from aft)", "from aft) ids").replace("select eq_id,", "select ids.eq_id as eq_id,", 1),
        "omori_fit": fit
        + "select eq_id, round(k, 6) as k, round(c, 6) as c, round(p, 6) as p, round(sse, 6) as sse from fit",
        "omori_medians": _with(*base, BINS, FIT, MEDIANS)
        + "select round(k, 6) as k, round(c, 6) as c, round(p, 6) as p from med",
        "omori_first_hour": _with(*base, BINS, FIT, MEDIANS, WINDOWS, FIRST_HOUR)
        + "select window, round(first_hour, 6) as first_hour from first_hour",
        "predictions": forecast + f"select {pred_columns} from pred",
        "predictions_issued_24h": _with(*base, _predictions(24)) + f"select {pred_columns} from pred",
        "predictions_uncalibrated": _with(*base, _predictions(None, "cast(null as double)"))
        + f"select {pred_columns} from pred",
        "strategy_mix": forecast
        + "select eq_id, string_agg(distinct source, '+' order by source) as strategy from pred group by eq_id",
        "prediction_report": forecast
        + """select eq_id, window, mainshock_mag as main_mag, pred_mag, n_events,
  round(mainshock_mag - 1.2::double, 6) as bath_mag from pred""",
        "forecast_score": _with(*base, _predictions(24), _window_max("truth", "aft"))
        + """select count(*) as n_windows, round(avg(
    (least(greatest((2 - abs(pred_mag - max_mag))/1.7::double, 0), 1)
     + least(greatest((24 - abs((pred_t_us - truth.t_us)/3.6e9::double))/23::double, 0), 1))/2)*100, 6) as score
from truth left join pred using (eq_id, window)""",
        "submission": _with(*base, _predictions(), LINES) + "select eq_id, file_name, line_no, line from lines",
        "submission_files": _with(*base, _predictions(), LINES) + "select file_name, line from lines",
        "submission_coverage": _with(*base, _predictions(), LINES)
        + """select count(*) as n_rows, round(avg(case when source = 'S1_data' then 1.0 else 0.0 end)*100, 6)
  as data_share_pct, (select count(distinct file_name) from lines) as n_files from pred""",
        "catalog_clean": _with(EV)
        + """select t_us, round(lat, 6) as latitude, round(lon, 6) as longitude, depth, mag, mag_type as "magType",
  'place ' || eq_id as place, cast(year(make_timestamp(t_us)) as integer) as year,
  cast(month(make_timestamp(t_us)) as integer) as month from ev""",
        "catalog_mainshocks": _with(EV)
        + """select strftime(make_timestamp(t_us), '%Y%m%d%H%M%S') as eq_id, t_us//1000000*1000000 as t0_us,
  mag as mainshock_mag, depth as mainshock_depth, round(lat, 6) as mainshock_lat,
  round(lon, 6) as mainshock_lon, cast(year(make_timestamp(t_us)) as integer) as year from ev""",
        "catalog_mainshocks_unique": _with(EV)
        + """select eq_id, mag as mainshock_mag, t_us//1000000*1000000 as t0_us, round(lat, 6) as lat, round(lon, 6) as lon,
  event_id as nr from (
  select *, row_number() over (
    partition by eq_id order by mag desc, t_us//1000000 desc, lat desc, lon desc, event_id desc) as rn
  from (select * exclude (eq_id), strftime(make_timestamp(t_us), '%Y%m%d%H%M%S') as eq_id from ev))
where rn = 1""",
        "mainshocks_split_time": _with(EV, CAT)
        + f"""select {STAMP} as eq_id, t0_us//1000000*1000000 as t0_us, mainshock_mag, mainshock_depth,
  round(mainshock_lat, 6) as mainshock_lat, round(mainshock_lon, 6) as mainshock_lon,
  'NEIC' as source, year from cat""",
        "mainshocks_reordered": _with(EV, CAT)
        + f"""select {STAMP} as eq_id, t0_us, mainshock_mag, mainshock_depth,
  round(mainshock_lat, 6) as mainshock_lat, round(mainshock_lon, 6) as mainshock_lon, year from cat""",
        "mainshock_labels": _with(EV, CAT)
        + f"""select eq_id, left({STAMP}, 8) as day, right({STAMP}, 6) as clock,
  left(printf('%.4f', mainshock_lat) || ' ' || printf('%.4f', mainshock_lon), 12) as place from cat""",
        "mainshocks_top50": _with(EV, CAT)
        + """select * replace (round(mainshock_lat, 6) as mainshock_lat, round(mainshock_lon, 6) as mainshock_lon)
from cat order by mainshock_mag desc, t0_us desc, eq_id limit 50""",
        "mainshocks_top50_range": _with(EV, CAT)
        + """select min(mainshock_mag) as min_mag, max(mainshock_mag) as max_mag, min(year) as min_year,
  max(year) as max_year, count(*) as n
from (select * from cat order by mainshock_mag desc, t0_us desc, eq_id limit 50)""",
        "sequences_iso": _with(*base) + iso_events,
        "sequences_reordered": _with(*base) + iso_events,
        "sequences_without_type": _with(*base)
        + f"""select {STAMP} as eq_id, t_us, round(lat, 6) as lat, round(lon, 6) as lon, cast(null as double) as depth,
  mag, 'Mw' as mag_type from joined""",
        "sequences_bad_depth": _with(*base) + iso_events,
        "malformed_lines": _with(*base, MALFORMED) + "select * from malformed",
        "load_status_parse_error": _with(*base, MALFORMED)
        + f""", loaded as (
  select {STAMP} as eq_id, count(*) as n from joined where depth is not null and mag < 4 group by 1)
select {STAMP} as eq_id, mainshock_mag as mag, round(mainshock_lat, 6) as lat, round(mainshock_lon, 6) as lon,
  coalesce(n, 0) as n_events, case when n is null and n_malformed > 0 then 'parse_error'
    when n is null then 'empty' else 'ok' end as status
from cat left join loaded on loaded.eq_id = {STAMP} left join malformed on malformed.eq_id = {STAMP}""",
        "catalog_line_breaks": _with(EV)
        + """select t_us, mag, 'near' || chr(10) || '"place ' || eq_id || '", north' as place from ev""",
        "load_status_unusable_files": _with(*base, UNUSABLE) + "select * from status",
        "load_summary_unusable_files": _with(*base, UNUSABLE)
        + """select count(*) filter (where status = 'ok') as n_success, count(*) filter (where status = 'failed') as n_failed,
  count(*) filter (where status = 'empty') as n_empty, cast(sum(n_events) filter (where status = 'ok') as bigint) as events_total,
  round(avg(n_events) filter (where status = 'ok'), 6) as events_mean, max(n_events) filter (where status = 'ok') as events_max,
  min(n_events) filter (where status = 'ok') as events_min from status""",
        "sequences_date_time": _with(*base) + iso_events + " where depth is not null",
        "sequence_load_counts": "select count(*) as n_rows, count(distinct user_id) as n_sequences from events",
        "associate_space_time": _with(EV, CAT, PAIRS)
        + "select eq_id, event_id, t_us, mag, round(arc_deg, 6) as arc_deg from pairs",
        "associate_limit_20000": _with(EV, CAT, PAIRS)
        + """select eq_id, event_id, t_us, mag, round(arc_deg, 6) as arc_deg from (
  select *, row_number() over (partition by eq_id order by t_us desc, event_id desc) as rn from pairs)
where rn <= 20000""",
        "associate_salted": _with(EV, CAT, PAIRS)
        + "select eq_id, event_id, round(arc_deg, 6) as arc_deg from pairs",
        "associate_dense": _with(EV, CAT, PAIRS) + "select eq_id, event_id, round(arc_deg, 6) as arc_deg from pairs",
        "associate_newest_5": _with(EV, CAT, PAIRS)
        + """select eq_id, event_id, t_us from (
  select *, row_number() over (partition by eq_id order by t_us desc, event_id desc) as rn from pairs)
where rn <= 5""",
        "incremental_new": _with(EV, CAT)
        + f"select eq_id, t0_us, mainshock_mag from cat where t0_us >= {LOADED_BEFORE_US}",
        "load_status": _with(EV, CAT, PAIRS, STATUS)
        + "select * replace (round(lat, 6) as lat, round(lon, 6) as lon) from status",
        "load_summary": _with(EV, CAT, PAIRS, STATUS)
        + """select count(*) filter (where status in ('ok', 'cached', 'truncated')) as n_success,
  count(*) filter (where status = 'failed') as n_failed, count(*) filter (where status = 'empty') as n_empty,
  cast(sum(n_events) filter (where status in ('ok', 'cached', 'truncated')) as bigint) as events_total,
  round(avg(n_events) filter (where status in ('ok', 'cached', 'truncated')), 6) as events_mean,
  max(n_events) filter (where status in ('ok', 'cached', 'truncated')) as events_max,
  min(n_events) filter (where status in ('ok', 'cached', 'truncated')) as events_min from status""",
        "stream_load": _with(*base) + iso_events,
        "stream_load_repeats_by_10": _with(*base) + once,
        "stream_load_repeats_by_1": _with(*base) + once,
        "feature_table_round_trip": sample
        + """select year, count(*) as n, cast(sum(aftershock_count) as bigint) as aftershocks
from features group by year""",
        "cross_ridge": (trained + ", " + RIDGE).replace("with ", "with recursive ", 1)
        + f"""select r.eq_id, 'Ridge' as model, round(r.y, 6) as y, round(g + l.m + ym, 6) as y_hat
from rows_ r join fitted using (eq_id) join left_out l on l.eq_id = r.eq_id and l.j = {len(REGRESSION_COLUMNS) + 1}, label""",
        "feature_vectors": exact
        + "select eq_id, "
        + ", ".join(
            f"round(coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) over ())"
            f" / nullif(stddev_samp(coalesce({c}, 0)) over (), 0), 0), 6) as z_{c}"
            for c in VECTOR_COLUMNS
        )
        + " from features",
    }
    # the column name is a keyword in SQL
    return {name: re.sub(r"\bwindow\b", '"window"', sql) for name, sql in out.items()}
