"""Check SQL of the panel models: the within estimator in closed form.

Communities and months of the stored panel are complete and weights belong to communities, so taking
out community effects (and trends) and then weighted month effects gives the two-way residuals at once.
"""

from __future__ import annotations

from threadloom.operators.models import OUTCOMES, SPECS
from threadloom.plans import adapters as a
from threadloom.plans.core_sql import BUCKETS, COUNTS, CUT, INTER_TABLES, KEYWORDS, KEY_PARTS, P, POSTS, RESILIENCE, RESP, T, WITH, even_rounding, hit, idx, kind, r6, shown
from threadloom.plans.core_queries import INTERACTION_OUTCOMES


def two_sided(z: str) -> str:
    """Two-sided normal tail by the series of the error function, whose terms are all positive."""
    x = f"(abs({z}) / sqrt(2.0))"
    return f"case when {z} is null then null when {x} > 6 then 0.0 when {x} < 1e-12 then 1.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln({x}) - {x} * {x} - lgamma(j + 1.5))))) end"


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by its finite sums."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, cast({df} // 2 as bigint)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * cos({angle}) ** (2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, cast(({df} - 1) // 2 as bigint)), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * cos({angle}) ** (2 * j + 1))), 0.0))"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def within(rows: str, keys: str, xs: tuple[str, ...] = ("x",)) -> str:
    """CTEs from ``rows`` (keys, subreddit, month, t, y, w, trends and regressors) to ``fe``: estimate, variance and sizes of the first regressor.

    Further regressors are taken out of the first one after the other, the last first.
    """
    columns = ("y", *xs)
    k = [c.strip() for c in keys.split(",")]
    on = lambda u, v: " and ".join(f"{u}.{c} = {v}.{c}" for c in k)
    slope = lambda c: f"case when trends then coalesce(regr_slope({c}, t) over u, 0.0) * (t - avg(t) over u) else 0.0 end"
    ctes = [
        f"w1 as (select {keys}, subreddit, month, w, trends, {', '.join(f'{c} - avg({c}) over u - {slope(c)} as {c}' for c in columns)} from {rows} window u as (partition by {keys}, subreddit))",
        f"w2 as (select {keys}, subreddit, month, w, trends, {', '.join(f'{c} - sum(w * {c}) over m / sum(w) over m as {c}' for c in columns)} from w1 window m as (partition by {keys}, month))",
    ]
    last, n = "w2", 2
    for at in range(len(xs) - 1, 0, -1):  # take xs[at] out of everything before it
        q, rest = xs[at], ("y", *xs[:at])
        n += 1
        ctes.append(f"w{n} as (select {keys}, subreddit, month, w, trends, {', '.join(f'{c} - coalesce(sum(w * {c} * {q}) over k / nullif(sum(w * {q} * {q}) over k, 0), 0) * {q} as {c}' for c in rest)} from {last} window k as (partition by {keys}))")
        last = f"w{n}"
    x = xs[0]
    ctes += [
        f"wb as (select {keys}, sum(w * {x} * y) / sum(w * {x} * {x}) as estimate, sum(w * {x} * {x}) as sxx, count(*) as n_obs, count(distinct subreddit) as g, count(distinct month) as m, bool_or(trends) as tr from {last} group by {keys})",
        f"ws as (select {', '.join(f'v.{c}' for c in k)}, v.subreddit, sum(w * {x} * (y - estimate * {x})) as s from {last} v join wb on {on('v', 'wb')} group by {', '.join(f'v.{c}' for c in k)}, v.subreddit)",
        f"wv as (select {keys}, sum(s * s) as ss from ws group by {keys})",
        f"fe as (select {', '.join(f'wb.{c}' for c in k)}, estimate, n_obs, g as n_communities, m as n_months, sqrt(ss / sxx / sxx * g / (g - 1.0) * (n_obs - 1.0) / (n_obs - ({len(xs)} + g + m - 1 + case when tr then g else 0 end))) as std_error from wb join wv on {on('wb', 'wv')})",
    ]
    return ", ".join(ctes)


BASE = f"b as (select *, cast(community_type = 'health' as int) as health from p where community_type in ('general', 'health') and month <> '2022-11')"


def feature(o: str) -> str:
    """The nearest general community of each health community by the four features of one outcome."""
    return f"""(with ft as (select subreddit, health, avg(cast({o} as double)) as a, coalesce(regr_slope(cast({o} as double), {idx('month')} - {2022 * 12 + 11}), 0) as b, stddev_pop(cast({o} as double)) as c, avg(comments_per_submission) as d from b where month < '{CUT}' group by 1, 2),
fm as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc, avg(d) as md, stddev_pop(d) as sd from ft),
fz as (select subreddit, health, (a - ma) / coalesce(nullif(sa, 0), 1) as a, (b - mb) / coalesce(nullif(sb, 0), 1) as b, (c - mc) / coalesce(nullif(sc, 0), 1) as c, (d - md) / coalesce(nullif(sd, 0), 1) as d from ft, fm),
nn as (select h.subreddit, g.subreddit as matched, (h.a - g.a) ** 2 + (h.b - g.b) ** 2 + (h.c - g.c) ** 2 + (h.d - g.d) ** 2 as square from fz h, fz g where h.health = 1 and g.health = 0)
select matched as subreddit, cast(count(*) as double) as times from (select *, row_number() over (partition by subreddit order by round_(square), matched) as rn from nn) where rn = 1 group by 1)""".replace("round_(square)", "cast(square * 1e12 as hugeint)")


def spec_rows(o: str, s, log: bool = True, source: str = "b") -> str:
    """Rows of one outcome and specification."""
    raw, where, weight = f"coalesce(cast({o} as double), 0.0)", [], "1.0"
    if s.balanced:
        where.append(f"subreddit in (select subreddit from {source} group by 1 having count(distinct month) = (select count(distinct month) from {source}))")
    if s.without_top_general:
        where.append(f"subreddit not in (select subreddit from {source} where health = 0 and month < '{s.cutoff}' group by 1 order by sum(comments) desc, subreddit limit {s.without_top_general})")
    if s.winsorized:
        raw = f"greatest((select quantile_cont(cast({o} as double), 0.01) from {source}), least((select quantile_cont(cast({o} as double), 0.99) from {source}), {raw}))"
    if s.weighted:
        weight = f"greatest(1.0, coalesce(sum(case when month < '{s.cutoff}' then comments + submissions end) over (partition by subreddit), 0))"
    table = source
    if s.matched:
        table = f"{source} left join {feature(o)} tm using (subreddit)"
        weight = "case when health = 1 then 1.0 else tm.times end"
        where.append("(health = 1 or tm.times > 0)")
    y = f"ln(1 + greatest({raw}, 0.0))" if log else raw
    return f"select '{o}' as outcome_name, '{s.name}' as model, subreddit, month, {idx('month')} as t, {y} as y, health * cast(month >= '{s.cutoff}' as double) as x, {weight} as w, {str(s.trends).lower()} as trends from {table} {'where ' + ' and '.join(where) if where else ''}"


FIT = f"estimate, std_error, {two_sided('estimate / nullif(std_error, 0)')} as p_value"
LR = f"lr as ({' union all '.join(f'({spec_rows(o, s)})' for o in OUTCOMES for s in SPECS)})"
TWFE = f"with {P}, {BASE}, {LR}, {within('lr', 'outcome_name, model')}, tw as (select outcome_name, model, {FIT}, n_obs, n_communities, n_months from fe)"


def events(source: str, outcomes: tuple[str, ...], log: bool) -> str:
    """CTEs to ``ev``: estimates and errors per event bin against bin -2, for complete panels without weights."""
    y = lambda o: f"ln(1 + greatest(coalesce(cast({o} as double), 0.0), 0.0))" if log else f"coalesce(cast({o} as double), 0.0)"
    rows = " union all ".join(f"select '{o}' as outcome_name, subreddit, month, health, cast(greatest(-6, least(24, {idx('month')} - {2022 * 12 + 11})) as int) as bin, {y(o)} as y from {source}" for o in outcomes)
    return f"""e0 as ({rows}), e1 as (select *, y - avg(y) over (partition by outcome_name, subreddit) as d from e0),
em as (select outcome_name, month, bin, avg(d) as m, avg(d) filter (health = 1) - avg(d) filter (health = 0) as gap from e1 group by 1, 2, 3),
eg as (select outcome_name, bin, avg(gap) as gap from em group by 1, 2),
eh as (select outcome_name, count(distinct subreddit) filter (health = 1) as h, count(distinct subreddit) filter (health = 0) as g, count(*) as n, count(distinct month) as months, count(distinct bin) as bins from e0 group by 1),
e2 as (select e1.outcome_name, e1.subreddit, e1.health, e1.bin, d - em.m - (e1.health - h / cast(h + g as double)) * eg.gap as e from e1 join em on em.outcome_name = e1.outcome_name and em.month = e1.month
  join eg on eg.outcome_name = e1.outcome_name and eg.bin = e1.bin join eh on eh.outcome_name = e1.outcome_name),
eu as (select outcome_name, subreddit, health, bin, avg(e) as e from e2 group by 1, 2, 3, 4),
es as (select u.outcome_name, u.bin, sum(((u.e - r.e) / case when u.health = 1 then h else g end) ** 2) as ss from eu u join eu r on r.outcome_name = u.outcome_name and r.subreddit = u.subreddit and r.bin = -2 join eh on eh.outcome_name = u.outcome_name group by 1, 2),
e3 as (select eg.outcome_name, eg.bin as event_bin, eg.gap - r.gap as estimate, sqrt(ss * (h + g) / (h + g - 1.0) * (n - 1.0) / (n - (bins - 1 + h + g + months - 1))) as std_error from eg join eg r on r.outcome_name = eg.outcome_name and r.bin = -2
  join es on es.outcome_name = eg.outcome_name and es.bin = eg.bin join eh on eh.outcome_name = eg.outcome_name where eg.bin <> -2 union all select outcome_name, -2, 0.0, 0.0 from eh),
ev as (select outcome_name, event_bin, {FIT}, estimate - 1.96 * std_error as ci_low, estimate + 1.96 * std_error as ci_high from e3)"""


EVENT_COLUMNS = shown(["estimate", "std_error", "p_value", "ci_low", "ci_high"])
OBSERVED = f"{WITH}, {INTER_TABLES}, {P}, io as (select ix.*, p.comments, p.submissions, cast(p.community_type = 'health' as int) as health from ix join p on p.subreddit = ix.subreddit and p.month = ix.month where author_history_observed = 1 and p.community_type in ('general', 'health') and ix.month <> '2022-11')"
INTERACTION_ROWS = f"lr as ({' union all '.join(f'({spec_rows(o, s, False, chr(105) + chr(111))})' for o in INTERACTION_OUTCOMES for s in (SPECS[0], SPECS[5]))})"
BH = """bk as (select *, row_number() over (partition by model order by p_value) as r, count(*) over (partition by model) as n from tw where p_value is not null),
bq as (select *, least(1.0, min(p_value * n / r) over (partition by model order by r desc rows between unbounded preceding and current row)) as q_value from bk)"""

MODERATED = {"conc": ["top5_share", "top1_share", "gini", "hhi", "top_1pct_share"], "db": ["threading_ratio", "mean_depth"], "rm": ["reply_rate", "unanswered_rate", "op_followup_rate", "median_latency_hours"]}
MODERATOR_CELLS = f"""mo as (select p.subreddit, {', '.join(f"avg(coalesce({t}.{c}, 0)) as {'pct1_share' if c == 'top_1pct_share' else c}" for t, cs in MODERATED.items() for c in cs)} from p
  {' '.join(f'left join {t} on {t}.subreddit = p.subreddit and {t}.month = p.month' for t in MODERATED)} where p.month < '{CUT}' group by 1)"""
MODERATION_ROWS = f"""mr as ({' union all '.join(f"select '{o}' as outcome_name, '{m}' as moderator, p.subreddit, p.month, {idx('p.month')} as t, ln(1 + greatest(cast({o} as double), 0.0)) as y, cast(community_type = 'health' as double) as h, cast(p.month >= '{CUT}' as double) as post, coalesce(mo.{m}, 0.0) as v from p left join mo on mo.subreddit = p.subreddit where community_type in ('general', 'health')" for o in OUTCOMES for m in a.MODERATORS)})"""


def moderated(model: str, x: str, keep: str, xs: tuple[str, ...]) -> str:
    """A whole query of one kind of moderation model."""
    return f"""(with lr as (select outcome_name, moderator, subreddit, month, t, y, 1.0 as w, false as trends, {x} from mr where {keep}), {within('lr', 'outcome_name, moderator', xs)}
select outcome_name, moderator, '{model}' as model, {FIT}, n_obs, n_communities from fe)"""


def effects_of(o: str, match: str) -> str:
    """Standardised mean difference of one sample."""
    return f"""select '{'matched' if match else 'unmatched'}' as sample, sum(case when health = 1 then v * w end) / sum(case when health = 1 then w end) as health_mean, sum(case when health = 0 then v * w end) / sum(case when health = 0 then w end) as general_mean,
  stddev_pop(v) as spread from (select health, cast({o} as double) as v, {'case when health = 1 then 1.0 else tm.times end' if match else '1.0'} as w from b {match} where month < '{CUT}') where w > 0"""


TESTS = f"""{RESILIENCE}, ol as (select count(*) as n, corr(rx, ry) as rho, regr_slope(pct_change, threading_ratio) as slope, regr_r2(pct_change, threading_ratio) as r2 from prr),
mw as (select count(*) filter (grp = 'high') as n1, count(*) filter (grp = 'low') as n2, sum(ry) filter (grp = 'high') - count(*) filter (grp = 'high') * (count(*) filter (grp = 'high') + 1) / 2.0 as u from prr),
ti as (select coalesce(sum(cast(c as double) ** 3 - c), 0.0) as tied from (select count(*) as c from prr group by pct_change)),
ex as (select count(*) filter (list_sum(list_transform(range(0, 16), lambda j: case when (m >> j) & 1 = 1 then j + 1 else 0 end)) - n1 * (n1 + 1) / 2.0 <= least(u, n1 * n2 - u)) / cast(count(*) as double) as tail
  from mw, range(0, 65536) x(m) where n1 + n2 <= 16 and m < (1 << cast(n1 + n2 as int)) and bit_count(cast(m as bigint)) = n1),
sp as (select (select tail from ex) as tail, tied, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - tied / (cast(n1 + n2 as double) * (n1 + n2 - 1)))) as spread, n1, n2, u from mw, ti)"""

CRC = """bits(i, k, v) as (select i, 0, i from range(0, 256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select list(v order by i) as v from bits where k = 8), links as (select link, count(*) as n from c where link is not null group by 1),
walk(link, n, k, crc) as (select link, n, 0, 4294967295::bigint from links union all select link, n, k + 1, xor(crc >> 8, tab.v[(xor(crc, unicode(substr(link, k + 1, 1))) & 255) + 1]) from walk, tab where k < length(link))"""

_ROUNDED = {
    "twfe_did": f"{TWFE} select outcome_name, model, {shown(['estimate', 'std_error', 'p_value'])}, n_obs, n_communities, n_months from tw",
    "smallest_p_values": f"{TWFE} select outcome_name, model, {shown(['estimate', 'std_error', 'p_value'])}, n_obs, n_communities, n_months from tw where p_value is not null order by tw.p_value, outcome_name, model limit 5",
    "event_study": f"with {P}, {BASE}, {events('b', OUTCOMES, True)} select outcome_name, event_bin, {EVENT_COLUMNS} from ev",
    "leave_one_out": f"""with {P}, {BASE}, one as ({spec_rows('comments', SPECS[0])}), lr as (select n.subreddit as omitted, one.* from one, (select distinct subreddit from one) n where one.subreddit <> n.subreddit), {within('lr', 'omitted')}
select omitted, {', '.join(f'{r6(x)} as {c}' for c, x in (('estimate', 'estimate'), ('std_error', 'std_error'), ('p_value', two_sided('estimate / nullif(std_error, 0)'))))} from fe""",
    "interaction_outcomes": f"{OBSERVED}, {INTERACTION_ROWS}, {within('lr', 'outcome_name, model')}, tv as (select outcome_name, model, {FIT}, n_obs, n_communities, n_months from fe), tw as (select outcome_name, model, {shown(['estimate', 'std_error', 'p_value'])}, n_obs, n_communities, n_months from tv), {BH} select * exclude (r, n) from bq",
    "interaction_events": f"{OBSERVED}, {events('io', tuple(INTERACTION_OUTCOMES), False)} select outcome_name, event_bin, {EVENT_COLUMNS} from ev",
    "moderation": f"""{WITH}, {POSTS}, {RESP}, {BUCKETS}, {COUNTS}, {P}, {MODERATOR_CELLS}, {MODERATION_ROWS}, every as ({moderated('within_health', 'post * v as x', 'h = 1', ('x',))}
union all {moderated('triple_interaction', 'h * post * v as x, h * post as x2, post * v as x3', 'true', ('x', 'x2', 'x3'))}) select outcome_name, moderator, model, {shown(['estimate', 'std_error', 'p_value'])}, n_obs, n_communities from every""",
    "smd_balance": f"with {P}, {BASE}, sm as ({effects_of('comments', '')} union all {effects_of('comments', f'left join {feature(chr(99) + 'omments')} tm using (subreddit)')}) select sample, {shown(['health_mean', 'general_mean'])}, round(coalesce((health_mean - general_mean) / nullif(spread, 0), 0.0), 6) as smd from sm",
    "resilience_tests": f"""{TESTS} select 'spearman' as test, n, {r6('rho')} as statistic, {r6(t_tail('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)'))} as p_value from ol
union all select 'ols_slope', n, {r6('slope')}, {r6(t_tail('sqrt(r2 * (n - 2) / (1 - r2))', '(n - 2)'))} from ol union all select 'mann_whitney_u', n1 + n2, {r6('u')}, {r6(f"case when least(n1, n2) <= 8 and tied = 0 and tail is not null then least(1.0, 2 * tail) else least(1.0, {two_sided('((abs(u - n1 * n2 / 2.0) - 0.5) / spread)')}) end")} from sp""",
    "thread_shards": f"{WITH}, {CRC} select cast(xor(crc, 4294967295) % 16 as int) as shard, cast(sum(n) as bigint) as n, count(*) as threads from walk where k = length(link) group by 1",
    "key_results": f"""{WITH}, {INTER_TABLES}, {RESP}, {P}, {T}, {KEYWORDS}, {COUNTS}, {BASE}, lr as ({' union all '.join(f'({spec_rows(o, SPECS[0])})' for o in OUTCOMES)}), {within('lr', 'outcome_name, model')},
kk as (select record_kind, subreddit, month, avg({hit('text', a.MENTIONS)}) as mention_share from t where month is not null and record_kind is not null group by 1, 2, 3),
kc as (select subreddit, month, case when record_kind = 'comment' then mention_share end as comment_mention_share, case when record_kind = 'submission' then mention_share end as submission_mention_share from kk), """
    + "kp as ("
    + " union all ".join(
        f"select {kind()} as community_type, {period} as period, '{c}' as measure, avg({c}) as value, '{section}' as section from {source} group by 1, 2"
        for section, source, columns in KEY_PARTS for c in columns for period in (f"case when month < '{CUT}' then 'pre' else 'post' end", "'all'")
    )
    + " union all select 'all', 'all', 'n_communities', count(distinct subreddit), 'panel' from p union all select 'all', 'all', 'n_months', count(distinct month), 'panel' from p"
    + " union all select community_type, 'all', 'total_comments', sum(comments), 'panel' from p group by 1 union all select community_type, 'all', 'total_submissions', sum(submissions), 'panel' from p group by 1"
    + f" union all select 'all', 'all', outcome_name || '_estimate', estimate, 'did' from fe) select community_type, period, measure, {r6('value')} as value, section from kp",
}
ORACLE = {name: even_rounding(sql) for name, sql in _ROUNDED.items()}
