"""Check queries for the discussion operators."""

from __future__ import annotations

from threadloom.functions.columns import BLANKS
from threadloom.plans import adapters as a
from threadloom.plans import sql_text as q
from threadloom.plans.problem_sql import NODES
from threadloom.sources.jsonl import months_between

MONTHS = months_between(a.FIRST_MONTH, a.LAST_MONTH)
CUT = "2022-12"


def written(x: str) -> str:
    return f"case when coalesce(lower({q.strip(x)}), '') not in {q.MARKS} and {x} <> '' then {x} end"


def placeholder(x: str) -> str:
    return f"coalesce(lower({q.strip(x)}) in {q.MARKS}, false)"


def kind(x: str = "subreddit") -> str:
    names = lambda group: ", ".join(f"'{n}'" for n in group)
    return f"case when {x} in ({names(a.GENERAL)}) then 'general' when {x} in ({names(a.HEALTH)}) then 'health' else 'other' end"


def idx(m: str) -> str:
    return f"(cast(substr({m}, 1, 4) as int) * 12 + cast(substr({m}, 6, 2) as int) - 1)"


def ratio(x: str, y: str) -> str:
    return f"coalesce(cast({x} as double) / nullif(cast({y} as double), 0), 0.0)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


S = f"s as (select {q.post('submission_id')} as sid, coalesce({q.name('subreddit')}, 'unknown') as subreddit, author, title, score, created_utc, {q.month('created_utc')} as month from submissions)"
C = f"c as (select comment_id, {q.post('submission_id')} as link, parent_id, coalesce({q.name('subreddit')}, 'unknown') as subreddit, author, body, score, created_utc, {q.month('created_utc')} as month from comments)"
DEPTHS = f"{NODES}, depths as (select id as comment_id, level as depth from tree where state = 'resolved')"
WITH = f"with recursive {S}, {C}, {DEPTHS}"
PLAIN = f"with {S}, {C}"

CELLS = f"""sc as (select subreddit, month, count(*) as submissions, count(distinct {written('author')}) as unique_submission_authors,
    coalesce(avg(case when not (author is null or {placeholder('title')}) then length(coalesce(title, '')) end), 0.0) as mean_title_length,
    avg(cast(author is null or {placeholder('title')} as int)) as removed_submission_share, coalesce(avg(score), 0.0) as mean_submission_score
  from s where month is not null group by 1, 2),
cl as (select *, case when not {placeholder('body')} then length(coalesce(body, '')) end as len from c where month is not null),
cc as (select subreddit, month, count(*) as comments, count(distinct {written('author')}) as unique_comment_authors, coalesce(avg(len), 0.0) as mean_comment_length,
    avg(cast({placeholder('body')} as int)) as removed_comment_share, coalesce(avg(score), 0.0) as mean_comment_score, coalesce(median(len), 0.0) as median_comment_length from cl group by 1, 2)"""
PANEL_COLUMNS = ["submissions", "unique_submission_authors", "mean_title_length", "removed_submission_share", "mean_submission_score"], [
    "comments", "unique_comment_authors", "mean_comment_length", "removed_comment_share", "mean_comment_score", "median_comment_length",
]


def calendar(parts: str) -> str:
    return f"""names as (select distinct subreddit from ({parts})), ends as (select min({idx('month')}) as lo, max({idx('month')}) as hi from ({parts})),
grid as (select subreddit, printf('%04d-%02d', k // 12, k % 12 + 1) as month from names, ends, range(0, 40000) t(k) where k between lo and hi)"""


def shares(rows: str, p: str = "") -> str:
    """CTEs from counts per community, month and author to the shares ``conc``; ``p`` begins the names of all of them."""
    return f"""{p}mc as ({rows}),
{p}rk as (select *, row_number() over (partition by subreddit, month order by n desc, author) as r, row_number() over (partition by subreddit, month order by n, author) as up,
  count(*) over (partition by subreddit, month) as k, sum(n) over (partition by subreddit, month) as t from {p}mc),
{p}conc as (select subreddit, month, cast(max(t) as bigint) as total_comments, max(k) as unique_authors,
  {ratio('sum(n) filter (r <= 1)', 'max(t)')} as top1_share, {ratio('sum(n) filter (r <= 5)', 'max(t)')} as top5_share, {ratio('sum(n * n)', 'max(t) * max(t)')} as hhi,
  {ratio('sum((2 * up - k - 1) * n)', 'max(k) * max(t)')} as gini,
  {ratio('sum(n) filter (r <= greatest(1, ceil(k * 0.01)))', 'max(t)')} as top_1pct_share,
  {ratio('sum(n) filter (r > greatest(1, ceil(k * 0.01)) and r <= greatest(greatest(1, ceil(k * 0.01)) + 1, ceil(k * 0.1)))', 'max(t)')} as next_9pct_share,
  {ratio('sum(n) filter (r > greatest(greatest(1, ceil(k * 0.01)) + 1, ceil(k * 0.1)))', 'max(t)')} as last_90pct_share from {p}rk group by 1, 2)"""


COUNTS = shares(
    f"select subreddit, month, author, sum(n) as n from (select {q.name('subreddit')} as subreddit, month, {written('author')} as author, coalesce(comment_count, 0) as n from author_counts) "
    "where subreddit is not null and month is not null and author is not null group by 1, 2, 3 having sum(n) > 0"
)
OWN_COUNTS = shares(f"select subreddit, month, {written('author')} as author, count(*) as n from c where month is not null and {written('author')} is not null group by 1, 2, 3", "own_")

FIRST = "fp as (select sid, subreddit, author as op, created_utc as posted, month from (select *, row_number() over (partition by sid order by created_utc is null, created_utc, author nulls first, subreddit) as rn from s where sid is not null) where rn = 1)"
POSTS = f"""{FIRST},
cd as (select c.*, d.depth, {q.author('c.author')} as named from c left join depths d using (comment_id) where link is not null and created_utc is not null),
pa as (select link, author, any_value(named) as named, count(*) as n, min(created_utc) as first, count(*) filter (depth = 1) as direct, count(*) filter (depth >= 2) as deep, max(depth) as deepest from cd group by 1, 2),
pj as (select pa.*, coalesce(pa.author = fp.op, false) as own, named is not null and not coalesce(pa.author = fp.op, false) as helper from pa join fp on fp.sid = pa.link),
pm as (select fp.sid as submission_id, fp.subreddit, fp.op as author, fp.posted as created_utc, fp.month, cast(coalesce(sum(n), 0) as bigint) as num_comments_observed,
  cast(coalesce(sum(n) filter (own), 0) as bigint) as op_followup_comments, cast(coalesce(sum(direct), 0) as bigint) as direct_reply_count, cast(coalesce(sum(deep), 0) as bigint) as deep_reply_count,
  coalesce(max(deepest), 0) as max_depth, count(*) filter (named is not null) as unique_commenters, count(*) filter (helper) as unique_non_op_commenters,
  coalesce(max(n) filter (helper), 0) as top_helper_comments, cast(coalesce(sum(n) filter (helper), 0) as bigint) as helper_comments,
  case when min(first) is not null and fp.posted is not null then greatest(0.0, (min(first) - fp.posted) / 60.0) when min(first) is not null then 0.0 end as first_reply_latency_minutes
  from fp left join pj on pj.link = fp.sid group by fp.sid, fp.subreddit, fp.op, fp.posted, fp.month)"""
RESP = f"""rm as (select subreddit, month, count(*) as posts, avg(cast(num_comments_observed > 0 as int)) as reply_rate, avg(cast(op_followup_comments > 0 as int)) as op_followup_rate,
  coalesce(quantile_cont(h, 0.5), 0) as median_latency_hours, coalesce(quantile_cont(h, 0.25), 0) as p25_latency_hours, coalesce(quantile_cont(h, 0.75), 0) as p75_latency_hours,
  avg(num_comments_observed) as mean_comments, quantile_cont(cast(num_comments_observed as double), 0.5) as median_comments, avg(unique_commenters) as mean_commenters,
  avg(direct_reply_count) as mean_direct_replies, avg(deep_reply_count) as mean_deep_replies, avg(max_depth) as mean_max_depth, 1 - avg(cast(num_comments_observed > 0 as int)) as unanswered_rate
  from (select *, case when num_comments_observed > 0 then first_reply_latency_minutes / 60.0 end as h from pm) where month is not null group by 1, 2)"""
STRUCTURE = """ts as (select subreddit, month, count(*) as posts, avg(cast(op_followup_comments > 0 as int)) as op_return_share, avg(cast(num_comments_observed > 0 and max_depth <= 1 as int)) as single_commenter_thread_share,
  avg(cast(unique_non_op_commenters >= 3 as int)) as multi_actor_share, avg(cast(helper_comments > 0 and top_helper_comments / nullif(cast(helper_comments as double), 0) > 0.5 as int)) as focused_share_,
  avg(case when helper_comments > 0 and top_helper_comments / cast(helper_comments as double) > 0.5 then 1 else 0 end) as focused_share,
  avg(case when unique_non_op_commenters >= 5 and coalesce(top_helper_comments / nullif(cast(helper_comments as double), 0), 0.0) <= 0.3 then 1 else 0 end) as distributed_share
  from pm where month is not null group by 1, 2)"""
EDGES = f"""pau as (select comment_id, min({q.author('author')}) as pa from c group by 1),
er as (select c.subreddit, c.month, {q.author('c.author')} as source, case when n.ptr is not null then p.pa else {q.author('fp.op')} end as target
  from c join fp on fp.sid = c.link join depths d on d.comment_id = c.comment_id join nodes n on n.id = c.comment_id left join pau p on p.comment_id = n.ptr where c.month is not null),
ed as (select subreddit, month, source, target, count(*) as edge_count from er where source is not null and target is not null and source <> target group by 1, 2, 3, 4),
dp as (select subreddit, month, least(source, target) as x, greatest(source, target) as y, count(*) as directions, sum(edge_count) as replies from ed group by 1, 2, 3, 4),
dy as (select subreddit, month, count(*) as dyads, cast(sum(replies) as bigint) as replies, avg(cast(directions = 2 as int)) as reciprocal_dyad_share, sum(case when replies >= 2 then replies else 0 end) / cast(sum(replies) as double) as repeat_dyad_share from dp group by 1, 2)"""
ACTIVITY = f"""act as (select subreddit, month, author, count(*) as activity_count from (select subreddit, month, {q.author('author')} as author from s union all select subreddit, month, {q.author('author')} from c)
  where month is not null and author is not null group by 1, 2, 3),
ai as (select *, {idx('month')} as i from act)"""
HISTORY = """ah as (select a.subreddit, a.month, count(*) as unique_authors,
  avg(case when not exists (select 1 from ai b where b.subreddit = a.subreddit and b.author = a.author and b.i < a.i) then 1 else 0 end) as new_author_share,
  avg(case when exists (select 1 from ai b where b.subreddit = a.subreddit and b.author = a.author and b.i < a.i) and not exists (select 1 from ai b where b.subreddit = a.subreddit and b.author = a.author and b.i = a.i - 1) then 1 else 0 end) as returning_author_share,
  avg(case when exists (select 1 from ai b where b.subreddit = a.subreddit and b.author = a.author and b.i = a.i - 1) then 1 else 0 end) as repeat_author_share
  from ai a group by 1, 2)"""
HELPERS = f"""hp as (select {q.post('submission_id')} as sid, {q.name('subreddit')} as subreddit, month, {q.author('author')} as author, num_comments_observed as n from post_metrics),
hm as (select p.subreddit, {idx('p.month')} as i, {q.author('h.commenter')} as helper, sum(coalesce(h.comment_count, 0)) as n from helper_counts h join hp p on p.sid = {q.post('h.submission_id')}
  where h.is_non_op = 1 and p.month is not null and {q.author('h.commenter')} is not null group by 1, 2, 3)"""
MONTH_OF = "printf('%04d-%02d', i // 12, i % 12 + 1) as month"
GRID = "ag as (select subreddit, unnest(generate_series(min(i), max(i))) as i from ai group by 1)"
ROLLING = f"""win as (select g.subreddit, g.i, m.helper, sum(case when m.i > g.i - 12 then m.n end) as n, max(cast(m.i > g.i - 12 as int)) as now, max(cast(m.i <= g.i - 12 as int)) as was
  from ag g join hm m on m.subreddit = g.subreddit and m.i between g.i - 23 and g.i group by 1, 2, 3),
wr as (select *, row_number() over (partition by subreddit, i order by n desc nulls last, helper) as r from win),
ws as (select subreddit, i, sum(now) as rh, sum(was) as er, sum(now * was) as co, cast(sum(n) as double) as t, sum(cast(n as double) * n) as sq, sum(n) filter (r <= 5) as t5 from wr group by 1, 2),
rh as (select g.subreddit, g.i, cast(coalesce(rh, 0) as bigint) as rolling_helpers, {ratio('t * t', 'sq')} as effective_helpers, {ratio('t5', 't')} as top5_helper_share, {ratio('co', 'rh + er - co')} as helper_jaccard
  from ag g left join ws w on w.subreddit = g.subreddit and w.i = g.i)"""


def back(table: str, who: str, h: int, of: str = "true") -> str:
    return f"avg(case when {of} then case when exists (select 1 from {table} b where b.subreddit = a.subreddit and b.{who} = a.{who} and b.i = a.i + {h}) then 1 else 0 end end)"


NEW = "not exists (select 1 from ai b where b.subreddit = a.subreddit and b.author = a.author and b.i < a.i)"


CONTRIB = f"""co as (select a.subreddit, a.i, count(*) as active_contributors,
  count(*) filter ({NEW}) as new_contributors, {', '.join(f"{back('ai', 'author', h)} as contributor_return_{h}m" for h in (1, 3, 6))},
  {', '.join(f"coalesce({back('ai', 'author', h, NEW)}, 0.0) as newcomer_return_{h}m" for h in (1, 3, 6))} from ai a group by 1, 2),
con as (select *, {ratio('new_contributors', 'active_contributors')} as newcomer_share from co)"""
RETURN = f"hr as (select a.subreddit, a.i, count(*) as monthly_helpers, {', '.join(f'{back('hm', 'helper', h)} as helper_return_{h}m' for h in (1, 3, 6))} from hm a group by 1, 2)"
NEWCOMER = f"""np as (select p.subreddit, {idx('p.month')} as i, count(*) as newcomer_posts, avg(cast(coalesce(p.n, 0) > 0 as int)) as newcomer_reply_rate from hp p
  join (select subreddit, author, min(i) as i from ai group by 1, 2) f on f.subreddit = p.subreddit and f.author = p.author and f.i = {idx('p.month')} group by 1, 2)"""
CAPACITY = f"{PLAIN}, {ACTIVITY}, {HELPERS}, {GRID}, {ROLLING}, {CONTRIB}, {RETURN}, {NEWCOMER}"
CAP_COLUMNS = {
    "con": ["active_contributors", "new_contributors", "contributor_return_1m", "contributor_return_3m", "contributor_return_6m", "newcomer_share", "newcomer_return_1m", "newcomer_return_3m", "newcomer_return_6m"], "np": ["newcomer_posts", "newcomer_reply_rate"],
    "rh": ["rolling_helpers", "effective_helpers", "top5_helper_share", "helper_jaccard"], "hr": ["monthly_helpers", "helper_return_1m", "helper_return_3m", "helper_return_6m"],
}
CAP_ROWS = f"""cap as (select ag.subreddit, ag.i, {', '.join(f'coalesce({t}.{c}, 0) as {c}' for t, cs in CAP_COLUMNS.items() for c in cs)} from ag
  {' '.join(f'left join {t} on {t}.subreddit = ag.subreddit and {t}.i = ag.i' for t in CAP_COLUMNS)})"""
RATES = {"newcomer_return_1m", "newcomer_return_3m", "newcomer_return_6m", "contributor_return_1m", "contributor_return_3m", "contributor_return_6m", "newcomer_share", "newcomer_reply_rate", "effective_helpers", "top5_helper_share", "helper_jaccard", "helper_return_1m", "helper_return_3m", "helper_return_6m"}


def shown(columns: list[str], rounded: set[str] | None = None) -> str:
    return ", ".join(f"{r6(c)} as {c}" if rounded is None or c in rounded else c for c in columns)


T = f"t as (select doc_id, text, record_kind, lang, coalesce({q.name('subreddit')}, 'unknown') as subreddit, {q.month('created_utc')} as month from documents)"


def hit(x: str, pattern: str) -> str:
    return f"cast(coalesce(regexp_matches({x}, '(?i){pattern}'), false) as int)"


STRATA = f"select doc_id, record_kind, {kind()} as community_type, case when month < '{CUT}' then 'pre' else 'post' end as period from t where month is not null and record_kind is not null"
BUCKETS = f"""dr as (select c.subreddit, coalesce(c.month, 'unknown') as month, d.depth from c join depths d using (comment_id)),
db0 as (select subreddit, month, count(*) as n, cast(sum(depth) as bigint) as depth_sum, cast(max(depth) as bigint) as max_depth, count(*) filter (depth = 1) as depth_1, count(*) filter (depth = 2) as depth_2, count(*) filter (depth >= 3) as depth_3plus from dr group by 1, 2
  union all select 'ALL', month, count(*), cast(sum(depth) as bigint), cast(max(depth) as bigint), count(*) filter (depth = 1), count(*) filter (depth = 2), count(*) filter (depth >= 3) from dr group by 2),
db as (select *, depth_sum / cast(n as double) as mean_depth, (depth_2 + depth_3plus) / cast(n as double) as threading_ratio from db0)"""
PROFILE = f"""cal as (select count(*) filter (month < '2022-11') as pre, count(*) filter (month >= '2022-11') as post from (select distinct month from db where month <> 'unknown')),
pr0 as (select subreddit, sum(n) filter (month < '2022-11') as a, sum(n) filter (month >= '2022-11') as b, count(*) filter (month < '2022-11') as pre_months, count(*) filter (month >= '2022-11') as post_months,
  sum(depth_2 + depth_3plus) filter (month < '2022-11') as th, sum(depth_sum) filter (month < '2022-11') as ds from db where subreddit <> 'ALL' and month <> 'unknown' group by 1),
pr as (select subreddit, a / cast(pre as double) as pre_mean, coalesce(b, 0) / cast(post as double) as post_mean, (coalesce(b, 0) / cast(post as double) - a / cast(pre as double)) / (a / cast(pre as double)) * 100 as pct_change,
  th / cast(a as double) as threading_ratio, ds / cast(a as double) as mean_depth, pre_months, post_months from pr0, cal where pre_months >= 3 and post_months >= 3 and a / cast(pre as double) >= 1.0),
prr as (select *, case when threading_ratio >= (select quantile_cont(threading_ratio, 0.5) from pr) then 'high' else 'low' end as grp,
  rank() over (order by threading_ratio) + (count(*) over (partition by threading_ratio) - 1) / 2.0 as rx, rank() over (order by pct_change) + (count(*) over (partition by pct_change) - 1) / 2.0 as ry from pr)"""
RESILIENCE = f"{WITH}, {BUCKETS}, {PROFILE}"

P = f"""p as (select {q.name('subreddit')} as subreddit, month, coalesce(comments, 0) as comments, coalesce(submissions, 0) as submissions,
  {ratio('coalesce(comments, 0)', 'coalesce(submissions, 0)')} as comments_per_submission, {kind(q.name('subreddit'))} as community_type from monthly_panel where {q.name('subreddit')} is not null and month is not null),
f as (select *, cast(community_type = 'health' as int) as health, cast(month >= '{CUT}' as int) as post, {idx('month')} - {2022 * 12 + 11} as time_index, cast(comments as double) as raw_outcome, ln(1 + greatest(cast(comments as double), 0.0)) as outcome
  from p where community_type in ('general', 'health') and month <> '2022-11')"""
FEATURE = """ft as (select subreddit, health, avg(raw_outcome) as a, coalesce(regr_slope(raw_outcome, time_index), 0) as b, stddev_pop(raw_outcome) as c, avg(comments_per_submission) as d from f where month < '2022-12' group by 1, 2),
fm as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc, avg(d) as md, stddev_pop(d) as sd from ft),
fz as (select subreddit, health, (a - ma) / coalesce(nullif(sa, 0), 1) as a, (b - mb) / coalesce(nullif(sb, 0), 1) as b, (c - mc) / coalesce(nullif(sc, 0), 1) as c, (d - md) / coalesce(nullif(sd, 0), 1) as d from ft, fm),
nn as (select h.subreddit, g.subreddit as matched, sqrt((h.a - g.a) ** 2 + (h.b - g.b) ** 2 + (h.c - g.c) ** 2 + (h.d - g.d) ** 2) as distance from fz h, fz g where h.health = 1 and g.health = 0),
nm as (select subreddit, matched, distance from (select *, row_number() over (partition by subreddit order by round(distance * distance, 12), matched) as rn from nn) where rn = 1)"""
ZS = {c: sign for c, sign in (("op_return_share", 1), ("reciprocal_dyad_share", 1), ("repeat_dyad_share", 1), ("repeat_author_share", 1))}
ZI = {"unique_authors": 1, "new_author_share": 1, "distributed_share": 1, "focused_share": -1}
INTER_COLUMNS = {
    "ah": ["unique_authors", "new_author_share", "returning_author_share", "repeat_author_share"], "ts": ["posts", "op_return_share", "single_commenter_thread_share", "multi_actor_share", "focused_share", "distributed_share"],
    "dy": ["dyads", "replies", "reciprocal_dyad_share", "repeat_dyad_share"],
}


def z(c: str) -> str:
    m, s, flat = (f"(select {f} from im where seen >= 6 and unique_authors > 0 and month < '2022-11')" for f in (f"avg({c})", f"stddev_pop({c})", f"min({c}) = max({c})"))
    return f"case when {flat} then 0.0 else coalesce(({c} - {m}) / nullif({s}, 0), 0.0) end"


INTER_TABLES = f"""{POSTS}, {STRUCTURE}, {EDGES}, {ACTIVITY}, {HISTORY}, {calendar("select subreddit, month from ah union all select subreddit, month from ts union all select subreddit, month from dy")},
im as (select grid.subreddit, grid.month, {', '.join(f'coalesce({t}.{c}, 0) as {c}' for t, cs in INTER_COLUMNS.items() for c in cs)}, row_number() over (partition by grid.subreddit order by grid.month) - 1 as seen
  from grid {' '.join(f'left join {t} on {t}.subreddit = grid.subreddit and {t}.month = grid.month' for t in INTER_COLUMNS)}),
ix as (select im.*, cast(seen >= 6 as int) as author_history_observed, case when unique_authors > 0 then {' + '.join(z(c) for c in ZS)} else 0.0 end as bond_index,
  case when unique_authors > 0 then {' + '.join(('' if sign > 0 else '-1 * ') + z(c) for c, sign in ZI.items())} else 0.0 end as identity_index from im)"""
INTERACTIONS = f"""{WITH}, {INTER_TABLES}
select subreddit, month, author_history_observed, {', '.join(f"{r6(c)} as {c}" if c.endswith('share') else c for cs in INTER_COLUMNS.values() for c in cs)}, {shown(['bond_index', 'identity_index'])} from ix"""

KEY_PARTS = (
    ("panel", "p", ["comments", "submissions", "comments_per_submission"]), ("responsiveness", "rm", ["reply_rate", "unanswered_rate", "op_followup_rate", "median_latency_hours"]), ("mentions", "kw", ["mention_share"]),
    ("mentions", "kc", ["comment_mention_share", "submission_mention_share"]), ("concentration", "conc", ["gini", "top5_share"]), ("interactions", "ix", ["bond_index", "identity_index"]),
)
KEYWORDS = f"kw as (select subreddit, month, count(*) as texts, cast(sum({hit('text', a.MENTIONS)}) as bigint) as mentions, avg({hit('text', a.MENTIONS)}) as mention_share from t where month is not null group by 1, 2)"
VALID = f"{q.strip('text')} <> '' and not {placeholder('text')}"
PARTS = f"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: {q.strip('x')} <> '')"
LEVEL = "select '{0}' as level, {1} as subreddit, {2} as month, count(*) as n, min(created_utc) as first_utc, max(created_utc) as last_utc from s"

GROWTH_COLUMNS = [*(f"{n}_mean_{c}" for n in ("pre", "post") for c in ("comments", "submissions")), "comment_growth", "submission_growth", "pre_threading_ratio", "pre_gini", "pre_top5_share",
                  "pre_bond_index", "pre_identity_index", "pre_reciprocal_dyad_share"]
GROWTH = f"""{WITH}, {INTER_TABLES}, {BUCKETS}, {COUNTS}, {P},
gx as (select p.*, coalesce(db.threading_ratio, 0) as threading_ratio, coalesce(conc.gini, 0) as gini, coalesce(conc.top5_share, 0) as top5_share from p
  left join db on db.subreddit = p.subreddit and db.month = p.month left join conc on conc.subreddit = p.subreddit and conc.month = p.month where community_type = 'health'),
gm as (select subreddit, {', '.join(f"avg({c}) filter (month {op} '{CUT}') as {n}_mean_{c}" for n, op in (('pre', '<'), ('post', '>=')) for c in ('comments', 'submissions'))},
  {', '.join(f"avg({c}) filter (month < '{CUT}') as pre_{c}" for c in ('threading_ratio', 'gini', 'top5_share'))} from gx group by 1),
gi as (select subreddit, {', '.join(f'avg({c}) as pre_{c}' for c in ('bond_index', 'identity_index', 'reciprocal_dyad_share'))} from ix where author_history_observed = 1 and month < '{CUT}' group by 1),
gh as (select gm.*, pre_bond_index, pre_identity_index, pre_reciprocal_dyad_share, (post_mean_comments - pre_mean_comments) / greatest(pre_mean_comments, 1.0) as comment_growth,
  (post_mean_submissions - pre_mean_submissions) / greatest(pre_mean_submissions, 1.0) as submission_growth from gm left join gi using (subreddit)),
go as (select *, row_number() over (order by comment_growth, subreddit) / cast(count(*) over () as double) as place from gh),
gr as (select *, case when place <= 1 / 3.0 then 'declining' when place <= 2 / 3.0 then 'stable' else 'growing' end as growth_group from go)"""

_ROUNDED = {
    "panel_base": f"""{WITH}, {CELLS}, {BUCKETS}, {OWN_COUNTS}, {calendar("select subreddit, month from sc union all select subreddit, month from cc")}
select grid.subreddit, grid.month, {', '.join(f'round(coalesce({t}.{c}, 0), 6) as {c}' if c.startswith(('mean', 'removed', 'median')) else f'coalesce({t}.{c}, 0) as {c}' for t, cs in zip(('sc', 'cc'), PANEL_COLUMNS) for c in cs)}, cast(0.0 as double) as mean_selftext_length,
  round(coalesce(mean_depth, 0), 6) as mean_depth, round(coalesce(threading_ratio, 0), 6) as threading_ratio, coalesce(max_depth, 0) as max_depth,
  {', '.join(f'round(coalesce({c}, 0), 6) as {n}' for c, n in (('top1_share', 'top1_share'), ('top5_share', 'top5_share'), ('hhi', 'hhi'), ('gini', 'gini'), ('top_1pct_share', 'pct1_share'), ('next_9pct_share', 'pct9_share'), ('last_90pct_share', 'pct90_share')))},
  {kind('grid.subreddit')} as community_type, round({ratio('coalesce(comments, 0)', 'coalesce(submissions, 0)')}, 6) as comments_per_submission, {idx('grid.month')} - {2022 * 12 + 10} as months_since, cast(grid.month >= '2022-11' as int) as post
from grid left join sc on sc.subreddit = grid.subreddit and sc.month = grid.month left join cc on cc.subreddit = grid.subreddit and cc.month = grid.month
left join db on db.subreddit = grid.subreddit and db.month = grid.month left join own_conc on own_conc.subreddit = grid.subreddit and own_conc.month = grid.month""",
    "top_trend": f"{PLAIN} select subreddit, month, count(*) as n from c where month is not null and subreddit in (select subreddit from c where month is not null group by 1 order by count(*) desc, subreddit limit 15) group by 1, 2",
    "top_mentions": f"with {T} select subreddit, count(*) as n from t where {hit('text', a.MENTIONS)} = 1 group by 1 order by n desc, subreddit limit 10",
    "community_order": f"select subreddit, row_number() over (order by lower(subreddit), subreddit) as place from (select distinct {q.strip('subreddit')} as subreddit from submissions where subreddit is not null)",
    "raw_scan": """with v as (select feed, trim(coalesce(payload, ''), ' \t\r\n\ufeff') as p from raw_submissions), o as (select feed, p, case when json_valid(p) then json_type(p) = 'OBJECT' else false end as ok from v)
select feed, count(*) as lines, count(*) filter (p = '') as blank, count(*) filter (p <> '' and not ok) as parse_errors, count(*) filter (ok and coalesce(json_extract_string(case when ok then p end, '$.created_utc'), '') = '') as missing_time,
  count(*) filter (ok and json_extract_string(case when ok then p end, '$.subreddit') is null and json_extract_string(case when ok then p end, '$.subreddit_name_prefixed') is null) as missing_community from o group by 1""",
    "panel_context": f"""{WITH}, {POSTS}, {RESP}, {P}, {T}, {KEYWORDS}, tc as (select subreddit, month, avg(length(text)) as mean_length, avg({hit('text', a.PATTERNS['question'])}) as question_share,
  {ratio("sum(length(regexp_replace(text, '[^[:punct:]]', '', 'g')))", 'sum(length(text))')} as punctuation_per_char from t where month is not null and record_kind = 'comment' and text is not null and {VALID} group by 1, 2)
select p.subreddit, p.month, comments, submissions, coalesce(texts, 0) as texts, coalesce(mentions, 0) as mentions, {', '.join(f'round(coalesce({c}, 0), 6) as {c}' for c in ('mention_share', 'mean_length', 'question_share', 'punctuation_per_char', 'reply_rate', 'median_latency_hours'))}
from p left join kw on kw.subreddit = p.subreddit and kw.month = p.month left join tc on tc.subreddit = p.subreddit and tc.month = p.month left join rm on rm.subreddit = p.subreddit and rm.month = p.month""",
    "describe_counts": f"with {S} {LEVEL.format('all', 'cast(null as varchar)', 'cast(null as varchar)')} union all {LEVEL.format('community', 'subreddit', 'null')} group by subreddit union all {LEVEL.format('month', 'null', 'month')} where month is not null group by month union all {LEVEL.format('community_month', 'subreddit', chr(99) + 'oalesce(month, ' + chr(39) + 'unknown' + chr(39) + ')')} group by subreddit, coalesce(month, 'unknown')",
    "describe_pivot": f"""with {S}, w as (select subreddit, {', '.join(f"count(*) filter (month = '{m}') as m{k}" for k, m in enumerate(MONTHS))} from s where month is not null group by 1),
u as (select * from w union all select 'ALL', {', '.join(f'cast(sum(m{k}) as bigint)' for k in range(len(MONTHS)))} from w)
select subreddit, {', '.join(f'm{k} as "{m}"' for k, m in enumerate(MONTHS))}, {' + '.join(f'm{k}' for k in range(len(MONTHS)))} as total from u""",
    "describe_by_type": f"{PLAIN} select {kind()} as community_type, month, count(*) as n, count(distinct subreddit) as communities from c where month is not null group by 1, 2",
    "top_communities": f"{PLAIN} select subreddit, count(*) as n from c group by 1 order by n desc, subreddit limit 20",
    "top_authors": f"{PLAIN} select author, count(*) as n from c where author is not null group by 1 order by n desc, author limit 20",
    "scan_stats": f"""{PLAIN} select count(*) as rows_read, count(*) filter (created_utc >= {a.WINDOW[0]} and created_utc < {a.WINDOW[1]}) as rows_in_window, count(*) filter (created_utc is null) as missing_time, min(created_utc) as first_utc, max(created_utc) as last_utc,
  count(distinct subreddit) as communities, count(distinct author) as authors, count(score) as scores, round(sum(score), 2) as score_sum, round(avg(score), 2) as score_mean, round(min(score), 2) as score_min, round(max(score), 2) as score_max from c""",
    "window_filter": f"{PLAIN} select comment_id, created_utc, subreddit from c where created_utc >= {a.WINDOW[0]} and created_utc < {a.WINDOW[1]}",
    "community_semi": f"{PLAIN} select sid as submission_id, subreddit, created_utc from s where subreddit in ({', '.join(repr(n) for n in a.LISTED)})",
    "median_length": f"{PLAIN}, {CELLS} select subreddit, month, median_comment_length from cc",
    "author_month_counts": f"{PLAIN} select subreddit, month, {written('author')} as author, count(*) as n from c where month is not null and {written('author')} is not null group by 1, 2, 3",
    "concentration": f"with {COUNTS} select subreddit, month, total_comments, unique_authors, {shown(['top1_share', 'top5_share', 'hhi', 'gini', 'top_1pct_share', 'next_9pct_share', 'last_90pct_share'])} from conc",
    "type_summary": f"with {COUNTS} select {kind()} as community_type, count(*) as cells, count(distinct subreddit) as communities, {', '.join(f'round(avg({c}), 6) as mean_{c}' for c in ('top1_share', 'top5_share', 'hhi', 'gini'))} from conc group by 1",
    "half_change": f"""with {COUNTS}, h as (select *, row_number() over (partition by subreddit order by month) as r, count(*) over (partition by subreddit) // 2 as half from conc),
g as (select subreddit, cast(coalesce(sum(total_comments) filter (r <= half), 0) as bigint) as first_half, cast(coalesce(sum(total_comments) filter (r > half), 0) as bigint) as second_half, avg(gini) as mean_gini, avg(top5_share) as mean_top5_share from h group by 1)
select subreddit, first_half, second_half, {shown(['mean_gini', 'mean_top5_share'])}, round((second_half - first_half) / cast(first_half as double), 6) as change from g where first_half > 0""",
    "comment_depth": f"{WITH} select comment_id, cast(depth as bigint) as depth from depths",
    "depth_buckets": f"{WITH}, {BUCKETS} select subreddit, month, n, depth_sum, max_depth, depth_1, depth_2, depth_3plus, {shown(['mean_depth', 'threading_ratio'])} from db",
    "post_activity": f"{WITH}, {POSTS} select * exclude (first_reply_latency_minutes), {r6('first_reply_latency_minutes')} as first_reply_latency_minutes from pm",
    "responsiveness_monthly": f"{WITH}, {POSTS}, {RESP} select subreddit, month, posts, {shown(['reply_rate', 'op_followup_rate', 'median_latency_hours', 'p25_latency_hours', 'p75_latency_hours', 'mean_comments', 'median_comments', 'mean_commenters', 'mean_direct_replies', 'mean_deep_replies', 'mean_max_depth', 'unanswered_rate'])} from rm",
    "responsiveness_by_type": f"""{WITH}, {POSTS} select {kind()} as community_type, month, round(avg(cast(num_comments_observed > 0 as int)), 6) as reply_rate,
  round(quantile_cont(case when first_reply_latency_minutes > 0 then first_reply_latency_minutes / 60.0 end, 0.5), 6) as median_latency_hours from pm where month is not null group by 1, 2""",
    "thread_structure": f"{WITH}, {POSTS}, {STRUCTURE} select subreddit, month, posts, {shown(['op_return_share', 'single_commenter_thread_share', 'multi_actor_share', 'focused_share', 'distributed_share'])} from ts",
    "commenter_counts": f"""{PLAIN}, {FIRST}, h as (select link, {q.author('author')} as commenter, count(*) as comment_count from c where link is not null and {q.author('author')} is not null group by 1, 2)
select link as submission_id, commenter, case when commenter = {q.strip('op')} then 0 else 1 end as is_non_op, comment_count from h join fp on fp.sid = h.link""",
    "reply_edges": f"{WITH}, {FIRST}, {EDGES} select * from ed",
    "dyads": f"{WITH}, {FIRST}, {EDGES} select subreddit, month, dyads, replies, {shown(['reciprocal_dyad_share', 'repeat_dyad_share'])} from dy",
    "author_activity": f"{PLAIN}, {ACTIVITY} select * from act",
    "author_history": f"{PLAIN}, {ACTIVITY}, {HISTORY} select subreddit, month, unique_authors, {shown(['new_author_share', 'returning_author_share', 'repeat_author_share'])} from ah",
    "interactions_monthly": INTERACTIONS,
    "rolling_helpers": f"{PLAIN}, {ACTIVITY}, {HELPERS}, {GRID}, {ROLLING} select subreddit, {MONTH_OF}, rolling_helpers, {shown(['effective_helpers', 'top5_helper_share', 'helper_jaccard'])} from rh",
    "contributor_retention": f"{PLAIN}, {ACTIVITY}, {CONTRIB} select subreddit, {MONTH_OF}, {shown(CAP_COLUMNS['con'], RATES)} from con",
    "helper_retention": f"with {HELPERS}, {RETURN} select subreddit, {MONTH_OF}, {shown(CAP_COLUMNS['hr'], RATES)} from hr",
    "newcomer_reply": f"{PLAIN}, {ACTIVITY}, {HELPERS}, {NEWCOMER} select subreddit, {MONTH_OF}, {shown(CAP_COLUMNS['np'], RATES)} from np",
    "support_capacity": f"{CAPACITY}, {CAP_ROWS} select subreddit, {MONTH_OF}, {shown([c for cs in CAP_COLUMNS.values() for c in cs], RATES)} from cap",
    "capacity_summary": f"""{CAPACITY}, {CAP_ROWS}, m as (select *, {MONTH_OF} from cap) select {kind()} as community_type, case when month < '{CUT}' then 'pre' else 'post' end as period, count(*) as cells,
  {', '.join(f'round(avg({c}), 6) as mean_{c}' for c in ('active_contributors', 'newcomer_share', 'newcomer_reply_rate', 'rolling_helpers', 'effective_helpers', 'top5_helper_share', 'helper_jaccard', *(f'{w}_return_{h}m' for w in ('newcomer', 'contributor', 'helper') for h in (1, 3, 6))))} from m where month <> '2022-11' group by 1, 2""",
    "text_flags": f"with {T} select doc_id, {', '.join(f'{hit("text", p)} as {n}' for n, p in a.PATTERNS.items())} from t",
    "text_metrics": f"""with {T}, v as (select record_kind, subreddit, month, length(text) as chars, {', '.join(f'{hit("text", p)} as {n}' for n, p in a.PATTERNS.items())}, cast(contains(text, '?') as int) as asks,
  length(regexp_replace(text, '[^[:punct:]]', '', 'g')) as marks, len({PARTS}) as parts, coalesce(list_sum(list_transform({PARTS}, lambda x: len(regexp_split_to_array({q.strip('x')}, '[{BLANKS}]+')))), 0) as words
  from t where month is not null and record_kind is not null and text is not null and {VALID})
select record_kind, subreddit, month, count(*) as texts, round(avg(chars), 6) as mean_length, {', '.join(f'round(avg({n}), 6) as {n}_share' for n in a.PATTERNS)}, round(avg(asks), 6) as question_mark_share, round(avg(cast(chars < 20 as int)), 6) as very_short_share, round(avg(cast(chars > 500 as int)), 6) as long_share,
  round({ratio('sum(marks)', 'sum(chars)')}, 6) as punctuation_per_char, round({ratio('sum(words)', 'sum(parts)')}, 6) as words_per_sentence, median(chars) as median_length from v group by 1, 2, 3""",
    "keyword_mentions": f"with {T}, {KEYWORDS} select subreddit, month, texts, mentions, {r6('mention_share')} as mention_share from kw",
    "validation_report": f"with {T} "
    + " union all ".join(
        f"""select '{n}' as proxy, count(*) as sampled, count(lang) as coded, count(*) filter (m = 1 and x = 1) as true_positive, count(*) filter (m = 0 and x = 1) as false_positive, count(*) filter (m = 1 and x = 0) as false_negative,
  count(*) filter (m = 0 and x = 0) as true_negative, {r6(ratio('count(lang)', 'count(*)'))} as coverage, round(count(*) filter (m = 1 and x = 1) / nullif(cast(count(*) filter (m is not null and x = 1) as double), 0), 6) as precision,
  round(count(*) filter (m = 1 and x = 1) / nullif(cast(count(*) filter (m = 1) as double), 0), 6) as recall from (select lang, cast(lower(lang) = 'en' as int) as m, {hit('text', p)} as x from t where text is not null)"""
        for n, p in a.PATTERNS.items()
    ),
    "sample_coverage": f"with {T} select record_kind, community_type, period, count(*) as available, least(count(*), 5) as sampled from ({STRATA}) group by 1, 2, 3",
    "resilience_profile": f"{RESILIENCE} select subreddit, {shown(['pre_mean', 'post_mean', 'pct_change', 'threading_ratio', 'mean_depth'])}, pre_months, post_months from pr",
    "indexed_trend": f"{RESILIENCE} select grp as \"group\", month, round(avg(n / pre_mean * 100), 6) as index, count(*) as communities from prr join db using (subreddit) where month <> 'unknown' group by 1, 2",
    "spearman_rho": f"{RESILIENCE} select count(*) as n, round(corr(rx, ry), 6) as rho from prr",
    "simple_ols": f"{RESILIENCE} select count(*) as n, round(regr_slope(pct_change, threading_ratio), 4) as slope, round(regr_intercept(pct_change, threading_ratio), 4) as intercept, round(regr_r2(pct_change, threading_ratio), 4) as r2 from pr",
    "mann_whitney_u": f"{RESILIENCE} select count(*) filter (grp = 'high') as n_high, count(*) filter (grp = 'low') as n_low, round(sum(ry) filter (grp = 'high') - count(*) filter (grp = 'high') * (count(*) filter (grp = 'high') + 1) / 2.0, 6) as u from prr",
    "growth_terciles": f"{GROWTH} select subreddit, {shown(GROWTH_COLUMNS)}, growth_group from gr",
    "growth_summary": f"{GROWTH} select growth_group, count(*) as communities, {', '.join(f'round(avg({c}), 6) as mean_{c}' for c in ('comment_growth', 'pre_threading_ratio', 'pre_gini', 'pre_top5_share'))} from gr group by 1",
    "balanced_panel": f"with {P}, b as (select * from p where comments > 0) select subreddit, month, comments from b where subreddit in (select subreddit from b group by 1 having count(distinct month) = (select count(distinct month) from b))",
    "exclude_top2": f"with {P} select subreddit, month, comments from p where subreddit not in (select subreddit from p where community_type = 'general' and month < '{CUT}' group by 1 order by sum(comments) desc, subreddit limit 2)",
    "winsorized": f"with {P} select subreddit, month, round(greatest((select quantile_cont(cast(comments as double), 0.01) from p), least((select quantile_cont(cast(comments as double), 0.99) from p), comments)), 6) as comments from p",
    "did_frame": f"""with {P} select subreddit, month, health, post, health * post as health_post, time_index, {r6('raw_outcome')} as raw_outcome, {r6('outcome')} as outcome,
  round(greatest(1.0, coalesce(sum(case when month < '{CUT}' then comments + submissions end) over (partition by subreddit), 0)), 6) as weight from f""",
    "event_bins": f"with {P} select cast(greatest(-6, least(24, time_index)) as int) as event_bin, health, count(*) as n from f group by 1, 2",
    "did_2x2": f"""with {P}, m as (select avg(outcome) filter (health = 1 and post = 1) as health_post, avg(outcome) filter (health = 1 and post = 0) as health_pre, avg(outcome) filter (health = 0 and post = 1) as general_post,
  avg(outcome) filter (health = 0 and post = 0) as general_pre, count(*) as n_obs from f) select {shown(['health_post', 'health_pre', 'general_post', 'general_pre'])}, n_obs, round(health_post - health_pre - general_post + general_pre, 6) as did from m""",
    "nearest_match": f"with {P}, {FEATURE} select subreddit, matched, {r6('distance')} as distance from nm",
    "weighted_change": f"""with {P}, g as (select community_type, sum(comments_per_submission * submissions) filter (month < '{CUT}') / sum(submissions) filter (month < '{CUT}') as pre_mean,
  sum(comments_per_submission * submissions) filter (month >= '{CUT}') / sum(submissions) filter (month >= '{CUT}') as post_mean from p group by 1) select community_type, {shown(['pre_mean', 'post_mean'])}, round(post_mean - pre_mean, 6) as change from g""",
    "bh_fdr": f"""with {P}, v as (select community_type, subreddit, round(avg(cast(comments > 500 as int)), 6) / 20 + length(subreddit) / 1000.0 as p_value from p group by 1, 2),
k as (select *, row_number() over (partition by community_type order by p_value) as r, count(*) over (partition by community_type) as n from v)
select community_type, subreddit, {r6('p_value')} as p_value, round(least(1.0, min(p_value * n / r) over (partition by community_type order by r desc rows between unbounded preceding and current row)), 6) as q_value from k""",
    "event_activity": "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users, round(avg(value), 6) as mean_value from events group by 1, 2",
    "nearest_vectors": """with l as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings where label is not null), m as (select label, i, avg(cast(x as double)) as m from l group by 1, 2)
select vec_id, label, round(sum((cast(x as double) - m) ** 2), 4) as distance from l join m using (label, i) group by 1, 2""",
}


def even_rounding(sql: str) -> str:
    """``round(x, n)`` as a floor whose steps don't lie on short decimals, as the queries round."""
    out, rest = "", sql
    while "round(" in rest:
        before, _, rest = rest.partition("round(")
        depth, at = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[at], 0)
            at += 1
        inner, rest = rest[: at - 1], rest[at:]
        value, _, digits = inner.rpartition(",")
        scale = 10 ** int(digits)
        out += f"{before}(floor(({even_rounding(value)}) * {scale}.0 + 0.5001) / {scale}.0)"
    return out + rest


ORACLE = {name: even_rounding(sql) for name, sql in _ROUNDED.items()}
