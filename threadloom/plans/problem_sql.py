"""Check queries for the general data problems."""

from __future__ import annotations

from threadloom.plans import sql_text as q


def rolling(rows: str, entity: str) -> str:
    return f"""
with rows_ as ({rows}),
daily as (select entity, day, cast(sum(value) as bigint) as total from rows_ where entity is not null and day is not null group by 1, 2),
spans as (select entity, min(day) as a, max(day) as b from daily group by 1),
grid as (select entity, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day from spans),
dense as (select g.entity, g.day, coalesce(d.total, 0) as total from grid g left join daily d on d.entity = g.entity and d.day = g.day),
out as (select entity, day, total,
  cast(sum(total) over (partition by entity order by day rows between 6 preceding and current row) as bigint) as total_7,
  cast(sum(total) over (partition by entity order by day rows between 29 preceding and current row) as bigint) as total_30 from dense)
select entity as {entity}, strftime(day, '%Y-%m-%d') as day, total, total_7, total_30, total_7 / 7.0 as mean_7, total_30 / 30.0 as mean_30 from out"""


COMMUNITY = rolling(f"select {q.name('subreddit')} as entity, {q.day('created_utc')} as day, 1 as value from submissions", "subreddit")
COMMENTER = rolling(
    f"""select nullif({q.strip('h.commenter')}, '') as entity, {q.day('s.created_utc')} as day, coalesce(h.comment_count, 0) as value
from helper_counts h join (select {q.post('submission_id')} as k, created_utc, row_number() over (partition by {q.post('submission_id')} order by received_at nulls last, delivery_id) as rn
  from submissions where created_utc is not null) s on s.k = {q.post('h.submission_id')} and s.rn = 1""",
    "commenter",
)

NODES = f"""nodes as (
  select comment_id as id, any_value(case when lower(substr({q.strip('parent_id')}, 1, 3)) = 't1_' then nullif(substr({q.strip('parent_id')}, 4), '') end) as ptr,
    any_value(case when lower(substr({q.strip('parent_id')}, 1, 3)) = 't3_' then nullif(substr({q.strip('parent_id')}, 4), '') end) as root
  from comments where comment_id is not null group by 1),
tree(id, path, level, root, state) as (
  select id, id, 1, root, case when root is not null then 'resolved' when ptr is not null then 'orphan' else 'malformed' end from nodes n
  where ptr is null or not exists (select 1 from nodes m where m.id = n.ptr)
  union all select n.id, t.path || '/' || n.id, t.level + 1, t.root, t.state from tree t join nodes n on n.ptr = t.id),
circling as (select n.id, n.ptr from nodes n where n.id not in (select id from tree)),
reach(a, b) as (select id, ptr from circling union select r.a, c.ptr from reach r join circling c on c.id = r.b),
cycles as (select a as id, min(b) as cycle_id from reach where a in (select a from reach where a = b) group by 1),
hangs(id, path, level) as (
  select n.id, n.id, 1 from nodes n join cycles y on y.id = n.ptr where n.id not in (select id from cycles)
  union all select n.id, h.path || '/' || n.id, h.level + 1 from hangs h join nodes n on n.ptr = h.id),
ways as (select id, path, level from tree union all select id, path, level from hangs),
pairs as (select a.id as descendant, a.level, unnest(string_split(a.path, '/')) as ancestor, generate_subscripts(string_split(a.path, '/'), 1) as pos from ways a)"""
CLOSURE = f"with recursive {NODES}"

SURPLUS = f"select delivery_id, submission_id, row_number() over (partition by {q.post('submission_id')} order by received_at nulls last, delivery_id) as rn, {q.post('submission_id')} as k from submissions"

TOTALS = f"""
with r as (select {q.name('subreddit')} as subreddit, {q.author('author')} as author, coalesce(comment_count, 0) as n from author_counts),
t as (select subreddit, count(*) as n_rows, cast(sum(n) as bigint) as comment_total from r group by 1),
a as (select subreddit, author, sum(n) as n, row_number() over (partition by subreddit order by sum(n) desc, author) as rk from r where author is not null group by 1, 2),
s as (select subreddit, count(*) as n_authors, cast(sum(n) as bigint) as author_total, sum(n) filter (rk <= 1) as t1, sum(n) filter (rk <= 5) as t5 from a group by 1),
out as (select t.subreddit, n_rows, comment_total, coalesce(n_authors, 0) as n_authors, coalesce(author_total, 0) as author_total,
  coalesce(t1 / nullif(cast(author_total as double), 0), 0.0) as top1_share, coalesce(t5 / nullif(cast(author_total as double), 0), 0.0) as top5_share
  from t left join s on t.subreddit is not distinct from s.subreddit)
select * from out"""

ORACLE = {
    "p1_found": f"select subreddit, day from ({COMMUNITY}) where total_7 = 0",
    "p1_community_rolling": COMMUNITY,
    "p1_commenter_rolling": f"select *, cast(lower(commenter) in {q.MARKS} as int) as is_placeholder from ({COMMENTER})",
    "p2_found": f"{CLOSURE} select cycle_id, id as comment_id from cycles",
    "p2_hierarchy": f"""{CLOSURE}, kids as (select ancestor, count(*) as n from pairs where ancestor <> descendant group by 1)
select t.id as comment_id, t.state, t.root, cast(t.level as bigint) as level, cast(case when t.state = 'resolved' then t.level end as bigint) as depth, t.path, cast(null as varchar) as cycle_id,
  coalesce(k.n, 0) as n_descendants from tree t left join kids k on k.ancestor = t.id
union all select c.id, case when y.id is not null then 'cycle' else 'below_cycle' end, null, null, null, null, coalesce(y.cycle_id, (select min(z.cycle_id) from reach r join cycles z on z.id = r.b where r.a = c.id)),
  case when y.id is null then coalesce(k.n, 0) end
from circling c left join cycles y on y.id = c.id left join kids k on k.ancestor = c.id""",
    "p2_descendants": f"{CLOSURE} select ancestor, descendant, cast(level - pos as bigint) as distance from pairs where ancestor <> descendant",
    "p2_max_depth": f"""{CLOSURE} select {q.name('c.subreddit')} as subreddit, {q.month('c.created_utc')} as month, cast(max(t.level) as bigint) as max_depth
from comments c join tree t on t.id = c.comment_id where t.state = 'resolved' and {q.name('c.subreddit')} is not null and c.created_utc is not null group by 1, 2""",
    "p3_found": f"""select subreddit from ({TOTALS}) where subreddit is not null and (n_rows * 100 >= 5 * (select count(*) from author_counts)
or comment_total * 100 >= 5 * (select sum(comment_count) from author_counts))""",
    "p3_community_totals": TOTALS,
    "p7_found": f"select delivery_id from ({SURPLUS}) where k is not null and rn > 1",
    "p7_kept": f"select s.* from submissions s join ({SURPLUS}) x using (delivery_id) where x.k is null or x.rn = 1",
}
