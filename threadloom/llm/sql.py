"""Check queries for the training-data problems that SQL can express."""

from __future__ import annotations

import math

from threadloom.llm.quantiles import ALPHA, gamma, offset
from threadloom.plans import sql_text as q

_LEVELS = {"all": "", "day": "day", "month": "month", "community": "subreddit", "community_day": "day, subreddit", "community_month": "month, subreddit"}


def _level(name: str, columns: str) -> str:
    kept = [c.strip() for c in columns.split(",") if c.strip()]
    shown = [c if c in kept else f"cast(null as varchar) as {c}" for c in ("day", "month", "subreddit")]
    keys = ", ".join([*kept, "author"])
    known = " and ".join([f"{c} is not null" for c in kept] or ["true"])
    return f"""select '{name}' as level, {', '.join(shown)},
  cast(sum(c) as bigint) as unique_comment_authors, cast(sum(s) as bigint) as unique_submission_authors, cast(sum(a) as bigint) as unique_counted_authors,
  cast(sum(c * s) as bigint) as authors_in_both, count(*) as authors_in_any
from (select {keys}, max(c) as c, max(s) as s, max(a) as a from r where {known} group by {keys}) g {'group by ' + ', '.join(kept) if kept else ''}"""


DISTINCT = f"""with raw as (
  select strftime({q.day('created_utc')}, '%Y-%m-%d') as day, {q.month('created_utc')} as month, {q.name('subreddit')} as subreddit, {q.author('author')} as author, 1 as c, 0 as s, 0 as a from comments
  union all select strftime({q.day('created_utc')}, '%Y-%m-%d'), {q.month('created_utc')}, {q.name('subreddit')}, {q.author('author')}, 0, 1, 0 from submissions
  union all select null, month, {q.name('subreddit')}, {q.author('author')}, 0, 0, 1 from author_counts),
r as (select * from raw where author is not null)
""" + " union all ".join(_level(n, c) for n, c in _LEVELS.items())

_G, _O = gamma(ALPHA), offset(ALPHA)
_WANTED = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _at(rank: str) -> str:
    return f"max(case when upto - n <= {rank} and {rank} < upto then value end)"


_PARTS = ", ".join(
    f"{_at(f'floor({p} * (total - 1))')} + max({p} * (total - 1) - floor({p} * (total - 1))) * ({_at(f'ceil({p} * (total - 1))')} - {_at(f'floor({p} * (total - 1))')}) as {c}" for c, p in _WANTED.items()
)
PERCENTILES = f"""with v as (
  select 'length' as measure, {q.name('subreddit')} as subreddit, {q.month('created_utc')} as month, case when lower({q.strip('body')}) not in {q.MARKS} then cast(length(body) as double) end as x from comments
  union all select 'latency', {q.name('subreddit')}, coalesce(month, {q.month('created_utc')}), first_reply_latency_minutes / 60.0 from post_metrics),
b as (select measure, subreddit, month, case when x = 0 then 0 else sign(x) * (ceil(ln(abs(x)) / {math.log(_G)!r}) + {_O}) end as bucket, count(*) as n
  from v where x is not null and subreddit is not null and month is not null group by 1, 2, 3, 4),
w as (select *, sum(n) over (partition by measure, subreddit, month order by bucket) as upto, sum(n) over (partition by measure, subreddit, month) as total,
  case when bucket = 0 then 0.0 else sign(bucket) * {2 / (_G + 1)!r} * pow({_G!r}, abs(bucket) - {_O}) end as value from b),
p as (select measure, subreddit, month, max(total) as n, {_PARTS} from w group by 1, 2, 3)
select subreddit, month, cast(max(n) filter (measure = 'length') as bigint) as n_comments, {', '.join(f"round(max({c}) filter (measure = 'length'), 6) as {c}_comment_length" for c in _WANTED)},
  cast(max(n) filter (measure = 'latency') as bigint) as n_replied, {', '.join(f"round(max({c}) filter (measure = 'latency'), 6) as {c}_first_reply_latency_hours" for c in _WANTED)}
from p group by 1, 2"""

ORACLE = {"p5_distinct_authors": DISTINCT, "p6_percentiles": PERCENTILES}
