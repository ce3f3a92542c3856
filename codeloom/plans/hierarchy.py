"""Queries of the hierarchy operator (problem 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()

_LINKS = """
links as (select distinct e.source_id child, e.target_id parent from edges e
  where lower(trim(e.relation)) = 'inherits' and e.source_id in (select id from nodes) and e.target_id in (select id from nodes)),
walk as (
  select child node_id, parent cur, 1 steps, [child] seen, false as loop from links
  union all
  select w.node_id, l.parent, w.steps + 1, list_append(w.seen, w.cur), list_contains(w.seen, w.cur)
  from walk w join links l on l.child = w.cur where not w.loop),
ends as (select node_id, cur root_id, steps depth, seen from walk where cur not in (select child from links)),
loops as (select node_id, list_min(seen[list_position(seen, seen[len(seen)]):len(seen) - 1]) root_id from walk where loop)
"""


def _tree(spark, d):
    return H.hierarchy(H.inherit_links(table(spark, d, "nodes"), table(spark, d, "edges")))


@R.query(
    "p1_found",
    f"with recursive {_LINKS} select node_id, root_id, cast(depth as bigint) depth from ends union all select node_id, root_id, cast(-1 as bigint) from loops",
)
def p1_found(spark, d):
    return _tree(spark, d).where("parent_id is not null").select("node_id", "root_id", "depth")


@R.query(
    "p1_paths",
    f"""with recursive {_LINKS},
    members as (select node_id, root_id, depth, seen from ends union all select distinct root_id, root_id, 0, [] from ends),
    below as (select unnest(list_append(seen[2:], root_id)) a from ends),
    sizes as (select a, count(*) n from below group by a)
    select node_id, root_id, cast(depth as bigint) depth, array_to_string(list_reverse(list_append(seen, root_id)), '/') as path,
      cast(coalesce(n, 0) as bigint) n_descendants, false in_cycle
    from members left join sizes on a = node_id
    union all select node_id, root_id, -1, null, null, true from loops""",
)
def p1_paths(spark, d):
    t = H.paths(_tree(spark, d))
    return t.withColumn("path", F.array_join("path", "/"))


@R.query(
    "p1_descendants",
    f"with recursive {_LINKS} select a ancestor_id, node_id, cast(k as bigint) distance from (select node_id, unnest(list_append(seen[2:], root_id)) a, unnest(range(1, depth + 1)) k from ends)",
)
def p1_descendants(spark, d):
    return H.descendant_pairs(_tree(spark, d))
