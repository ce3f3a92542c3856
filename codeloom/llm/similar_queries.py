"""Queries of problem 5."""

from __future__ import annotations

from codeloom.llm import similar
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()

_SQL = r"""
with n as (select distinct id, lower(coalesce(signature, '') || ' ' || coalesce(code_content, '')) t from nodes where type in ('function', 'method')),
w as (select id, regexp_extract_all(t, '[a-z0-9_]+') w from n),
s as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 30)),
z as (select id, count(*) n from s group by 1),
c as (select a.id node_id_a, b.id node_id_b, count(*) c from s a join s b on a.g = b.g and a.id < b.id group by 1, 2)
select node_id_a, node_id_b from c join z x on x.id = node_id_a join z y on y.id = node_id_b where c >= 0.6 * (x.n + y.n - c)
"""


_GROUPS = _SQL.replace("select node_id_a, node_id_b from c", ", p as (select node_id_a a, node_id_b b from c") + r"""),
same as (select id, count(*) n, list_sort(list(g)) l from s group by 1),
class as (select id, min(id) over (partition by l) class_id from same),
walk as (
  select id, id r from class
  union
  select w.id, case when p.a = w.r then p.b else p.a end from walk w join p on w.r in (p.a, p.b))
select c.id node_id, c.class_id, min(w.r) group_id from class c join walk w on w.id = c.id group by 1, 2
"""


@R.query("p5_found", _SQL)
def p5_found(spark, d):
    b = similar.similar_functions(table(spark, d, "nodes"))
    return similar.all_pairs(b.members, b.similar_pairs()).select("node_id_a", "node_id_b")


@R.query("p5_groups", _GROUPS.replace("with n as", "with recursive n as"))
def p5_groups(spark, d):
    b = similar.similar_functions(table(spark, d, "nodes"))
    return similar.groups(b.members, b.star_pairs()).select("node_id", "class_id", "group_id")


@R.query("p5_links")
def p5_links(spark, d):
    """Every function with its class, its group and the number of links that hold its class in the group."""
    b = similar.similar_functions(table(spark, d, "nodes"))
    return similar.groups(b.members, b.star_pairs())
