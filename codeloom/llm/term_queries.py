"""Queries of problem 4."""

from __future__ import annotations

from codeloom.llm import terms
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()

_SQL = r"""
with n as (select distinct id, name, name_tokens from nodes where id is not null),
parts as (
  select 'name' field, name term, id from n where name is not null
  union all
  select 'name_tokens', unnest(string_split_regex(lower(name_tokens), '\s+')), id from n),
counts as (select field, term, count(*) occurrences, count(distinct id) nodes from parts where field = 'name' or term <> '' group by 1, 2),
marked as (select *, case when nodes < 3 then 'rare' when nodes > 0.02 * (select count(distinct id) from n) then 'common' end mark from counts)
"""


@R.query("p4_found", _SQL + "select field, term, mark from marked where mark is not null")
def p4_found(spark, d):
    return terms.marked_terms(table(spark, d, "nodes")).where("mark is not null").select("field", "term", "mark")


@R.query("p4_terms", _SQL + "select field, term, occurrences, nodes, mark from marked")
def p4_terms(spark, d):
    return terms.marked_terms(table(spark, d, "nodes"))
