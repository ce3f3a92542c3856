"""Queries of the graph operators over the code graph tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import identifiers as I
from codeloom.functions import predicates as P
from codeloom.graph import Graph
from codeloom.operators import analysis as A
from codeloom.operators import lookups as L
from codeloom.operators import mutation as M
from codeloom.operators import resolve as X
from codeloom.operators import shaping as Z
from codeloom.operators import traverse as T
from codeloom.plans.registry import Registry
from codeloom.sources.tables import table

R = Registry()

#: The cleaned relations in SQL: f files, n nodes, e edges, loc nodes with path and language.
G = r"""
f as (select id file_id, path, content_hash, last_modified, lower(language) as lang, indexed_at from files where id is not null
  qualify row_number() over (partition by id order by indexed_at desc nulls last, last_modified desc nulls last, content_hash desc nulls last, path desc nulls last, language desc nulls last) = 1),
n as (select * from nodes where id is not null qualify row_number() over (partition by id order by file_id) = 1),
e as (select min(id) id, source_id, target_id, lower(trim(relation)) relation, coalesce(metadata, '') metadata from edges
  where source_id is not null and target_id is not null group by 2, 3, 4, 5),
loc as (select n.*, f.path, f.lang from n join f on f.file_id = n.file_id)
"""


def sql(body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{G}{',' if not body.lstrip().startswith('select') else ''} {body}"


def _test(name: str, path: str, flag: str | None = None) -> str:
    ends = " or ".join(f"ends_with({path}, '{x}')" for x in ("_test.go", "_test.rs", ".test.ts", ".test.js", ".test.tsx", ".test.jsx", ".spec.ts", ".spec.js"))
    own = f"coalesce({flag}, false) or " if flag else ""
    return f"({own}coalesce(starts_with({name}, 'test_') or ends_with({name}, 'Test') or ends_with({name}, 'Tests'), false) or coalesce(starts_with({path}, 'tests/') or starts_with({path}, 'test/') or contains({path}, '__tests__/') or {ends}, false))"


def _stat(name: str, path: str, flag: str) -> str:
    return f"(coalesce({flag}, false) or coalesce(starts_with(lower({name}), 'test_'), false) or coalesce(starts_with(lower({path}), 'tests/') or contains(lower({path}), '_test.'), false))"


_DIR = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end"


def graph(spark, d) -> Graph:
    return Graph.load(spark, d)


# --- lookups -----------------------------------------------------------------------


@R.query("node_lookup", sql("select id, name, type, path, start_line, end_line from loc where name = 'update'"))
def node_lookup(spark, d):
    return L.nodes_by_name(graph(spark, d), "update")


@R.query("node_by_ids", sql("select id, name, type, path, start_line, end_line from loc where id % 50 = 0"))
def node_by_ids(spark, d):
    g = graph(spark, d)
    return L.nodes_by_ids(g, g.nodes.where("id % 50 = 0").select("id"))


@R.query("first_node_id", sql("select min(id) id from n where name = 'update'"))
def first_node_id(spark, d):
    return L.first_node_id(graph(spark, d), "update")


@R.query("file_hashes", sql("select path, content_hash from f"))
def file_hashes(spark, d):
    return L.file_hashes(graph(spark, d))


@R.query("file_nodes", sql("select id, name, type, path, start_line, end_line from loc where path = (select min(path) from f where path <> '<external>')"))
def file_nodes(spark, d):
    g = graph(spark, d)
    path = g.files.where(F.col("path") != S.EXTERNAL).agg(F.min("path")).first()[0]
    return L.nodes_of_file(g, path)


@R.query("language_by_path", sql(
    "select path, case regexp_extract(path, '[^/]\\.([^./]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in P.EXTENSIONS.items()) + " end as detected from f"
))
def language_by_path(spark, d):
    return graph(spark, d).files.select("path", P.file_language(P.normalised_path(F.col("path"))).alias("detected"))


_COUNTS = "c as (select target_id, count(*) callers from e where relation = 'calls' group by 1)"


@R.query("filter_search", sql(
    f"{_COUNTS} select id, name, type, path, start_line, coalesce(callers, 0) callers from loc left join c on c.target_id = id where type in ('function', 'method') "
    "and contains(lower(return_type), 'int') and path <> '<external>' and name <> '<module>' order by callers desc, path, start_line, id limit 50"
))
def filter_search(spark, d):
    return L.filtered_nodes(graph(spark, d), "fn", returns="int", limit=50)


@R.query("type_alias_filter", sql(
    f"{_COUNTS} select id, name, type, path, start_line, coalesce(callers, 0) callers from loc left join c on c.target_id = id where type in ('interface', 'trait') "
    "and path <> '<external>' and name <> '<module>' order by callers desc, path, start_line, id limit 100"
))
def type_alias_filter(spark, d):
    return L.filtered_nodes(graph(spark, d), "iface", limit=100)


@R.query("caller_count", sql("select target_id, count(*) callers from e where relation = 'calls' group by 1"))
def caller_count(spark, d):
    return L.caller_counts(graph(spark, d))


@R.query("edge_neighbors", sql(
    "ends as (select source_id node_id, 'out' direction, target_id other from e where relation = 'implements' union all select target_id, 'in', source_id from e where relation = 'implements') "
    "select node_id, direction, n.name, coalesce(path, '') path from ends join n on n.id = other left join f on f.file_id = n.file_id"
))
def edge_neighbors(spark, d):
    return L.neighbours(graph(spark, d), S.IMPLEMENTS)


@R.query("incoming_refs", sql(
    "select e.target_id, e.source_id, s.name, s.type, s.path, s.start_line, e.relation from e join n t on t.id = e.target_id join loc s on s.id = e.source_id where t.name = 'update'"
))
def incoming_refs(spark, d):
    return L.incoming_references(graph(spark, d), "update")


@R.query("refs_by_relation", sql(
    "select relation, count(*) n from (select distinct s.name, s.path, e.relation from e join n t on t.id = e.target_id join loc s on s.id = e.source_id where t.name = 'update') group by 1"
))
def refs_by_relation(spark, d):
    return L.references_by_relation(graph(spark, d), "update")


_BUSY = "(select path from loc join e on e.target_id = loc.id where path <> '<external>' group by path order by count(*) desc, path limit 1)"


def _busy(g):
    t = g.edges.select(F.col("target_id").alias("_t"))
    return g.located().where(F.col("path") != S.EXTERNAL).join(t, F.col("id") == F.col("_t")).groupBy("path").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "path").first()["path"]


@R.query("inbound_cross_file", sql(
    f"i as (select id, name from loc where path = {_BUSY}) select e.id, e.source_id, i.name target_name, e.relation, e.metadata from e join i on i.id = e.target_id where e.source_id not in (select id from i)"
))
def inbound_cross_file(spark, d):
    g = graph(spark, d)
    return L.inbound_cross_file(g, _busy(g))


_LATE = "(select path from f where last_modified >= (select quantile_disc(last_modified, 0.95) from f))"


def _late(g):
    cut = g.files.agg(F.expr("percentile_disc(0.95) within group (order by last_modified)")).first()[0]
    return g.files.where(F.col("last_modified") >= F.lit(cut)).select("path")


@R.query("dirty_nodes", sql(
    f"i as (select id from loc where path in {_LATE}), a as (select target_id id from e where source_id in (select id from i) union select source_id from e where target_id in (select id from i)) "
    "select id from a where id not in (select id from i) and id in (select id from n)"
))
def dirty_nodes(spark, d):
    g = graph(spark, d)
    return L.dirty_nodes(g, _late(g))


@R.query("missing_context", sql("select id, name, path from loc where context_string is null and path <> '<external>'"))
def missing_context(spark, d):
    return L.missing_context(graph(spark, d))


@R.query("unembedded_nodes", sql(
    "d as (select target_id, count(*) degree from e group by 1) select id, name, coalesce(degree, 0) degree from n left join d on d.target_id = id where context_string is not null order by degree desc, id limit 100"
))
def unembedded_nodes(spark, d):
    return L.unembedded(graph(spark, d))


@R.query("index_status", sql(
    "select (select count(*) from f where path <> '<external>') files, (select count(*) from n) nodes, (select count(*) from e) edges, (select max(indexed_at) from f where path <> '<external>') last_indexed_at"
))
def index_status(spark, d):
    return L.index_status(graph(spark, d))


_ROUTES = """r as (select id, source_id, target_id, json_extract_string(m, '$.method') as method, json_extract_string(m, '$.path') as route,
  coalesce(cast(json_extract_string(m, '$.inline') as boolean), false) as inl, cast(json_extract_string(m, '$.handler_start_line') as bigint) hs, cast(json_extract_string(m, '$.handler_end_line') as bigint) he
  from (select *, case when json_valid(metadata) then metadata end m from e where relation = 'routes_to'))"""


@R.query("route_table", sql(f"{_ROUTES} select target_id, method, route, inl as inline from r"))
def route_table(spark, d):
    return A.route_table(graph(spark, d))


@R.query("route_lookup", sql(
    f"{_ROUTES} select target_id node_id, method, route, case when inl then coalesce(method || ' ' || route, name) else name end as name, path as file, "
    "case when inl and hs is not null then hs else start_line end start_line, case when inl and he is not null then he else end_line end end_line "
    "from r join loc on loc.id = target_id where route = '/v1' or starts_with(route, '/v1/')"
))
def route_lookup(spark, d):
    return L.find_routes(graph(spark, d), "/v1")


@R.query("grep_container", sql(
    r"""t as (select id, path, start_line, string_split(regexp_replace(code_content, '\r\n?', chr(10), 'g'), chr(10)) ls from loc where type in ('function', 'method') and code_content is not null),
    x as (select id, path, start_line, ls[i] as content, i from (select *, unnest(range(1, len(ls) + 1)) i from t)),
    h as (select path, start_line + i - 1 as line, row_number() over (partition by id order by i) k from x where contains(content, 'return')),
    p as (select distinct path, line from h where k <= 100),
    b as (select p.path, p.line, arg_min({'id': loc.id, 'name': name, 'type': type}, (loc.end_line - loc.start_line, loc.id)) b from p join loc on loc.path = p.path and p.line between loc.start_line and loc.end_line and name <> '<module>' group by 1, 2)
    select p.path, p.line, b.id node_id, b.name, b.type from p left join b using (path, line)"""
))
def grep_container(spark, d):
    g = graph(spark, d)
    t = g.located("type", "code_content", "start_line").where(F.col("type").isin("function", "method"))
    t = t.withColumn("key", F.struct("id", "path", "start_line"))
    hits = L.grep(t, "return", key="key", text="code_content")
    lines = hits.select(F.col("key.path").alias("path"), (F.col("key.start_line") + F.col("line") - 1).alias("line")).distinct()
    return L.containing_nodes(lines, g)


@R.query("ignore_prefix", sql("select id, path from loc where not starts_with(path, 'lattice-core/') and not starts_with(path, 'kepeba/')"))
def ignore_prefix(spark, d):
    return L.ignoring(graph(spark, d).located(), ["lattice-core/", "kepeba/"]).select("id", "path")


@R.query("is_test_flags", sql(f"select id, {_test('name', 'path', 'is_test')} as t from loc"))
def is_test_flags(spark, d):
    return graph(spark, d).located("name", "is_test").select("id", P.is_test(F.col("name"), F.col("path"), F.col("is_test")).alias("t"))


@R.query("split_identifier", sql(
    r"""s as (select distinct name, trim(regexp_replace(regexp_replace(regexp_replace(name, '_+', ' ', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')) s from n)
    select name, case when contains(s, ' ') then s || ' ' || name when s = '' then name else s end as tokens from s where name is not null"""
))
def split_identifier(spark, d):
    names = graph(spark, d).nodes.select("name").distinct()
    return names.where("name is not null").select("name", I.split_column(F.col("name")).alias("tokens"))


# --- aggregates --------------------------------------------------------------------


@R.query("module_stats", sql(
    f"select {_DIR} as dir, count(distinct path) files, sum(case when type in ('function', 'method') then 1 else 0 end) functions, sum(case when type in ('class', 'struct') then 1 else 0 end) classes, "
    "sum(case when type in ('interface', 'trait') then 1 else 0 end) interfaces, count(*) symbols, coalesce(array_to_string(list_sort(list(distinct lang)), ','), '') languages "
    "from loc where path <> '<external>' and name <> '<module>' group by 1"
))
def module_stats(spark, d):
    return A.module_stats(graph(spark, d))


_CALLED = f"t as (select * from loc where name <> '<module>' and not {_stat('name', 'path', 'is_test')})"


@R.query("key_symbols", sql(
    f"""{_CALLED}, c as (select t.id, name, {_DIR} as dir, count(*) k from e join t on t.id = e.target_id where relation = 'calls' and type <> 'module' group by 1, 2, 3 order by k desc, t.id limit 200),
    b as (select dir, name, max(k) k, arg_max(-id, (k, -id)) neg from c group by 1, 2),
    q as (select dir, name, row_number() over (partition by dir order by k desc, neg desc) r from b qualify r <= 6),
    x as (select distinct {_DIR} as dir, name from loc where name <> '<module>' and id in (select target_id from e where relation = 'exports')),
    y as (select dir, name, 8 + row_number() over (partition by dir order by name) r from x where (dir, name) not in (select (dir, name) from q) qualify r <= 16)
    select dir, array_to_string(list(name order by r)[1:8], ',') as names from (select * from q union all select * from y) group by 1"""
))
def key_symbols(spark, d):
    return A.key_symbols(graph(spark, d))


@R.query("module_deps", sql(
    f"m as (select id, {_DIR} as dir from loc where path <> '<external>') select a.dir dir_from, b.dir dir_to, count(*) n from e join m a on a.id = source_id join m b on b.id = target_id where relation in ('imports', 'calls') and a.dir <> b.dir group by 1, 2"
))
def module_deps(spark, d):
    return A.module_dependencies(graph(spark, d))


@R.query("hot_nodes", sql(
    f"{_CALLED} select t.name, t.type, t.path, sum(case when not {_stat('s.name', 's.path', 's.is_test')} then 1 else 0 end) callers, sum(case when {_stat('s.name', 's.path', 's.is_test')} then 1 else 0 end) test_callers "
    "from e join t on t.id = e.target_id join loc s on s.id = e.source_id where relation = 'calls' and t.type in ('function', 'method') group by 1, 2, 3 having callers > 0 order by callers desc, t.name, t.path, t.type limit 15"
))
def hot_nodes(spark, d):
    return A.hot_functions(graph(spark, d))


@R.query("entry_points", sql(
    f"{_ROUTES} select 'route' as kind, coalesce(method || ' ' || route, name) as label, name, path from r join loc on loc.id = target_id order by r.id limit 20"
))
def entry_points(spark, d):
    return A.entry_points(graph(spark, d))


@R.query("module_exports", sql(
    f"{_COUNTS} select distinct name, type, path, coalesce(callers, 0) callers from loc left join c on c.target_id = id where starts_with(path, 'lattice-core/') and name <> '<module>' and type <> 'module' "
    "and id in (select target_id from e where relation = 'exports')"
))
def module_exports(spark, d):
    return A.module_exports(graph(spark, d), "lattice-core/")


@R.query("module_overview", sql(
    f"""{_COUNTS}, rows as (select distinct name, type, path, coalesce(callers, 0) callers from loc left join c on c.target_id = id where starts_with(path, 'lattice-core/') and name <> '<module>' and type <> 'module'
      and id in (select target_id from e where relation = 'exports')),
    t as (select *, row_number() over (order by callers desc, path, name) r from (select * from rows where callers > 0 order by callers desc, path, name limit 30)),
    i as (select *, row_number() over (partition by type order by path, name) r from rows where callers = 0)
    select 'hot' as section, '' as type, count(*) n, array_to_string(list(name order by r), ',') as names from t where r <= 5 having count(*) > 0
    union all select 'active', '', count(*), array_to_string(list(name order by r), ',') from t having count(*) > 0
    union all select 'inactive', type, count(*), array_to_string(list(name order by r) filter (r <= 8), ',') from i group by type"""
))
def module_overview(spark, d):
    return A.module_overview(graph(spark, d), "lattice-core/")


@R.query("project_map", sql(
    f"m as (select id, {_DIR} as dir from loc where path <> '<external>'), q as (select a.dir, array_to_string(list_sort(list(distinct b.dir)), ',') as depends_on from e join m a on a.id = source_id join m b on b.id = target_id where relation in ('imports', 'calls') and a.dir <> b.dir group by 1), "
    f"s as (select {_DIR} as dir, count(distinct path) files, count(*) symbols from loc where path <> '<external>' and name <> '<module>' group by 1) select s.dir, files, symbols, depends_on from s left join q on q.dir = s.dir"
))
def project_map(spark, d):
    return A.project_map(graph(spark, d)).select("dir", "files", "symbols", "depends_on")


@R.query("risk_level", sql(
    f"c as (select e.target_id, count(*) callers from e join loc s on s.id = e.source_id where relation = 'calls' and not {_test('s.name', 's.path', 's.is_test')} group by 1) "
    "select id node_id, coalesce(callers, 0) callers, case when coalesce(callers, 0) > 10 then 'HIGH' when coalesce(callers, 0) > 3 then 'MEDIUM' else 'LOW' end as risk from loc left join c on c.target_id = id where type in ('function', 'method')"
))
def risk_level(spark, d):
    return A.risk_by_function(graph(spark, d))


def _mention() -> str:
    return " or ".join(f"contains(o.code_content, c.name || {('chr(10)' if x == chr(10) else repr(x))})" for x in A.DELIMITERS)


_DEAD = f"""c as (select * from loc where type <> 'module' and name not in ('<module>', 'main', '_') and path <> '<external>' and (end_line - start_line + 1) >= 3 and not coalesce(is_test, false)
  and id not in (select target_id from e where relation in ('calls', 'imports', 'inherits', 'implements')) and id not in (select target_id from e where relation = 'routes_to' and source_id = target_id)),
dead as (select c.id, c.name, c.type, c.path, c.end_line - c.start_line + 1 as lines, c.id in (select target_id from e where relation = 'exports') as has_export, substr(c.code_content, 1, 4) as head from c
  where length(c.name) < 3 or not exists (select 1 from n o where o.file_id = c.file_id and o.id <> c.id and o.type in ('function', 'method') and ({_mention()})) order by lines desc, c.id limit 50)"""


@R.query("dead_code", sql(f"{_DEAD} select id, name, type, path, lines, has_export from dead"))
def dead_code(spark, d):
    return A.dead_code(graph(spark, d), min_lines=3)


@R.query("dead_code_classified", sql(
    f"{_DEAD} select id, name, type, path, lines, case when has_export or coalesce(head in ('pub ', 'pub('), false) or (ends_with(path, '.go') and regexp_matches(name, '^\\p{{Lu}}')) then 'exported_unused' else 'orphan' end as category from dead"
))
def dead_code_classified(spark, d):
    return A.classified_dead_code(graph(spark, d), min_lines=3)


@R.query("show_node", sql(
    "r as (select target_id, sum(case when relation = 'calls' then 1 else 0 end) callers, count(*) refs from e group by 1) "
    'select id, name, type, path, start_line, end_line, signature, coalesce(callers, 0) callers, coalesce(refs, 0) "references" from loc left join r on r.target_id = id where name = \'update\''
))
def show_node(spark, d):
    return A.show_node(graph(spark, d), "update")


# --- traversal ---------------------------------------------------------------------


def _walk(way: str, depth: int, name: str, listing: bool = True) -> str:
    """The walk from a name; a ``listing`` keeps its first 200 rows, counts are taken over all."""
    a, b = ("target_id", "source_id") if way == "callers" else ("source_id", "target_id")
    return f"""{way}_w(node, depth) as (select id, 0 from loc where name = '{name}' union select e.{b}, w.depth + 1 from {way}_w w join e on e.{a} = w.node and e.relation = 'calls' where w.depth < {depth}),
    {way}_m as (select node, min(depth) depth from {way}_w group by 1),
    {way}_p as (select c.node, c.depth, min(p.node) parent from {way}_m c left join (select p.node, p.depth, e.{b} as child from {way}_m p join e on e.{a} = p.node and e.relation = 'calls') p on p.child = c.node and p.depth = c.depth - 1 group by 1, 2),
    {way}_g as (select node node_id, name, type, path, depth, '{way}' as direction, parent parent_id from {way}_p join loc on loc.id = node{' order by depth, node limit 200' if listing else ''})"""


@R.query("call_graph_callers", sql(f"{_walk('callers', 3, 'update')} select * from callers_g", True))
def call_graph_callers(spark, d):
    return T.call_graph(graph(spark, d), "update", "callers", 3)


@R.query("call_graph_callees", sql(f"{_walk('callees', 3, 'update')} select * from callees_g", True))
def call_graph_callees(spark, d):
    return T.call_graph(graph(spark, d), "update", "callees", 3)


@R.query("call_graph_both", sql(f"{_walk('callers', 2, 'handle')}, {_walk('callees', 2, 'handle')} select * from callers_g union all select * from callees_g", True))
def call_graph_both(spark, d):
    return T.call_graph(graph(spark, d), "handle", "both", 2)


@R.query("call_graph_rollup", sql(
    f"{_walk('callers', 2, 'handle', False)} select g.path, direction, count(*) n, array_to_string(list(g.name order by depth, node_id)[1:10], ',') as names, min(depth) min_depth, max(depth) max_depth "
    f"from callers_g g join n on n.id = node_id where depth > 0 and not {_test('g.name', 'g.path', 'n.is_test')} group by 1, 2", True
))
def call_graph_rollup(spark, d):
    return T.rollup(T.callers_and_callees(graph(spark, d), "handle", "callers", 2))


@R.query("call_graph_tool", sql(
    f"{_walk('callers', 3, 'update', False)}, {_walk('callees', 3, 'update', False)}, u as (select * from callers_g union all select * from callees_g), "
    f"k as (select u.name, u.path, depth, direction, min(node_id) node_id from u join n on n.id = node_id where depth > 0 and not {_test('u.name', 'u.path', 'n.is_test')} group by 1, 2, 3, 4) "
    "select * from k qualify row_number() over (partition by direction order by depth, node_id) <= 200", True
))
def call_graph_tool(spark, d):
    return T.call_graph_tool(graph(spark, d), "update", "both", 3)


@R.query("impact", sql(
    f"""{_walk('callers', 3, 'update', False)}, rt as (select source_id, arg_min(metadata, id) route from e where relation = 'routes_to' group by 1),
    x as (select g.*, rt.route, {_test('g.name', 'g.path', 'n.is_test')} as t from callers_g g left join n on n.id = g.node_id left join rt on rt.source_id = g.node_id),
    s as (select sum(case when depth > 0 and not t then 1 else 0 end) prod_callers, sum(case when depth > 0 and t then 1 else 0 end) test_callers, sum(case when depth = 1 and not t then 1 else 0 end) direct,
      sum(case when depth > 1 and not t then 1 else 0 end) transitive, count(distinct case when depth > 0 and not t then path end) files, sum(case when depth > 0 and route is not null then 1 else 0 end) routes, min(case when depth = 0 then type end) kind from x)
    select prod_callers, test_callers, direct, transitive, files, routes, case when kind not in ('function', 'method') and prod_callers = 0 then 'UNKNOWN' when prod_callers > 10 or routes >= 3 then 'HIGH' when prod_callers > 3 or routes > 0 then 'MEDIUM' else 'LOW' end as risk from s""", True
))
def impact(spark, d):
    return A.impact(graph(spark, d), "update", 3)


_PAIRS = "fe as (select a.file_id s, b.file_id t, count(*) k from e join n a on a.id = source_id join n b on b.id = target_id where relation in ('imports', 'calls') and a.file_id <> b.file_id group by 1, 2), root as (select file_id from f where path = " + _BUSY + ")"
_FWALK = "fw(node, depth) as (select file_id, 0 from root union select t, depth + 1 from fw join fe on fe.s = fw.node where depth < 2), fm as (select node, min(depth) depth from fw group by 1)"


@R.query("import_tree", sql(
    f"{_PAIRS}, {_FWALK} select path, lang as language, depth, coalesce(k, 0) n from fm join f on f.file_id = node left join fe on fe.s = (select file_id from root) and fe.t = node where depth > 0", True
))
def import_tree(spark, d):
    g = graph(spark, d)
    return T.import_tree(g, _busy(g), "outgoing", 2)


_FAMILY = "case when {0} in ('javascript', 'typescript', 'tsx') then 'js' when {0} in ('c', 'cpp') then 'c' else {0} end"


@R.query("dependency_graph", sql(
    f"{_PAIRS}, {_FWALK} select path, depth, coalesce(k, 0) n from fm join f on f.file_id = node left join fe on fe.s = (select file_id from root) and fe.t = node where depth > 0 and path <> '<external>' "
    f"and (lang is null or (select lang from f where file_id = (select file_id from root)) is null or {_FAMILY.format('lang')} = (select {_FAMILY.format('lang')} from f where file_id = (select file_id from root)))", True
))
def dependency_graph(spark, d):
    g = graph(spark, d)
    return T.dependency_graph(g, _busy(g), "outgoing", 2)


@R.query("route_trace", sql(
    f"{_ROUTES}, hw(h, node, depth) as (select distinct target_id, target_id, 0 from r join loc on loc.id = target_id where route = '/v1' or starts_with(route, '/v1/') union select h, e.target_id, depth + 1 from hw join e on e.source_id = node and relation = 'calls' where depth < 3) "
    "select h handler_id, node node_id, name, depth from (select h, node, min(depth) depth from hw group by 1, 2) join n on n.id = node", True
))
def route_trace(spark, d):
    return T.trace_routes(graph(spark, d), "/v1", 3)


# --- snapshots ---------------------------------------------------------------------

_OLD = "o as (select path, min_by(content_hash, indexed_at) h, min(indexed_at) a from files where path is not null group by 1)"


def _first_hashes(spark, d):
    t = table(spark, d, "files").where("path is not null")
    return t.groupBy("path").agg(F.min_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"))


@R.query("snapshot_diff", sql(
    "o as (select path, content_hash h from files where path is not null qualify row_number() over (partition by path order by indexed_at, content_hash) = 1), "
    "k as (select path, h from o), w as (select path, content_hash h from f) "
    "select coalesce(k.path, w.path) path, case when k.path is null then 'new' when w.path is null then 'deleted' else 'changed' end as status from k full join w on k.path = w.path where k.path is null or w.path is null or k.h is distinct from w.h"
))
def snapshot_diff(spark, d):
    # two states of the file table, both whole: first indexing and current rows
    return M.snapshot_diff(_first_hashes(spark, d), graph(spark, d).files)


@R.query("upsert_files", sql(
    "o as (select path, content_hash h from files where path is not null qualify row_number() over (partition by path order by indexed_at, content_hash) = 1) select path, coalesce(f.content_hash, h) content_hash from o left join f using (path)"
))
def upsert_files(spark, d):
    return M.upsert(_first_hashes(spark, d), graph(spark, d).files.select("path", "content_hash"), ["path"])


@R.query("cascade_delete", sql(
    f"kf as (select * from f where path not in {_LATE}), kn as (select id from n where file_id in (select file_id from kf)), ke as (select * from e where source_id in (select id from kn) and target_id in (select id from kn)) "
    "select 'files' as part, count(*) n from kf union all select 'nodes', count(*) from kn union all select 'edges', count(*) from ke"
))
def cascade_delete(spark, d):
    g = graph(spark, d)
    k = M.delete_files(g, _late(g))
    part = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part("files", k.files).unionByName(part("nodes", k.nodes)).unionByName(part("edges", k.edges))


@R.query("dedupe_edges", sql("select id, source_id, target_id, relation, metadata from e"))
def dedupe_edges(spark, d):
    return graph(spark, d).edges.select("id", "source_id", "target_id", "relation", "metadata")


@R.query("merge_edges", sql(
    "x as (select distinct target_id source_id, source_id target_id, relation, metadata from e where relation = 'implements') "
    "select source_id, target_id, relation, metadata from e union select * from x"
))
def merge_edges(spark, d):
    g = graph(spark, d)
    back = g.edges.where(F.col("relation") == S.IMPLEMENTS).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation", "metadata")
    return M.add_edges(g, back).select("source_id", "target_id", "relation", "metadata")


# --- build steps -------------------------------------------------------------------


@R.query("edge_resolution", sql(
    f"""rel as (select e.id rel_id, s.id source_id, s.path, s.lang, t.name tname, e.relation from e join loc s on s.id = e.source_id join n t on t.id = e.target_id),
    l as (select distinct rel_id, rel.source_id, loc.id target_id, relation, 1 tier from rel join loc on loc.name = tname and loc.path = rel.path),
    q as (select * from rel where rel_id not in (select rel_id from l) and not (relation = 'calls' and tname in ({', '.join(repr(x) for x in P.NOISE_NAMES)}))),
    w as (select rel_id, q.source_id, q.path cp, loc.id target_id, loc.path tp, relation, case when q.lang is null or loc.lang is null or {_FAMILY.format('q.lang')} = {_FAMILY.format('loc.lang')} then 2 when relation <> 'calls' then 3 end tier from q join loc on loc.name = tname),
    w1 as (select *, %s as tt, %s as ct from (select * from w where tier is not null qualify tier = min(tier) over (partition by rel_id))),
    w2 as (select * from w1 qualify tier = 3 or ct or not bool_or(not tt) over (partition by rel_id) or not tt),
    w3 as (select *, case when tier = 2 then coalesce(list_position(list_transform(range(1, length(cp) + 1), lambda i: i > length(tp) or substr(cp, i, 1) <> substr(tp, i, 1)), true) - 1, length(cp)) else 0 end as near from w2),
    w4 as (select * from w3 qualify near = max(near) over (partition by rel_id))
    select distinct rel_id, source_id, target_id, relation, tier from (select * from l union all select rel_id, source_id, target_id, relation, tier from w4) where source_id <> target_id or relation = 'routes_to'"""
    % tuple("(" + " or ".join([f"starts_with({c}, 'tests/')", f"starts_with({c}, 'test/')", *[f"contains({c}, '{x}')" for x in (".test.", "_test.", "/tests/", "/test/", ".spec.")]]) + ")" for c in ("tp", "cp"))
))
def edge_resolution(spark, d):
    g = graph(spark, d)
    loc = g.located("name")
    t = g.nodes.select(F.col("id").alias("_t"), F.col("name").alias("target_name"))
    rel = g.edges.select(F.col("id").alias("rel_id"), "source_id", "target_id", "relation").join(t, F.col("target_id") == F.col("_t"))
    rel = rel.join(loc.select(F.col("id").alias("_s"), "path", "language"), F.col("source_id") == F.col("_s")).select("rel_id", "source_id", "path", "language", "target_name", "relation")
    return X.resolve(rel, loc.select("id", "name", "path", "language"))


@R.query("module_suffix_map", sql(
    r"a as (select path, string_split(regexp_replace(regexp_replace(path, '\.py$', ''), '(^|/)__init__$', ''), '/') a from f where ends_with(path, '.py')) "
    "select distinct array_to_string(a[i:], '.') as module, path from (select path, a, unnest(range(1, len(a) + 1)) i from a where a[len(a)] <> '')"
))
def module_suffix_map(spark, d):
    return X.module_suffixes(graph(spark, d).files)


@R.query("external_sentinels", sql(
    r"a as (select path, string_split(regexp_replace(regexp_replace(path, '\.py$', ''), '(^|/)__init__$', ''), '/') a from f where ends_with(path, '.py')), k as (select distinct array_to_string(a[i:], '.') as module from (select a, unnest(range(1, len(a) + 1)) i from a)) "
    "select distinct json_extract_string(metadata, '$.python_module') as module from e where relation = 'imports' and json_valid(metadata) and json_extract_string(metadata, '$.python_module') is not null and json_extract_string(metadata, '$.python_module') not in (select module from k)"
))
def external_sentinels(spark, d):
    return X.unresolved_modules(graph(spark, d))


@R.query("context_string", sql(
    f"""o as (select e.source_id id, case when relation = 'routes_to' then 'routes' else relation end k,
      case when relation = 'routes_to' then coalesce(case when json_valid(e.metadata) then json_extract_string(e.metadata, '$.method') || ' ' || json_extract_string(e.metadata, '$.path') end, t.name) else t.name end v from e join n t on t.id = e.target_id
      union select e.target_id, 'called_by', s.name from e join n s on s.id = e.source_id where relation = 'calls'),
    q as (select id, k, list_sort(list(v)) vs from (select distinct id, k, v from o where v is not null) group by 1, 2),
    m as (select id, k, case when k in ('routes', 'calls', 'called_by') then array_to_string(vs[1:10], ', ') else array_to_string(vs, ', ') end || case when k in ('calls', 'called_by') and len(vs) > 10 then ' (+' || (len(vs) - 10) || ')' else '' end as t from q),
    p as (select id, {', '.join(f"max(case when k = '{k}' then '{k}: ' || t end) as c{i}" for i, k in enumerate(('routes', 'calls', 'called_by', 'inherits', 'imports', 'implements', 'exports')))} from m group by 1)
    select loc.id, md5(concat_ws(chr(10), 'signature: ' || signature, 'returns: ' || nullif(return_type, ''), 'params: ' || nullif(param_types, ''), type || ' ' || coalesce(qualified_name, name),
      case when lang is not null then lang || ' in ' || path else 'in ' || path end, c0, c1, c2, c3, c4, c5, c6, 'doc: ' || doc_comment, 'code: ' || code_content)) as digest from loc left join p on p.id = loc.id where path <> '<external>'"""
))
def context_string(spark, d):
    return X.context_strings(graph(spark, d)).select("id", F.md5(F.encode("context_string", "UTF-8")).alias("digest"))


# --- shaping -----------------------------------------------------------------------


@R.query("token_estimate", sql(
    "b as (select coalesce(octet_length(encode(context_string)), coalesce(octet_length(encode(code_content)), 0) + coalesce(octet_length(encode(name)), 0) + coalesce(octet_length(encode(signature)), 0)) b from n) select cast(floor(coalesce(sum(b), 0) / 3) as bigint) as tokens from b"
))
def token_estimate(spark, d):
    return Z.estimate_tokens(graph(spark, d).nodes)


@R.query("compress_levels", sql(
    "b as (select path, sum(coalesce(octet_length(encode(context_string)), coalesce(octet_length(encode(code_content)), 0) + coalesce(octet_length(encode(name)), 0) + coalesce(octet_length(encode(signature)), 0))) b from loc group by 1), "
    "t as (select path, cast(floor(b / 3) as bigint) tokens from b) select path, tokens, case when tokens <= 500 then 'none' when tokens <= 1500 then 'nodes' when tokens <= 4000 then 'files' else 'directories' end as level from t"
))
def compress_levels(spark, d):
    rows = graph(spark, d).located("name", "code_content", "signature", "context_string")
    t = rows.groupBy("path").agg(F.floor(F.sum(Z.size_bytes()) / S.CHARS_PER_TOKEN).cast("long").alias("tokens"))
    return t.withColumn("level", Z.level(F.col("tokens"), 500))


@R.query("summary_nodes", sql("select id, path, type || ' ' || name || ' in ' || path || ' (lines ' || start_line || '-' || end_line || ')' || coalesce(' ' || signature, '') as summary from loc"))
def summary_nodes(spark, d):
    return Z.node_summaries(graph(spark, d).located("name", "type", "start_line", "end_line", "signature"))


@R.query("summary_directories", sql(f"select {_DIR} as path, {_DIR} || ': ' || count(distinct path) || ' files, ' || count(*) || ' symbols' as summary from loc group by {_DIR}"))
def summary_directories(spark, d):
    return Z.by_directory(graph(spark, d).located("name", "type"))


@R.query("compact_lines", sql("select id, concat_ws(' ', type, name, path || ':' || start_line || '-' || end_line, signature) as line from loc"))
def compact_lines(spark, d):
    return graph(spark, d).located("name", "type", "start_line", "end_line", "signature").select("id", Z.compact_line().alias("line"))
