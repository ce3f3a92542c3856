"""Parent-child links to full hierarchies by heavy-path decomposition.

1. Pointer doubling over the links: after round k a node points to its ancestor
   2^k links up. The same rounds add up subtree sizes (a node's size over 2^(k+1)
   levels is its size over 2^k levels plus those of the nodes exactly 2^k below
   it), a plain ``groupBy`` with map-side combine that no hot parent can skew. A
   round that resolves no further node leaves only nodes whose chain never ends.
2. Cycle separation: the images of those nodes under the doubled pointer shrink to
   the cycle nodes; doubling minima over them gives each cycle its smallest id.
3. Each parent's child with the largest subtree continues the parent's heavy chain;
   doubling along heavy links gives every node its chain and position.
4. A node's path crosses at most log2(n) chains: chain prefixes are concatenated
   level by level over the (much smaller) table of chains. Preorder numbers, heavy
   child first, make the descendants of a node the interval [tin, tout) of its root.

All rounds are logarithmic in the longest chain; each round's state is a written
table. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import running_sum
from codeloom.storage import Scratch


def inherit_links(nodes: DataFrame, edges: DataFrame, relation: str = "inherits") -> DataFrame:
    """(child, parent), one row per link whose both ends are nodes; relation is trimmed and compared in lower case."""
    ids = nodes.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    links = edges.where(F.lower(F.trim("relation")) == relation).select(
        F.col("source_id").alias("child"), F.col("target_id").alias("parent")
    )
    links = links.where("child is not null and parent is not null").distinct()
    links = links.join(ids, links.child == ids._id, "left_semi")
    return links.join(ids, links.parent == ids._id, "left_semi")


def _doubled(scratch: Scratch, state: DataFrame, active: int) -> tuple[DataFrame, bool]:
    """Rounds of pointer doubling; state: v, jump, steps, done, size. Second: whether unresolved nodes remain."""
    def grown(rows: DataFrame, before: DataFrame, k: int) -> DataFrame:
        adds = before.where(F.col("steps") == F.lit(1 << k)).groupBy(F.col("jump").alias("_to")).agg(F.sum("size").alias("_add"))
        rows = rows.join(adds, F.col("v") == F.col("_to"), "left")
        return rows.withColumn("size", F.col("size") + F.coalesce("_add", F.lit(0))).drop("_to", "_add")

    k = 0
    while active:
        right = state.select(F.col("v").alias("_v"), F.col("jump").alias("_j"), F.col("steps").alias("_s"), F.col("done").alias("_d"))
        go = state.where("not done").join(right, F.col("jump") == F.col("_v")).select(
            "v", F.col("_j").alias("jump"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done"), "size"
        )
        new = grown(go.unionByName(state.where("done")), state, k)
        state, seen = scratch.save_counting(new, state, left=~F.col("done"))
        if seen["left"] == active:
            return state, True
        active, k = seen["left"], k + 1
    return scratch.save(grown(state, state, k), state), False  # nodes exactly 2^k below an ancestor, where no chain is longer


def _cycles(scratch: Scratch, links: DataFrame, state: DataFrame) -> DataFrame:
    """(v, root_id) of the nodes whose chain of parents never ends; root_id is the least id on their cycle."""
    hop = scratch.save(state.where("not done").select("v", "jump"))
    image = hop.select("jump").distinct().count()
    while True:
        right = hop.select(F.col("v").alias("_v"), F.col("jump").alias("_j"))
        hop = scratch.save(hop.join(right, F.col("jump") == F.col("_v")).select("v", F.col("_j").alias("jump")), replaces=hop)
        now = hop.select("jump").distinct().count()
        if now == image:
            break
        image = now
    on = hop.select(F.col("jump").alias("c")).distinct()
    ring = links.join(on, links.child == on.c, "left_semi").select(F.col("child").alias("v"), F.col("parent").alias("jump"))
    ring = scratch.save(ring.withColumn("least", F.col("v")))
    while True:
        right = ring.select(F.col("v").alias("_v"), F.col("jump").alias("_j"), F.col("least").alias("_l"))
        new = ring.drop("changed").join(right, F.col("jump") == F.col("_v")).select(
            "v", F.col("_j").alias("jump"), F.least("least", "_l").alias("least"), (F.col("_l") < F.col("least")).alias("changed")
        )
        ring, seen = scratch.save_counting(new, ring, changed=F.col("changed"))
        if not seen["changed"]:
            break
    least = ring.select(F.col("v").alias("_v"), F.col("least").alias("root_id"))
    return hop.join(least, F.col("jump") == F.col("_v")).select("v", "root_id")


def hierarchy(links: DataFrame) -> DataFrame:
    """Every node of ``links`` (child, parent) with its place in its tree.

    Columns: node_id, parent_id, root_id, depth, chain_id, chain_pos, segments
    (the path as chain prefixes: array of <chain, upto>), tin, tout, n_descendants,
    in_cycle. The descendants of x are the nodes of the same root with
    tin(x) < tin < tout(x).

    Repeated links count once and links with a null end are dropped. If a child has
    several parents the smallest is its parent. Nodes whose chain of parents
    runs into a cycle (self links included) get in_cycle, depth -1, the smallest id
    on the cycle as root_id and nulls elsewhere. An empty input gives no rows; extra
    columns are ignored.
    """
    scratch = Scratch(links.sparkSession)
    links = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    links = scratch.save(links)
    up = links.select(F.col("child").alias("_c"))
    kids = links.join(up, F.col("parent") == F.col("_c"), "left").select(
        F.col("child").alias("v"), F.col("parent").alias("jump"), F.lit(1).cast("long").alias("steps"), F.col("_c").isNull().alias("done")
    )
    roots = links.select(F.col("parent").alias("v")).distinct().join(up, F.col("v") == F.col("_c"), "left_anti")
    roots = roots.select("v", F.col("v").alias("jump"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done"))
    state, seen = scratch.save_counting(kids.unionByName(roots).withColumn("size", F.lit(1).cast("long")), active=~F.col("done"))
    state, cyclic = _doubled(scratch, state, seen["active"])

    # heavy chains over the acyclic part
    sized = state.where("done").select("v", "size")
    tree = scratch.save(sized.join(links, F.col("v") == F.col("child"), "left").select("v", "parent", "size"))
    heavy = tree.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(
        F.max(F.struct("size", (-F.col("v")).alias("neg"))).alias("_m")
    )
    heavy = heavy.select("_p", (-F.col("_m.neg")).alias("_heavy"), F.col("_m.size").alias("_hsize"))
    tree = scratch.save(
        tree.join(heavy, F.col("parent") == F.col("_p"), "left")
        .withColumn("is_heavy", F.coalesce(F.col("_heavy") == F.col("v"), F.lit(False)))
        .select("v", "parent", "size", "is_heavy", F.col("_hsize").alias("heavy_size")),
        replaces=tree,
    )
    chain, seen = scratch.save_counting(
        tree.select(
            "v",
            F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("v")).alias("jump"),
            F.col("is_heavy").cast("long").alias("steps"),
            (~F.col("is_heavy")).alias("done"),
        ),
        active=~F.col("done"),
    )
    while seen["active"]:
        right = chain.select(F.col("v").alias("_v"), F.col("jump").alias("_j"), F.col("steps").alias("_s"), F.col("done").alias("_d"))
        go = chain.where("not done").join(right, F.col("jump") == F.col("_v")).select(
            "v", F.col("_j").alias("jump"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_d").alias("done")
        )
        chain, seen = scratch.save_counting(go.unionByName(chain.where("done")), chain, active=~F.col("done"))
    chain = chain.select("v", F.col("jump").alias("head"), F.col("steps").alias("pos"))

    # chains hang off chains: concatenate prefixes and preorder offsets over the table of chains
    light = tree.where("parent is not null and not is_heavy")
    light = running_sum(light, ["parent"], F.col("size"), [F.col("v")], "_before")
    light = light.select(F.col("v").alias("head"), "parent", (F.col("_before") + F.col("heavy_size") + 1).alias("off"))
    at = chain.select(F.col("v").alias("_v"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"))
    hung = scratch.save(light.join(at, F.col("parent") == F.col("_v")).select("head", "up_head", "up_pos", "off"))
    tops = tree.where("parent is null").select(F.col("v").alias("head"))
    segment = "array<struct<chain:bigint,upto:bigint>>"
    level = scratch.save(
        tops.select("head", F.col("head").alias("root_id"), F.array().cast(segment).alias("segments"), F.lit(0).cast("long").alias("tin"))
    )
    levels = [level]
    while True:
        up = level.select(F.col("head").alias("_h"), "root_id", F.col("segments").alias("_seg"), F.col("tin").alias("_tin"))
        step = hung.join(up, F.col("up_head") == F.col("_h")).select(
            "head",
            "root_id",
            F.concat("_seg", F.array(F.struct(F.col("up_head").alias("chain"), F.col("up_pos").alias("upto")))).alias("segments"),
            (F.col("_tin") + F.col("up_pos") + F.col("off")).alias("tin"),
        )
        level, seen = scratch.save_counting(step, rows=F.lit(True))
        if not seen["rows"]:
            break
        levels.append(level)
    heads = levels[0]
    for x in levels[1:]:
        heads = heads.unionByName(x)
    heads = heads.withColumnRenamed("head", "_head").withColumnRenamed("tin", "_tin")
    out = (
        chain.join(heads, F.col("head") == F.col("_head"))
        .join(tree.select(F.col("v").alias("_t"), "parent", "size"), F.col("v") == F.col("_t"))
        .select(
            F.col("v").alias("node_id"),
            F.col("parent").alias("parent_id"),
            "root_id",
            (F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["upto"] + 1) + F.col("pos")).alias("depth"),
            F.col("head").alias("chain_id"),
            F.col("pos").alias("chain_pos"),
            "segments",
            (F.col("_tin") + F.col("pos")).alias("tin"),
            (F.col("_tin") + F.col("pos") + F.col("size")).alias("tout"),
            (F.col("size") - 1).alias("n_descendants"),
            F.lit(False).alias("in_cycle"),
        )
    )
    if not cyclic:
        return out
    loops = _cycles(scratch, links, state)
    none = F.lit(None)
    loops = loops.join(links, F.col("v") == F.col("child")).select(
        F.col("v").alias("node_id"),
        F.col("parent").alias("parent_id"),
        "root_id",
        F.lit(-1).cast("long").alias("depth"),
        none.cast("long").alias("chain_id"),
        none.cast("long").alias("chain_pos"),
        none.cast(segment).alias("segments"),
        none.cast("long").alias("tin"),
        none.cast("long").alias("tout"),
        none.cast("long").alias("n_descendants"),
        F.lit(True).alias("in_cycle"),
    )
    return out.unionByName(loops)


#: Positions of a descendant interval that are enumerated at a time.
SPAN = 100_000


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every descendant of every node: each node's interval of preorder numbers, enumerated and joined with the numbers.

    Its size is that of the answer, the sum of all depths. Long intervals are cut into spans before they are enumerated, and the side that is joined has one
    row a number, so neither a large tree nor a hot root is gathered anywhere.
    """
    inner = tree.where("not in_cycle and n_descendants > 0").select(F.col("node_id").alias("ancestor_id"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"), (F.col("tin") + 1).alias("_first"), F.col("tout").alias("_end"))
    spans = inner.withColumn("_at", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1, F.lit(SPAN).cast("long"))))
    each = spans.withColumn("_no", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + SPAN, F.col("_end")) - 1)))
    nodes = tree.where("not in_cycle").select("node_id", "root_id", "tin", "depth")
    return each.join(nodes, (F.col("_root") == F.col("root_id")) & (F.col("_no") == F.col("tin"))).select("ancestor_id", "node_id", (F.col("depth") - F.col("_depth")).alias("distance"))


def paths(tree: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path, n_descendants, in_cycle); path holds the ids from the root to the node, null in a cycle.

    Chain segments are concatenated: each chain is one array of its members, the path to a chain's head is put together once a chain from the
    prefixes of at most log2(n) others, and a node adds the prefix of its own. No chain is longer than the path of its last member.
    """
    tree = Scratch(tree.sparkSession).save(tree)
    members = F.transform(F.array_sort(F.collect_list(F.struct("chain_pos", "node_id"))), lambda x: x["node_id"])
    chains = tree.where("not in_cycle").groupBy(F.col("chain_id").alias("_chain")).agg(members.alias("_members"))
    heads = tree.where("not in_cycle and chain_pos = 0").select("chain_id", F.posexplode("segments").alias("_k", "_s"))
    part = F.slice("_members", F.lit(1), (F.col("_s.upto") + 1).cast("int"))
    above = heads.join(chains, F.col("_s.chain") == F.col("_chain")).select("chain_id", F.struct("_k", part.alias("p")).alias("_part"))
    above = above.groupBy(F.col("chain_id").alias("_head")).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["p"])).alias("_above"))
    rows = tree.join(chains, F.col("chain_id") == F.col("_chain"), "left").join(above, F.col("chain_id") == F.col("_head"), "left")
    full = F.concat(F.coalesce("_above", F.array().cast("array<bigint>")), F.slice("_members", F.lit(1), (F.col("chain_pos") + 1).cast("int")))
    return rows.select("node_id", "root_id", "depth", F.when(~F.col("in_cycle"), full).alias("path"), "n_descendants", "in_cycle")
