"""A typed digraph as two tables, its traversals and scored strategies.

nodes: id, name, type, description; edges: src, dst, rel_type (upper case),
view_id, ordinal. Traversals are level sets: a node counts at its least number
of hops, whatever the order of edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions.config import GRAPH, RETRIEVAL
from weavegrid.functions.scoring import abstraction_factor, choice
from weavegrid.operators.scratch import dropped, kept
from weavegrid.operators.sparse import ranked, tfidf_relevance


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def with_reciprocals(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, rel_type and the reverse of each relation that has one, once; to known nodes only, where these are given."""
    pairs = edges.select("src", "dst", "rel_type")
    back = reduce(lambda c, kv: c.when(F.col("rel_type") == kv[0], kv[1]), list(GRAPH.reciprocal.items())[1:], F.when(F.col("rel_type") == next(iter(GRAPH.reciprocal)), next(iter(GRAPH.reciprocal.values()))))
    reverse = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("rel_type")).where("rel_type is not null")
    if nodes is not None:
        reverse = reverse.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "rel_type")
    return pairs.union(reverse).distinct()


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count("*").alias("n_edges"))


def ends(edges: DataFrame) -> DataFrame:
    """id, other, rel_type, way: every edge from both of its ends."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type", F.lit("out").alias("way"))
    return out.union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel_type", F.lit("in").alias("way")))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def richness(edges: DataFrame) -> DataFrame:
    """id, n_types, n_relations, score: how many kinds of relations a node has, and how many."""
    counts = ends(edges).groupBy("id").agg(F.countDistinct("rel_type").alias("n_types"), F.count("*").alias("n_relations"))
    return counts.withColumn("score", F.least(F.lit(0.3), F.col("n_types") * 0.1 + F.col("n_relations") * 0.005))


def steps(edges: DataFrame, relations=None, way: str = "out") -> DataFrame:
    """src, dst, rel_type of moves along (out), against (in) or either way (both)."""
    rows = edges if relations is None else edges.where(F.col("rel_type").isin(*relations))
    along = rows.select("src", "dst", "rel_type")
    against = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
    return along if way == "out" else against if way == "in" else along.union(against)


def bfs(moves: DataFrame, seeds: DataFrame, depth: int, weight: Column | None = None, keep_seeds: bool = False) -> DataFrame:
    """seed, node, level, weight: nodes within ``depth`` hops at their least level.

    weight: of a move, by rel_type; a node gets the largest among the moves
    that reach it at its level. seeds: seed, node.
    """
    w = F.lit(1.0) if weight is None else weight
    moves = moves.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    seen = seeds.select("seed", "node").distinct().withColumn("level", F.lit(0)).withColumn("weight", F.lit(1.0))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select("seed", F.col("node").alias("src")).join(moves, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.max("w").alias("weight"))
        frontier = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("level"), "weight")
        seen = seen.union(frontier)
    return seen if keep_seeds else seen.where("level > 0")


def walks(moves: DataFrame, seeds: DataFrame, depths: dict[str, int]) -> DataFrame:
    """kind, seed, node, level, weight: ``bfs`` of several kinds of moves at once, each to its own depth; seeds stand at level 0.

    moves: kind, src, dst, w; seeds: kind, seed, node. One join and one stored
    frontier a level, whatever the number of kinds.
    """
    moves = kept(moves.groupBy("kind", "src", "dst").agg(F.max("w").alias("w")))
    most = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), list(depths.items())[1:], F.when(F.col("kind") == next(iter(depths)), next(iter(depths.values()))))
    levels = [kept(seeds.select("kind", "seed", "node").distinct().withColumns({"level": F.lit(0), "weight": F.lit(1.0)}))]
    for level in range(1, max(depths.values()) + 1):
        seen = reduce(DataFrame.union, [x.select("kind", "seed", "node") for x in levels])
        going = levels[-1].where(most >= level).select("kind", "seed", F.col("node").alias("src"))
        reached = going.join(moves, ["kind", "src"]).groupBy("kind", "seed", F.col("dst").alias("node")).agg(F.max("w").alias("weight"))
        levels.append(kept(reached.join(seen, ["kind", "seed", "node"], "left_anti").select("kind", "seed", "node", F.lit(level).alias("level"), "weight")))
    dropped(moves)
    return reduce(DataFrame.union, levels)


def explicit_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, score: what relations lead to from mentioned entries, three hops in either direction, stronger relations and nearer nodes first."""
    found = bfs(steps(edges, way="both"), seeds, 3, choice(F.col("rel_type"), GRAPH.edge_weights))
    return found.select("seed", "node", "level", (F.col("weight") * F.greatest(F.lit(0.5), 1 - 0.2 * (F.col("level") - 1))).alias("score"))


def first_parents(edges: DataFrame) -> DataFrame:
    """src, dst: the CHILDOF parent with the smallest id."""
    return edges.where("rel_type = 'CHILDOF'").groupBy("src").agg(F.min("dst").alias("dst"))


def abstraction_up(nodes: DataFrame, edges: DataFrame, levels: int = 3, of: DataFrame | None = None) -> DataFrame:
    """node, ancestor, level, score of variants and bases; of: only of these (node)."""
    own = nodes if of is None else nodes.join(of.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    rows = own.where(F.lower("type").isin("variant", "base")).select(F.col("id").alias("node"), F.col("id").alias("at"))
    parents = first_parents(edges)
    out = []
    for level in range(1, levels + 1):
        rows = rows.join(parents.withColumnRenamed("src", "at"), "at").select("node", F.col("dst").alias("at"))
        out.append(rows.select("node", F.col("at").alias("ancestor"), F.lit(level).alias("level"), F.lit(0.8 * 0.7**level).alias("score")))
    return reduce(DataFrame.union, out)


def abstraction_down(nodes: DataFrame, edges: DataFrame, levels: int = 3, of: DataFrame | None = None) -> DataFrame:
    """node, descendant, level (0: the node itself), score of classes, pillars and bases; of: only of these (node)."""
    own = nodes if of is None else nodes.join(of.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    seeds = own.where(F.lower("type").isin("class", "pillar", "base")).select(F.col("id").alias("seed"), F.col("id").alias("node"))
    found = bfs(steps(edges, ("CHILDOF",), "in"), seeds, levels - 1, keep_seeds=True)
    kind = nodes.select(F.col("id").alias("node"), F.lower("type").alias("kind"))
    base = choice(F.col("kind"), {"base": 0.9, "variant": 0.95}, 0.7)
    return found.join(kind, "node").select(F.col("seed").alias("node"), F.col("node").alias("descendant"), "level", (base * F.pow(F.lit(0.8), F.col("level"))).alias("score"))


def sequence_forward(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    found = bfs(steps(edges, GRAPH.sequence), seeds, 3, F.when(F.col("rel_type").isin(*GRAPH.forward), 1.0).otherwise(0.9))
    return found.select("seed", "node", "level", (F.col("weight") * F.pow(F.lit(0.8), F.col("level") - 1)).alias("score"))


def sequence_backward(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return bfs(steps(edges, GRAPH.forward, "in"), seeds, 3).select("seed", "node", "level", F.pow(F.lit(0.8), F.col("level") - 1).alias("score"))


def peers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return bfs(steps(edges, GRAPH.peer, "both"), seeds, 2).select("seed", "node", "level", (0.9 * F.pow(F.lit(0.7), F.col("level") - 1)).alias("score"))


def chain_progression(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    found = bfs(steps(edges, GRAPH.forward), seeds, 3)
    return found.select("seed", "node", "level", F.concat(F.lit("consequence_depth_"), F.col("level")).alias("role"), (0.9 - 0.1 * (F.col("level") - 1)).alias("score"))


def ancestor_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, chain: first parents up to the top, or up to the first that came before, however long that is.

    Chains double: a node's first 2n ancestors are its first n and the n of the
    last of them, so rounds are the logarithm of the longest chain. A chain in
    which an ancestor repeats has gone round a cycle and ends before it.
    """
    first = first_parents(edges)
    now = kept(first.select(F.col("src").alias("node"), F.array("dst").alias("chain"), F.col("dst").alias("at")))
    while now.where("at is not null").limit(1).count():
        further = now.select(F.col("node").alias("at"), F.col("chain").alias("more"), F.col("at").alias("further"))
        going = now.where("at is not null").join(further, "at", "left")
        whole = F.concat("chain", F.coalesce("more", F.array().cast("array<string>")))
        going = going.select("node", F.array_distinct(whole).alias("chain"), F.when(F.size(F.array_distinct(whole)) == F.size(whole), F.col("further")).alias("at"))
        after = kept(going.union(now.where("at is null")))
        dropped(now)
        now = after
    return now.select("node", "chain").join(nodes.select(F.col("id").alias("node")), "node", "left_semi")


def abstraction_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """variant, base, class, pillar: typed CHILDOF paths."""
    up = edges.where("rel_type = 'CHILDOF'").select("src", "dst")
    of = lambda kind: nodes.where(F.lower("type") == kind.lower()).select(F.col("id").alias(kind))
    rows = of("variant")
    for low, high in (("variant", "base"), ("base", "class"), ("class", "pillar")):
        rows = rows.join(up.select(F.col("src").alias(low), F.col("dst").alias(high)), low).join(of(high), high, "left_semi")
    return rows.select("variant", "base", "class", "pillar")


def groups_of(edges: DataFrame, relations=GRAPH.peer) -> DataFrame:
    """node, group: components over the relations, named by their smallest node.

    Every node points to the smallest of itself and its neighbours, pointers
    jump to their ends, and the links go on between these, until none are
    left: of a path only nodes smaller than both neighbours go on, so rounds
    are few and their tables shrink. A node's pointers are then followed from
    the last round back to the first.
    """
    moves = kept(steps(edges, relations, "both").select("src", "dst").where("src <> dst").distinct())
    alone = kept(steps(edges, relations).where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("to")).distinct())
    rounds = []
    while moves.limit(1).count():
        to = kept(moves.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("to"), F.lit(True).alias("moved")))
        while to.where("moved").limit(1).count():
            jump = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            after = kept(to.join(jump, "to").select("node", F.col("further").alias("to"), (F.col("further") < F.col("to")).alias("moved")))
            dropped(to)
            to = after
        rounds.append(to)
        of = lambda end: to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        links = moves.join(of("src"), "src").join(of("dst"), "dst").where("src_to <> dst_to")
        after = kept(links.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct())
        dropped(moves)
        moves = after
    dropped(moves)
    groups = None
    for to in reversed(rounds):
        if groups is None:
            groups = to
            continue
        further = groups.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = kept(to.select("node", "to").join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        dropped(to, groups)
        groups = after
    groups = alone if groups is None else groups.select("node", "to").union(alone.join(groups.select("node"), "node", "left_anti"))
    return groups.select("node", F.col("to").alias("group"))


def combined(strategies: DataFrame, nodes: DataFrame, k: int = RETRIEVAL.k) -> DataFrame:
    """query_id, node, score, rank from strategies (query_id, node, strategy, score): weighted sum, floor, abstraction factor."""
    weighted = strategies.withColumn("part", F.col("score") * choice(F.col("strategy"), GRAPH.strategy_weights, 0.5))
    best = weighted.groupBy("query_id", "node", "strategy").agg(F.max("part").alias("part"))
    total = best.groupBy("query_id", "node").agg(F.sum("part").alias("score"), F.max_by("strategy", F.struct("part", "strategy")).alias("strongest")).where(F.col("score") >= RETRIEVAL.graph_floor)
    kind = nodes.select(F.col("id").alias("node"), "type")
    return ranked(total.join(kind, "node").withColumn("score", F.col("score") * abstraction_factor(F.col("type"))), k, entry="node")


def vector_graph(graph: DataFrame, vector: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, node, score, sources from two hit tables (query_id, node, score)."""
    g, v = graph.withColumnRenamed("score", "g"), vector.withColumnRenamed("score", "v")
    share = RETRIEVAL.vector_share
    both = g.join(v, ["query_id", "node"], "full_outer")
    score = F.when(F.col("g").isNotNull() & F.col("v").isNotNull(), (1 - share) * F.col("g") + share * F.col("v")).otherwise(F.coalesce("g", "v"))
    sources = F.concat_ws("+", F.when(F.col("g").isNotNull(), "graph"), F.when(F.col("v").isNotNull(), "vector"))
    return ranked(both.select("query_id", "node", score.alias("score"), sources.alias("sources")), k, entry="node")


def related(edges: DataFrame, relations, way: str) -> DataFrame:
    """node, other of the given relations and direction."""
    return steps(edges, relations, way).select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct()


def advice(edges: DataFrame) -> DataFrame:
    """node, other, role: children, parents, peers, prerequisites and consequences of every node."""
    kinds = {
        "child": (("PARENTOF",), "out"),
        "parent": (("CHILDOF",), "out"),
        "peer": (GRAPH.peer, "both"),
        "prerequisite": (("CANFOLLOW", "REQUIRES"), "out"),
        "consequence": (("CANPRECEDE", "REQUIREDBY"), "out"),
    }
    return reduce(DataFrame.union, [related(edges, r, w).withColumn("role", F.lit(k)) for k, (r, w) in kinds.items()])


def ranked_advice(edges: DataFrame, seeds: DataFrame, texts: DataFrame, plain: float = 0.5) -> DataFrame:
    """seed, node, other, role, relevance, rank within the role: the advice for each seed's nodes, most relevant first.

    seeds: seed, node, description; texts: id, text. Relevance is the TF-IDF
    cosine of the other's text to the seed's description (0 below the floor),
    or ``plain`` without a description, and always for parents.
    """
    rows = seeds.join(advice(edges), "node")
    described = seeds.where(F.trim(F.coalesce("description", F.lit(""))) != "").select(F.col("seed").alias("query_id"), "description").distinct()
    pairs = rows.where("role <> 'parent'").select(F.col("seed").alias("query_id"), F.col("other").alias("doc_id")).distinct().join(texts.select(F.col("id").alias("doc_id"), "text"), "doc_id")
    pairs = pairs.join(described.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "text")
    own = described.select("query_id", F.lit(None).cast(pairs.schema["doc_id"].dataType).alias("doc_id"), F.col("description").alias("text"))
    found = tfidf_relevance(pairs.union(own)).select(F.col("query_id").alias("seed"), F.col("doc_id").alias("other"), "relevance")
    rows = rows.join(found, ["seed", "other"], "left")
    without = (F.col("role") == "parent") | (F.trim(F.coalesce("description", F.lit(""))) == "")
    rows = rows.withColumn("relevance", F.when(without, F.lit(plain)).otherwise(F.round(F.coalesce("relevance", F.lit(0.0)), 6)))
    order = Window.partitionBy("seed", "node", "role").orderBy(F.desc("relevance"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).select("seed", "node", "other", "role", "relevance", "rank")


def chain_positions(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """seed, node, level, position of a sequence chain; ties go to the smaller relation."""
    moves = steps(edges, GRAPH.sequence)
    names = {"CANPRECEDE": "EFFECT", "CANFOLLOW": "PREREQUISITE", "REQUIRES": "DEPENDENCY", "REQUIREDBY": "REQUIRED_BY"}
    found = bfs(moves, seeds, depth, keep_seeds=True)
    before = found.select("seed", F.col("node").alias("src"), (F.col("level") + 1).alias("level"))
    via = before.join(moves, "src").groupBy("seed", F.col("dst").alias("node"), "level").agg(F.min("rel_type").alias("rel_type"))
    position = reduce(lambda c, kv: c.when(F.col("rel_type") == kv[0], kv[1]), names.items(), F.when(F.col("level") == 0, "ROOT"))
    return found.join(via, ["seed", "node", "level"], "left").select("seed", "node", "level", position.alias("position"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, relations=None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed, node, level) and edges of the subgraph around each seed."""
    found = bfs(steps(edges, relations, "both"), seeds, depth, keep_seeds=True).select("seed", "node", "level")
    inside = edges if relations is None else edges.where(F.col("rel_type").isin(*relations))
    rows = inside.join(found.select("seed", F.col("node").alias("src")), "src").join(found.select("seed", F.col("node").alias("dst")), ["seed", "dst"]).select("seed", "src", "dst", "rel_type").distinct()
    return found, rows


# How the classes of a diagram's nodes are drawn
DIAGRAM_CLASSES = {"primary": "fill:#f96,stroke:#333,stroke-width:2px", "secondary": "fill:#69f,stroke:#333", "tertiary": "fill:#9e9,stroke:#333"}


def mermaid(nodes: DataFrame, edges: DataFrame, by: str = "seed") -> DataFrame:
    """A flow chart in text for each group of nodes (by, id, name, and class where nodes have classes) and edges (by, src, dst, rel_type).

    Hyphens of ids, which charts can't hold, go; a node or edge that repeats
    stands once; classes (``DIAGRAM_CLASSES``) are defined at the end.
    """
    from weavegrid.functions.text import shortened

    plain = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    box = F.concat(F.lit("    "), plain("id"), F.lit('["'), F.regexp_replace(shortened(F.col("name"), 25, 22), '"', "'"), F.lit('"]'))
    arrow = F.concat(F.lit("    "), plain("src"), F.lit(" -->|"), F.lower("rel_type"), F.lit("| "), plain("dst"))
    lines = nodes.select(by, F.lit(0).alias("part"), box.alias("line")).union(edges.select(by, F.lit(1), arrow))
    styled = "class" in nodes.columns
    if styled:
        lines = lines.union(nodes.where("class is not null").select(by, F.lit(2), F.concat(F.lit("    class "), plain("id"), F.lit(" "), "class")))
    rows = lines.distinct().groupBy(by).agg(F.sort_array(F.collect_list(F.struct("part", "line"))).alias("l"))
    drawn = [F.lit(f"    classDef {c} {style}") for c, style in DIAGRAM_CLASSES.items()] if styled else []
    return rows.select(by, F.concat_ws("\n", F.lit("graph TD"), F.transform("l", lambda x: x["line"]), *drawn).alias("diagram"))


def betweenness(edges: DataFrame, most_edges: int = 2_000_000, sources_at_once: int = 1000) -> DataFrame:
    """node, betweenness: directed and normalised.

    Trees that hang on the rest by edges of both directions are counted by their
    sizes (every path into or out of one passes its root), so a forest takes a
    few joins a level. Of what is left, every node is a source of Brandes'
    accumulation and counts as often as its tree has nodes. Up to
    ``most_edges`` of these edges (counted here) are sent to every task, and
    sources are dealt over them. More are joined level by level, about
    ``sources_at_once`` sources a round; the results are the same but for
    rounding. That part visits all that each source reaches, so its work grows
    with the square of a connected graph without such trees.
    """
    pairs = kept(edges.select("src", "dst").where("src <> dst").distinct())
    everyone = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    n = everyone.count()
    scale = (n - 1) * (n - 2) or 1
    inner, core, trees = _without_trees(pairs, everyone)
    n_edges = inner.count()
    if n_edges:
        named = inner.select(F.col("src").alias("node")).union(inner.select("dst")).distinct().join(core.select("node", "w"), "node")
        rounds = -(-named.count() // sources_at_once) if n_edges > most_edges else 0
        sums = _shares_by_joins(inner, named, rounds) if rounds else _shares_by_task(inner, named)
        core = core.join(sums.groupBy("node").agg(F.sum("part").alias("part"), F.sum("met").alias("met")), "node", "left")
    else:
        core = core.withColumns({"part": F.lit(0.0), "met": F.lit(0.0)})
    # whole: nodes of the outermost tree; met: nodes beyond it that its root reaches, and those that reach it
    above = core.select("node", "w", "squares", F.col("w").alias("whole"), F.coalesce("met", F.lit(0.0)).alias("met"), F.coalesce("part", F.lit(0.0)).alias("part"))
    done = [above]
    for tree in reversed(trees):
        over = reduce(DataFrame.union, done).select(F.col("node").alias("parent"), "whole", "met")
        done.append(kept(tree.join(over, "parent").select("node", "w", "squares", "whole", "met", F.lit(0.0).alias("part"))))
    below = F.col("w") - 1  # nodes that hang on the node: paths between them and the rest, and between its branches
    through = F.col("part") + below * (2 * (F.col("whole") - F.col("w")) + F.col("met")) + below * below - F.col("squares")
    return reduce(DataFrame.union, done).select("node", (through / scale).alias("betweenness"))


def _without_trees(pairs: DataFrame, everyone: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What is left of ``pairs`` (src, dst); the nodes left with w (nodes of their tree, themselves included) and squares (the sum of their branches' w * w);
    and for each round the nodes that went: node, parent, w, squares.

    A round takes the nodes with one neighbour and edges from and to it. It is the last where it takes less than a quarter of the nodes
    that have edges: what long paths leave goes to the accumulation, which is as exact.
    """
    both = pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(pairs.select("dst", "src", F.lit(0)))
    links = kept(both.groupBy("node", "other").agg(F.sum("out").alias("out"), (F.count("*") == 2).alias("mutual")))
    weights = kept(everyone.select("node", F.lit(1.0).alias("w"), F.lit(0.0).alias("squares")))
    trees = []
    while True:
        near = links.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("parent"), F.min("mutual").alias("mutual"))
        n_linked, n_single = near.agg(F.count("*"), F.count_if(F.expr("n = 1 and mutual"))).first()
        if not n_single:
            break
        single = near.where("n = 1 and mutual").select("node", "parent")
        # of two nodes that have only each other, the smaller stays
        pair = single.select(F.col("parent").alias("node"), F.col("node").alias("parent"))
        gone = single.join(pair.where("node < parent"), ["node", "parent"], "left_anti")
        tree = kept(gone.join(weights, "node").select("node", "parent", "w", "squares"))
        trees.append(tree)
        grown = tree.groupBy(F.col("parent").alias("node")).agg(F.sum("w").alias("more"), F.sum(F.col("w") * F.col("w")).alias("branches"))
        left = weights.join(tree, "node", "left_anti").join(grown, "node", "left")
        left = left.select("node", (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"), (F.col("squares") + F.coalesce("branches", F.lit(0.0))).alias("squares"))
        spent = weights, links
        weights = kept(left)
        links = kept(links.join(tree, "node", "left_anti").join(tree.select(F.col("node").alias("other")), "other", "left_anti").select("node", "other", "out", "mutual"))
        dropped(*spent)
        if n_single * 4 < n_linked:
            break
    return links.where("out > 0").select(F.col("node").alias("src"), F.col("other").alias("dst")), weights, trees


def _shares_by_joins(pairs: DataFrame, everyone: DataFrame, rounds: int) -> DataFrame:
    """node, part, met: Brandes' accumulation with a table (source, node, paths) for each level of a round's sources; a round's sums join the stored total, and its tables go.

    everyone: node, w (as how many nodes it counts); met: nodes that it reaches, and nodes that reach it.
    """
    everyone = kept(everyone.select("node", "w"))
    pairs = kept(pairs.select(F.col("src").alias("node"), F.col("dst").alias("next")).join(everyone.select(F.col("node").alias("next"), F.col("w").alias("next_w")), "next").select("node", "next", "next_w"))
    total = None
    for i in range(rounds):
        starts = everyone.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == i)
        levels = [kept(starts.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths"), "w", F.col("w").alias("source_w")))]
        seen = levels[0].select("source", "node")
        while True:
            reached = levels[-1].select("source", "node", "paths", "source_w").join(pairs, "node").groupBy("source", F.col("next").alias("node"))
            reached = reached.agg(F.sum("paths").alias("paths"), F.max("next_w").alias("w"), F.max("source_w").alias("source_w"))
            level = kept(reached.join(seen, ["source", "node"], "left_anti"))
            if not level.limit(1).count():
                dropped(level)
                break
            levels.append(level)
            seen = seen.union(level.select("source", "node"))
        shares = levels[-1].withColumn("share", F.lit(0.0))
        done = [shares] if len(levels) > 1 else []
        spent = list(levels)
        for level in reversed(levels[1:-1]):
            after = shares.select("source", F.col("node").alias("next"), ((F.col("w") + F.col("share")) / F.col("paths")).alias("each"))
            owed = level.join(pairs, "node").join(after, ["source", "next"]).groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("each")).alias("share"))
            shares = kept(level.join(owed, ["source", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0))))
            done.append(shares)
            spent.append(shares)
        parts = [d.select("node", (F.col("source_w") * F.col("share")).alias("part"), F.col("source_w").alias("met")) for d in done]
        parts += [d.select(F.col("source").alias("node"), F.lit(0.0).alias("part"), F.col("w").alias("met")) for d in done] + ([] if total is None else [total])
        if parts:
            before, total = total, kept(reduce(DataFrame.union, parts).groupBy("node").agg(F.sum("part").alias("part"), F.sum("met").alias("met")))
            dropped(*([before] if before is not None else []))
        dropped(*spent)
    found = total if total is not None else kept(everyone.select("node", F.lit(0.0).alias("part"), F.lit(0.0).alias("met")))
    dropped(pairs, everyone)
    return found


def _shares_by_task(pairs: DataFrame, everyone: DataFrame) -> DataFrame:
    """node, part, met as by joins: Brandes' accumulation for sources dealt over tasks that hold the edge list."""
    spark = pairs.sparkSession
    links = [(r["src"], r["dst"]) for r in pairs.collect()]
    counts = {r["node"]: r["w"] for r in everyone.collect()}
    names = sorted(counts)
    number = {x: i for i, x in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for a, b in links:
        out[number[a]].append(number[b])
    held = spark.sparkContext.broadcast((names, out, [counts[x] for x in names]))

    def accumulate(batches):
        import numpy as np
        import pandas as pd

        names, out, w_of = held.value
        total, met = np.zeros(len(names)), np.zeros(len(names))
        for batch in batches:
            for s in batch["i"]:
                order, before, paths, far = [], [[] for _ in names], [0] * len(names), {int(s): 0}
                paths[s] = 1
                queue = [int(s)]
                for v in queue:
                    order.append(v)
                    for w in out[v]:
                        if w not in far:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = [0.0] * len(names)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (w_of[w] + share[w])
                    if w != s:
                        total[w] += w_of[s] * share[w]
                        met[w] += w_of[s]
                        met[s] += w_of[w]
        at = np.flatnonzero(total + met)
        if at.size:
            yield pd.DataFrame({"node": [names[i] for i in at], "part": total[at], "met": met[at]})

    n = len(names)
    sources = spark.range(n).select(F.col("id").cast("int").alias("i")).repartition(max(1, min(n, spark.sparkContext.defaultParallelism)))
    return sources.mapInPandas(accumulate, "node string, part double, met double")


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each combination of keys: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
