"""Graph operators over edges(child, parent, rel), a directed acyclic graph with several parents per node."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from enrichspark.functions.skew import split_join
from enrichspark.session import ROWS_PER_TASK, materialize, shared_dir, wide

PROPAGATION = ("is_a", "part_of")
#: Levels that a closure goes through one by one; deeper graphs are closed by doubling.
LEVELS = 32
#: With no more edges than these a closure is small, and fewer rounds are worth more than fewer rows.
FEW_EDGES = 1 << 16


def closure(edges: DataFrame, relations: tuple[str, ...] = PROPAGATION, max_depth: int | None = None,
            nodes: DataFrame | None = None, hops: int = 4, levels: int | None = None) -> DataFrame:
    """(src, anc, depth): every ancestor with its shortest distance, the node itself at depth 0.

    Up to hops edges are single steps in one plan; anything deeper is reach, one row per pair. A node that is only ever a parent is
    its own single ancestor.
    """
    if max_depth is None or max_depth > hops:
        return unpack(reach(edges, relations, max_depth, nodes, hops, levels))
    e = edges.filter(F.col("rel").isin(*relations)).select("child", "parent").distinct()
    start = _ends(e) if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    step = start.select(F.col("node").alias("src"), F.col("node").alias("anc"), F.lit(0).alias("depth"))
    found = [step]
    for i in range(max_depth):
        step = (step.join(e, step["anc"] == e["child"]).select("src", F.col("parent").alias("anc")).distinct()
                .withColumn("depth", F.lit(i + 1)))
        found.append(step)
    return reduce(DataFrame.unionByName, found).groupBy("src", "anc").agg(F.min("depth").alias("depth"))


def reach(edges: DataFrame, relations: tuple[str, ...] = PROPAGATION, max_depth: int | None = None,
          nodes: DataFrame | None = None, hops: int = 4, levels: int | None = None) -> DataFrame:
    """(src, anc, depth): the closure with one row per node, its ancestors and their distances in two arrays.

    Nodes take the ancestors of their parents level by level, from the roots down, so that a pair moves once per edge. Where that would
    be too many rounds, in a graph with more levels than given (LEVELS, and none up to FEW_EDGES), it is closed by doubling.
    """
    e = materialize(edges.filter(F.col("rel").isin(*relations)).select("child", "parent").distinct(), "edges")
    asked = None if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    # every node on a path needs its own reach, whichever nodes are asked
    start = _ends(e) if asked is None else _ends(e).union(asked).distinct()
    roots = start.join(e.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    climbed = _climb(e, roots, max_depth, levels, nodes=start)
    if climbed is None:
        climbed = pack(_double(e, start, max_depth, hops))
    return climbed if asked is None else climbed.join(asked, F.col("src") == F.col("node"), "left_semi")


def pack(closed: DataFrame) -> DataFrame:
    """A closure's pairs as one row per node, smallest ancestor first."""
    pairs = closed.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("anc", "depth"))).alias("_pairs"))
    return pairs.select("src", F.col("_pairs.anc").alias("anc"), F.col("_pairs.depth").alias("depth"))


def unpack(packed: DataFrame) -> DataFrame:
    """The pairs (src, anc, depth) of a packed closure."""
    pairs = packed.select("src", F.explode(F.arrays_zip("anc", "depth")).alias("_pair"))
    return pairs.select("src", F.col("_pair.anc").alias("anc"), F.col("_pair.depth").alias("depth"))


def _ends(e: DataFrame) -> DataFrame:
    return e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()


def _levels(e: DataFrame, start: DataFrame, n_edges: int, most: int) -> DataFrame | None:
    """(node, level): the most edges on a way from one of start down to each node below it; None beyond so many levels."""
    step, found = start, []
    for level in range(most + 1):
        step = materialize(step, "level")
        if step.isEmpty():
            if not found:
                return None
            return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("level").alias("level"))
        found.append(step.withColumn("level", F.lit(level)))
        below = step.join(e, step["node"] == e["parent"]).select(F.col("child").alias("node"))
        step = wide(below, n_edges, "node").distinct()
    return None


def _climb(e: DataFrame, start: DataFrame, max_depth: int | None, most: int | None, held: DataFrame | None = None,
           nodes: DataFrame | None = None) -> DataFrame | None:
    """Packed closure of the nodes start and all below them, level by level, together with the rows of held that are of other nodes.

    Each level is written out with the last level that reads it, so that a node's row is read only while children wait for it. None if
    there are too many levels, or if not all of nodes hang on start.
    """
    spark, n_edges = e.sparkSession, e.count()
    if most is None:
        most = LEVELS if n_edges > FEW_EDGES else 0
    level = _levels(e, start, n_edges, most) if most else None
    if level is None:
        return None
    level = materialize(level, "levels")
    if nodes is not None and level.count() != nodes.count():
        return None
    up = materialize(wide(e, n_edges, "child").join(wide(level.withColumnRenamed("node", "child"), n_edges, "child"), "child"), "up")
    last = up.groupBy(F.col("parent").alias("node")).agg(F.max("level").alias("last"))
    marked = materialize(level.join(last, "node", "full"), "marked")
    todo = marked.filter(F.col("level").isNotNull())
    n_up = {r["level"]: r["n"] for r in up.groupBy("level").agg(F.count("*").alias("n")).collect()}
    n_todo = {r["level"]: r["n"] for r in todo.groupBy("level").agg(F.count("*").alias("n")).collect()}
    folder, paths, length = f"{shared_dir(spark)}/climb-{uuid.uuid4().hex}", [], 1
    if held is not None:
        held = held.join(marked.withColumnRenamed("node", "src"), "src", "left").filter(F.col("level").isNull())
        held = materialize(held.select("src", "anc", "depth", "last"), "held")
        length = held.agg(F.avg(F.size("anc"))).first()[0] or 1
    for at in sorted(n_todo):
        rows = todo.filter(F.col("level") == at).select(
            F.col("node").alias("src"), F.array("node").alias("anc"), F.array(F.lit(0)).alias("depth"), "last")
        above = [held] if held is not None else []
        if paths:
            above.append(spark.read.schema(schema).parquet(*paths))
        n_rows = int(length + 2) * n_up.get(at, 0) + n_todo[at]  # about the pairs that move
        if above and at in n_up:
            parents = reduce(DataFrame.unionByName, above).filter(F.col("last") >= at)
            taken = (wide(up.filter(F.col("level") == at).select("child", "parent"), n_rows, "parent")
                     .join(wide(parents, n_rows, "src"), F.col("parent") == F.col("src"))
                     .select(F.col("child").alias("src"), "anc", F.transform("depth", lambda d: d + 1).alias("depth"),
                             F.lit(None).cast("int").alias("last")))
            rows = rows.unionByName(taken)
        dealt = wide(rows, n_rows, "src")
        dealt = rows.repartition("src") if dealt is rows else dealt
        pairs = (dealt.select("src", "last", F.explode(F.arrays_zip("anc", "depth")).alias("_pair"))
                 .groupBy("src", F.col("_pair.anc").alias("anc")).agg(F.min("_pair.depth").alias("depth"), F.max("last").alias("last")))
        if max_depth is not None:
            pairs = pairs.filter(F.col("depth") <= max_depth)
        done = (pairs.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("anc", "depth"))).alias("_pairs"), F.max("last").alias("last"))
                .select("src", F.col("_pairs.anc").alias("anc"), F.col("_pairs.depth").alias("depth"), "last"))
        schema = done.schema
        paths.append(f"{folder}/{at}")
        done.write.parquet(paths[-1])
        if n_rows > ROWS_PER_TASK:
            length = max(length, spark.read.schema(schema).parquet(paths[-1]).agg(F.avg(F.size("anc"))).first()[0])
        else:
            length += 2
    climbed = spark.read.schema(schema).parquet(*paths)
    return (climbed if held is None else climbed.unionByName(held)).drop("last")


def _double(e: DataFrame, start: DataFrame, max_depth: int | None, hops: int) -> DataFrame:
    """The closure's pairs in rounds that follow the logarithm of the depth.

    The first hops are single steps in one plan. Then the reach doubles with each round: a pair further apart than L, but
    not than 2 L, has a node at distance L on its shortest path, so pairs at exactly L meet those up to L and nothing else is
    joined again. Only the reach of nodes that end such a pair is looked up, which are few beyond the first hops. Each round is
    written out, so the plan stays short and a lost executor costs one round, and is dealt over tasks by its rows.
    """
    n_edges = e.count()
    step = start.select(F.col("node").alias("src"), F.col("node").alias("anc"), F.lit(0).alias("depth"))
    found = [step]
    for i in range(hops):
        step = step.join(e, step["anc"] == e["child"]).select("src", F.col("parent").alias("anc"))
        step = wide(step, n_edges * (i + 2), "src").distinct().withColumn("depth", F.lit(i + 1))
        found.append(step)
    near = reduce(DataFrame.unionByName, found)
    near = wide(near, n_edges * 2 * hops, "src").groupBy("src", "anc").agg(F.min("depth").alias("depth"))
    reached, depth = materialize(near, "closure"), hops
    while max_depth is None or depth < max_depth:
        frontier = reached.filter(F.col("depth") == depth)
        if frontier.isEmpty():
            break
        further = depth if max_depth is None else min(depth, max_depth - depth)
        ends = frontier.select(F.col("anc").alias("src")).distinct()
        onward = (reached.filter(F.col("depth").between(1, further)).join(ends, "src", "left_semi")
                  .select(F.col("src").alias("_mid"), F.col("anc").alias("_to"), F.col("depth").alias("_more")))
        onward = materialize(onward, "onward")
        rows = 4 * reached.count()
        far = (frontier.join(onward, F.col("anc") == F.col("_mid")).groupBy("src", F.col("_to").alias("anc"))
               .agg(F.min("_more").alias("_more")))
        far = (wide(far, rows, "src", "anc").groupBy("src", "anc")
               .agg((depth + F.min("_more")).alias("depth")))
        new = far.join(wide(reached.select("src", "anc"), rows, "src", "anc"), ["src", "anc"], "left_anti")
        reached = reached.unionByName(materialize(new, "closure"))
        depth += further
    return reached


def extend_closure(closed: DataFrame, edges: DataFrame, relations: tuple[str, ...] = PROPAGATION,
                   max_depth: int | None = None, levels: int | None = None) -> DataFrame:
    """closed(src, anc, depth) after edges have been added to its graph, as pairs; see extend_reach."""
    packed = materialize(pack(closed.select("src", "anc", "depth")), "packed")
    return unpack(extend_reach(packed, edges, relations, max_depth, levels))


def extend_reach(packed: DataFrame, edges: DataFrame, relations: tuple[str, ...] = PROPAGATION,
                 max_depth: int | None = None, levels: int | None = None) -> DataFrame:
    """A packed closure after edges have been added to its graph, without computing it anew.

    packed holds all its nodes as sources; with max_depth it is a closure limited to that depth, and so is the result.
    Only the children of added edges and the nodes below them change. They take their parents' ancestors level by level; all other
    nodes keep their rows. With more levels than given the new paths are put together by doubling. The graph must stay free of cycles;
    nodes that only the added edges name become their own ancestors.
    """
    e = materialize(edges.filter(F.col("rel").isin(*relations)).select("child", "parent").distinct(), "added")
    fresh = _ends(e).join(packed.select(F.col("src").alias("node")), "node", "left_anti")
    old = packed.unionByName(fresh.select(F.col("node").alias("src"), F.array("node").alias("anc"), F.array(F.lit(0)).alias("depth")))
    before = unpack(packed).filter(F.col("depth") == 1).select(F.col("src").alias("child"), F.col("anc").alias("parent"))
    every = materialize(before.unionByName(e).distinct(), "edges")
    start = e.select(F.col("child").alias("node")).distinct()
    if start.isEmpty():
        return old
    climbed = _climb(every, start, max_depth, levels, old)
    return pack(_chain(unpack(old), e, max_depth)) if climbed is None else climbed


def _chain(old: DataFrame, e: DataFrame, max_depth: int | None) -> DataFrame:
    """The pairs of old with the edges e added.

    Chains of added edges, with old paths between them, are joined end to end, twice as many edges a round, and only those
    that beat the old distance of their ends go on. What they shorten is met once with the old paths before and after.
    """
    def better(paths: DataFrame) -> DataFrame:
        """The shortest of paths(src, anc, depth) between two nodes, where it is shorter than the old distance."""
        if max_depth is not None:
            paths = paths.filter(F.col("depth") <= max_depth)
        paths = paths.groupBy("src", "anc").agg(F.min("depth").cast(old.schema["depth"].dataType).alias("depth"))
        before = old.select("src", "anc", F.col("depth").alias("_old"))
        return (paths.join(before, ["src", "anc"], "left").filter(F.col("_old").isNull() | (F.col("depth") < F.col("_old")))
                .select("src", "anc", "depth"))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("src").alias("_mid"), F.col("anc").alias("_to"), F.col("depth").alias("_more"))
        return a.join(b, F.col("anc") == F.col("_mid")).select("src", F.col("_to").alias("anc"), (F.col("depth") + F.col("_more")).alias("depth"))

    between = materialize(old.join(e.select(F.col("parent").alias("src")).distinct(), "src", "left_semi")
                          .join(e.select(F.col("child").alias("anc")).distinct(), "anc", "left_semi"), "between")
    chains = materialize(better(e.select(F.col("child").alias("src"), F.col("parent").alias("anc"), F.lit(1).alias("depth"))), "chains")
    size = lambda c: tuple(c.agg(F.count("*"), F.sum("depth")).first())
    had = size(chains)
    while had[0]:
        chains = materialize(better(chains.unionByName(then(then(chains, between), chains))), "chains")
        now = size(chains)
        if now == had:
            break
        had = now
    entered = better(then(old, chains))
    changed = materialize(better(then(entered, old)), "changed")
    return old.join(changed.select("src", "anc"), ["src", "anc"], "left_anti").unionByName(changed)


def propagate(terms: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """True-path rule: each key's terms together with all their ancestors."""
    return (split_join(terms, closed.withColumnRenamed("src", "term").select("term", "anc"), ["term"], "term")
            .select(*keys, F.col("anc").alias("term")).distinct())


def inherit_processes(closed: DataFrame, capable: DataFrame) -> DataFrame:
    """(src, process, depth): processes of a node and of its ancestors, the nearest source kept.

    closed is a depth-limited is_a closure, capable is (node, process).
    """
    return (closed.join(capable, closed["anc"] == capable["node"])
            .groupBy("src", "process").agg(F.min("depth").alias("depth")))


def resolve_alternative(ids: DataFrame, terms: DataFrame, alt: DataFrame) -> DataFrame:
    """Primary id for each id, following alternative ids; null if unknown."""
    known = terms.select(F.col("id").alias("_known")).distinct()
    merged = alt.select(F.col("alt_id").alias("_alt"), F.col("id").alias("_primary"))
    return (ids.join(known, ids["id"] == F.col("_known"), "left")
            .join(merged, ids["id"] == F.col("_alt"), "left")
            .select(ids["id"], F.coalesce("_known", "_primary").alias("primary_id")))


def resolve_terms(ids: DataFrame, terms: DataFrame) -> DataFrame:
    """Label, definition and status of each id; unknown ids are NOT_FOUND. Resolved needs OK and a label."""
    joined = ids.join(terms, "id", "left")
    status = F.coalesce("status", F.lit("NOT_FOUND"))
    return joined.select("id", "label", "definition", status.alias("status"),
                         ((status == "OK") & F.col("label").isNotNull()).alias("resolved"))


def item_features(items: DataFrame, terms: DataFrame, cl_closed: DataFrame, tissue_closed: DataFrame | None,
                  processes: DataFrame | None = None) -> DataFrame:
    """(item, kind, term, label) of items(item, ct, tissue).

    lineage is the cell type and its ancestors, process the inherited processes, tissue the tissue and its
    ancestors; the closures given set the depths. Only resolved terms, OK with a label, are kept.
    """
    parts = [items.join(cl_closed, F.col("ct") == F.col("src"))
             .select("item", F.lit("lineage").alias("kind"), F.col("anc").cast("string").alias("term"))]
    if processes is not None:
        parts.append(items.join(processes, F.col("ct") == F.col("src"))
                     .select("item", F.lit("process").alias("kind"), F.col("process").cast("string").alias("term")))
    if tissue_closed is not None:
        parts.append(items.join(tissue_closed, F.col("tissue") == F.col("src"))
                     .select("item", F.lit("tissue").alias("kind"), F.col("anc").cast("string").alias("term")))
    resolved = terms.filter((F.col("status") == "OK") & F.col("label").isNotNull()).select("kind", "id", "label")
    return (reduce(DataFrame.unionByName, parts).distinct()
            .join(resolved.withColumnRenamed("id", "term"), ["kind", "term"])
            .select("item", "kind", "term", "label"))


def extract_subgraph(requested: DataFrame, terms: DataFrame, closed: DataFrame) -> DataFrame:
    """Requested ids and their ancestors within the closure's depth, with status and whether requested."""
    reach = requested.join(closed, requested["id"] == closed["src"], "left").select(
        requested["id"].alias("asked"), F.coalesce("anc", requested["id"]).alias("id"))
    found = reach.groupBy("id").agg(F.max(F.col("id") == F.col("asked")).alias("requested"))
    return (found.join(terms, "id", "left")
            .select("id", "label", F.coalesce("status", F.lit("NOT_FOUND")).alias("status"), "requested"))


def related_pairs(vocabulary: DataFrame, closed: DataFrame) -> DataFrame:
    """(term_a, term_b) with term_a < term_b of which one is an ancestor of the other."""
    v = vocabulary.select("term")
    return (closed.filter("depth > 0")
            .join(v.withColumnRenamed("term", "src"), "src").join(v.withColumnRenamed("term", "anc"), "anc")
            .select(F.least("src", "anc").alias("term_a"), F.greatest("src", "anc").alias("term_b")).distinct())


def resnik(a: DataFrame, b: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(key, resnik): largest IC among the ancestors shared by two term sets a(key, term) and b(key, term); 0 if none."""
    shared = (propagate(a, closed, ["key"]).join(propagate(b, closed, ["key"]), ["key", "term"]).join(ic, "term")
              .groupBy("key").agg(F.max("ic").alias("resnik")))
    keys = a.select("key").union(b.select("key")).distinct()
    return keys.join(shared, "key", "left").withColumn("resnik", F.coalesce("resnik", F.lit(0.0)))


def coverage_curve(items: DataFrame, closed: DataFrame, capable: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Per inheritance depth: share of cell types and of rows with a process, distinct processes,
    upper median of processes per annotated cell type and the most common process.

    items is (item, ct); closed must reach the largest depth. All depths come from one closure.
    """
    curve = F.array(*[F.lit(d) for d in depths])
    inherited = inherit_processes(closed, capable).withColumn("at", F.explode(curve)).filter("depth <= at")
    types = items.groupBy(F.col("ct").alias("src")).agg(F.count("*").alias("rows"))
    held = inherited.join(types, "src")
    per_type = held.groupBy("at", "src").agg(F.count("*").alias("n"), F.max("rows").alias("rows"))
    n_types, n_rows = types.agg(F.count("*")).scalar(), types.agg(F.sum("rows")).scalar()
    per_process = held.groupBy("at", "process").agg(F.count("*").alias("n"))
    top = per_process.groupBy("at").agg(
        F.count("*").alias("n_unique_terms"),
        F.min_by("process", F.struct((-F.col("n")).alias("o"), "process")).alias("most_common_term"),
        F.max("n").alias("most_common_n"))
    # the median from one row per depth and distinct number of terms, so that no list of cell types is gathered
    spread_ = per_type.groupBy("at", "n").agg(F.count("*").alias("c"), F.sum("rows").alias("r"))
    by_depth = Window.partitionBy("at")
    below = F.sum("c").over(by_depth.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = spread_.withColumns({"below": below, "all": F.sum("c").over(by_depth)})
    middle = F.when(F.col("below") >= F.floor(F.col("all") / 2) + 1, F.col("n"))
    return (ranked.groupBy("at").agg(
        F.sum("c").alias("covered"), F.sum("r").alias("covered_rows"), F.min(middle).alias("median"))
        .join(top, "at")
        .select(F.col("at").alias("depth"), (F.col("covered") / n_types).alias("frac_cell_types"),
                (F.col("covered_rows") / n_rows).alias("frac_rows"), "n_unique_terms",
                F.col("median").alias("median_per_annotated"),
                "most_common_term", "most_common_n"))


def describe_terms_per_item(items: DataFrame, carriers: DataFrame) -> DataFrame:
    """One row of statistics over the number of terms per item; items without terms count as 0."""
    per_item = carriers.groupBy("item").agg(F.count_distinct("term").alias("n"))
    all_items = items.select("item").distinct().join(per_item, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    single = (carriers.groupBy("term").agg(F.count_distinct("item").alias("c"))
              .agg(F.count_if(F.col("c") == 1)).scalar())
    held = F.when(F.col("n") > 0, F.col("n"))
    return all_items.agg(
        F.count("*").alias("n_items"), F.count(held).alias("n_annotated"),
        F.avg("n").alias("mean_all"), F.avg(held).alias("mean_annotated"),
        F.percentile(held, F.lit(0.5)).alias("median_annotated"),
        F.min("n").alias("min_all"), F.min(held).alias("min_annotated"), F.max("n").alias("max_all"),
        F.min_by("item", F.struct((-F.col("n")).alias("o"), "item")).alias("most_annotated"),
        F.min_by("item", F.struct(held.isNull().alias("u"), held.alias("n"), "item")).alias("least_annotated"),
    ).withColumn("n_single_carrier_terms", single)
