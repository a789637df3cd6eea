"""Model tables over the driver's tables, the inputs of every registered query.

supplier = gene, 26 + nation = cell type, market segment = tissue, part size = term, return flag = evidence
code (R is the excluded one). Terms form a graph in which k has parents k div 2 (is_a) and k div 3
(part_of). Part keys form a second graph by the same rule, which grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from enrichspark.operators import dag, enrichment, evidence, matrix, scoring, simulate
from enrichspark.operators.vocabulary import candidate_vocabulary
from enrichspark.session import materialize, wide

ROOT = 1


def halving_edges(nodes: DataFrame, node: str) -> DataFrame:
    """Edges k -> k div 2 (is_a) and k -> k div 3 (part_of) over the distinct values of a column."""
    k = nodes.select(F.col(node).alias("child")).distinct()
    kind = nodes.schema[node].dataType.simpleString()

    def up(by, rel):
        return k.filter(F.col("child") >= by).select(
            "child", F.floor(F.col("child") / by).cast(kind).alias("parent"), F.lit(rel).alias("rel"))
    return up(2, "is_a").unionByName(up(3, "part_of"))


class Model:
    """Lazy tables of one data folder; shared dimension and observation tables are written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._shared: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- graph of terms and cell types
    @cached_property
    def nodes(self) -> DataFrame:
        sizes = self.table("part").select(F.col("p_size").cast("int").alias("node"))
        nations = self.table("nation").select((F.col("n_nationkey") + 26).cast("int").alias("node"))
        return materialize(sizes.union(nations).distinct(), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return halving_edges(self.nodes, "node")

    @cached_property
    def closed(self) -> DataFrame:
        return materialize(dag.closure(self.edges), "closed")

    @cached_property
    def isa3(self) -> DataFrame:
        return materialize(dag.closure(self.edges, ("is_a",), 3, self.nodes), "isa3")

    @cached_property
    def terms(self) -> DataFrame:
        """(id, label, definition, status); every 17th node is obsolete."""
        return self.nodes.select(
            F.col("node").alias("id"), F.concat(F.lit("term "), "node").alias("label"),
            F.concat(F.lit("Definition of "), "node").alias("definition"),
            F.when(F.col("node") % 17 == 0, "OBSOLETE").otherwise("OK").alias("status"))

    @cached_property
    def capable(self) -> DataFrame:
        """(node, process): nodes up to 24 not of the form 4m + 1 are their own process."""
        return self.nodes.filter("node <= 24 AND node % 4 <> 1").select("node", F.col("node").alias("process"))

    @cached_property
    def carriers(self) -> DataFrame:
        inherited = dag.inherit_processes(self.isa3.filter("src >= 26"), self.capable)
        return materialize(inherited.select(F.col("src").alias("ct"), F.col("process").alias("term")), "carriers")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return candidate_vocabulary(self.carriers, 3)

    # -- graph of parts, which grows with the data
    @cached_property
    def part_edges(self) -> DataFrame:
        return halving_edges(self.table("part"), "p_partkey")

    # -- tissues
    @cached_property
    def tissue_closed(self) -> DataFrame:
        seg = self.table("customer").select(F.col("c_mktsegment").alias("t")).distinct()
        group = F.concat(F.lit("GROUP_"), F.length("t") % 2)
        edges = (seg.select(F.col("t").alias("child"), group.alias("parent"), F.lit("is_a").alias("rel"))
                 .unionByName(seg.select(group.alias("child"), F.lit("ALL").alias("parent"), F.lit("part_of").alias("rel"))
                              .distinct()))
        return materialize(dag.closure(edges, max_depth=3), "tissues")

    @cached_property
    def feature_terms(self) -> DataFrame:
        """(kind, id, label, status) of everything an item can have as a feature."""
        t = self.terms.select(F.col("id").cast("string").alias("id"), "label", "status")
        tissues = self.tissue_closed.select(F.col("src").alias("id")).distinct()
        return (t.withColumn("kind", F.lit("lineage")).unionByName(t.withColumn("kind", F.lit("process")))
                .unionByName(tissues.select("id", F.col("id").alias("label"), F.lit("OK").alias("status"),
                                            F.lit("tissue").alias("kind"))))

    @cached_property
    def items(self) -> DataFrame:
        return self.obs.select("item", "ct", "tissue").distinct()

    @cached_property
    def features(self) -> DataFrame:
        processes = self.carriers.select(F.col("ct").alias("src"), F.col("term").alias("process"))
        return materialize(dag.item_features(self.items, self.feature_terms, self.isa3, self.tissue_closed, processes),
                           "features")

    @cached_property
    def features_v1(self) -> DataFrame:
        """Lineage and exact tissue only."""
        exact = self.tissue_closed.filter("depth = 0")
        return materialize(dag.item_features(self.items, self.feature_terms, self.isa3, exact), "features")

    # -- observations
    def observe(self) -> DataFrame:
        """(gene, item, ct, tissue, value): null below three rows, 1 if the mean discount reaches 0.07."""
        lines = self.table("lineitem")
        li = lines.select("l_orderkey", F.col("l_suppkey").alias("gene"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        cust = self.table("customer").select(F.col("c_custkey").alias("o_custkey"),
                                             (F.col("c_nationkey") + 26).cast("int").alias("ct"),
                                             F.col("c_mktsegment").alias("tissue"))
        n_lines, n_orders = lines.count(), orders.count()
        # customers meet their orders first, so that line items move once for the join and once for the groups
        placed = wide(orders, n_orders, "o_custkey").join(wide(cust, n_orders, "o_custkey"), "o_custkey").drop("o_custkey")
        rows = wide(li, n_lines, "l_orderkey").join(wide(placed, n_lines, "l_orderkey"), "l_orderkey")
        n = F.count("*")
        value = F.when(n < 3, None).when(F.sum("d") >= 7 * n, 1).otherwise(0)
        return (wide(rows, n_lines, "gene", "ct", "tissue").groupBy("gene", "ct", "tissue")
                .agg(value.cast("int").alias("value"))
                .select("gene", F.concat_ws("|", "ct", "tissue").alias("item"), "ct", "tissue", "value"))

    @cached_property
    def obs(self) -> DataFrame:
        return materialize(self.observe(), "obs")

    @cached_property
    def units(self) -> DataFrame:
        return matrix.by_unit(self.obs)

    @cached_property
    def cell_type_units(self) -> DataFrame:
        return self.units.filter("unit = 'cell_types'")

    @cached_property
    def rates(self) -> DataFrame:
        """Rates over annotated called items, the universe of the corrected statistics."""
        called = self.units.join(self.carriers.select("ct").distinct(), "ct", "left_semi")
        return materialize(matrix.gene_rates(called), "rates")  # one row per gene and unit, read by most queries

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence.evidence_counts(self.units, self.carriers, self.vocabulary)

    def min_genes(self) -> int:
        return 50

    @cached_property
    def baselines(self) -> DataFrame:
        return evidence.term_baselines(self.evidence, self.min_genes())

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result table that several reports read: built and written once per session."""
        if name not in self._shared:
            self._shared[name] = materialize(build(), name)
        return self._shared[name]

    @property
    def corrected(self) -> DataFrame:
        return self.shared("corrected", self.correct)

    def correct(self) -> DataFrame:
        return evidence.corrected_stats(self.evidence, self.rates, self.baselines, evidence.grand_means(self.rates),
                                        self.vocabulary)

    @property
    def enriched(self) -> DataFrame:
        return self.shared("enriched", self.enrich)

    def enrich(self) -> DataFrame:
        return enrichment.over_representation(self.units, self.carriers)

    # -- simulated null
    @cached_property
    def grid(self) -> DataFrame:
        return simulate.item_grid(self.units, self.carriers)

    @cached_property
    def null_genes(self) -> DataFrame:
        return materialize(simulate.universes(self.units, self.grid), "universes")

    @cached_property
    def thresholds(self) -> DataFrame:
        return materialize(simulate.null_thresholds(self.null_genes, self.grid, self.carriers), "thresholds")

    @property
    def tested(self) -> DataFrame:
        """The enriched rows with p_gscs and whether they are significant by it."""
        return self.shared("tested", lambda: simulate.apply_thresholds(self.enriched, self.null_genes, self.thresholds))

    # -- annotations
    @cached_property
    def annotations(self) -> DataFrame:
        """(gene, term, evidence) supported by all line items of the three: their mean discount reaches 0.08."""
        li = self.table("lineitem").select("l_partkey", F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("evidence"),
                                           F.round(F.col("l_discount") * 100).cast("long").alias("d"))
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("int").alias("term"))
        return (li.join(part, "l_partkey").groupBy("gene", "term", "evidence").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
                .filter("d >= 8 * n").select("gene", "term", "evidence"))

    @cached_property
    def truths(self) -> DataFrame:
        return materialize(self.annotations.filter("evidence <> 'R'").select("gene", "term").distinct(), "truths")

    @cached_property
    def propagated(self) -> DataFrame:
        return materialize(dag.propagate(self.truths, self.closed, ["gene"]), "propagated")

    @cached_property
    def ic(self) -> DataFrame:
        return materialize(scoring.information_content(self.propagated), "ic")


_models: dict[tuple[str, str], Model] = {}


def model(spark: SparkSession, path: str) -> Model:
    """The model of a folder, shared by all queries of one session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _models:
        _models[key] = Model(spark, path)
    return _models[key]
