"""Exact decision trees on binary features, grown level by level with grouped counts; the driver holds only the trees.

Trees of many replicates grow together, so a level costs a few jobs however many trees there are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Node:
    node_id: int
    depth: int
    n: float
    counts: dict[str, float]
    parent: int = 0
    feature: str | None = None
    gain: float = 0.0
    left: int = 0  # children by feature value 0 and 1
    right: int = 0


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(node_id, depth, variant_id, left, right, n, gain, label): variant_id is null in leaves, label is the majority."""
        data = [(x.node_id, x.depth, x.feature, x.left, x.right, float(x.n), float(x.gain), majority(x)) for x in self.nodes.values()]
        return spark.createDataFrame(data, "node_id long, depth int, variant_id string, left long, right long, n double, gain double, label string")

    def rules(self) -> str:
        out: list[str] = []

        def walk(i: int) -> None:
            x = self.nodes[i]
            pad = "|   " * x.depth + "|--- "
            if x.feature is None:
                out.append(f"{pad}class: {majority(x)}")
                return
            stack.append((x.right, f"{pad}{x.feature} >  0.50"))
            stack.append((x.left, f"{pad}{x.feature} <= 0.50"))

        stack: list[tuple[int, str]] = [(1, "")]
        while stack:
            i, line = stack.pop()
            if line:
                out.append(line)
            walk(i)
        return "\n".join(out)

    def roots_and_branches(self) -> tuple[list[str], list[str]]:
        """Features of mean depth at most 1.5, and the others."""
        depths: dict[str, list[int]] = {}
        for x in self.nodes.values():
            if x.feature is not None:
                depths.setdefault(x.feature, []).append(x.depth)
        mean = {k: sum(v) / len(v) for k, v in depths.items()}
        return sorted(k for k in mean if mean[k] <= 1.5), sorted(k for k in mean if mean[k] > 1.5)

    def importances(self) -> dict[str, float]:
        total = self.nodes[1].n if self.nodes else 0
        raw: dict[str, float] = {}
        for x in self.nodes.values():
            if x.feature is not None:
                raw[x.feature] = raw.get(x.feature, 0.0) + x.n / total * x.gain
        whole = sum(raw.values())
        return {k: v / whole if whole else 0.0 for k, v in raw.items()}

    def pairs(self) -> list[tuple[str, str, float, int, str]]:
        """(parent, child, support, path_depth, kind) of every inner node below another."""
        out = []
        for x in self.nodes.values():
            if x.feature is not None and x.node_id > 1:
                out.append((self.nodes[x.parent].feature, x.feature, float(x.n), x.depth + 1, "pairwise" if x.depth == 1 else "conditional"))
        return out


def majority(x: Node) -> str | None:
    """The commonest label of a node; of equals the first by name."""
    return min(x.counts, key=lambda k: (-x.counts[k], k)) if x.counts else None


def split_scores(cells: DataFrame, assign: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(node_id, variant_id, n, n1, gini, child): impurity of nodes and of the split by each feature; ``assign``: (sample_id, label, node_id, w),
    and rep where several trees grow together, which the result then has too."""
    by = [c for c in ("rep", "node_id") if c in assign.columns]
    totals = assign.groupBy(*by, "label").agg(F.sum("w").alias("t"))
    ones = cells.where("value = 1").select("sample_id", "variant_id").join(assign, "sample_id").groupBy(*by, "variant_id", "label").agg(F.sum("w").alias("o"))
    if features is not None:
        ones = ones.join(features.select("variant_id").distinct(), "variant_id", "left_semi")
    grid = ones.select(*by, "variant_id").distinct().join(totals, by).join(ones, [*by, "variant_id", "label"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    z = F.col("t") - F.col("o")
    s = grid.groupBy(*by, "variant_id").agg(F.sum("t").alias("n"), F.sum("o").alias("n1"), F.sum(z).alias("n0"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(z * z).alias("zz"))
    s = s.where("n0 > 0 and n1 > 0")
    child = ((F.col("n0") - F.col("zz") / F.col("n0")) + (F.col("n1") - F.col("oo") / F.col("n1"))) / F.col("n")
    return s.select(*by, "variant_id", "n", "n1", (1 - F.col("tt") / (F.col("n") * F.col("n"))).alias("gini"), child.alias("child"))


def best_splits(scores: DataFrame, least_leaf: float = 1) -> DataFrame:
    """The best split of each node; of equal ones the first feature by name. Splits without gain are allowed."""
    fit = scores.where((F.col("n1") >= least_leaf) & (F.col("n") - F.col("n1") >= least_leaf) & (F.col("gini") > 0))
    by = [c for c in ("rep", "node_id") if c in scores.columns]
    return fit.groupBy(*by).agg(F.min(F.struct(F.round("child", 12).alias("child"), "variant_id", "n", "gini")).alias("s")).select(*by, "s.*")


#: Nodes of a level that may be broadcast: some 50 bytes each.
BROADCAST_NODES = 200_000


def grow(cells: DataFrame, labels: DataFrame, max_depth: int | None = None, least_split: float = 2, least_leaf: float = 1, weights: DataFrame | None = None, cut=None) -> Tree:
    """A tree on sparse 0/1 cells. ``weights``: (sample_id, w); ``cut``: ends lineage each level (default: checkpoint if a folder is set)."""
    samples = labels.select("sample_id", "label")
    samples = samples.join(weights.select("sample_id", "w"), "sample_id") if weights is not None else samples.withColumn("w", F.lit(1.0))
    return grow_all(cells, samples.withColumn("rep", F.lit(0)), max_depth, least_split, least_leaf, cut).get(0, Tree())


def grow_all(cells: DataFrame, samples: DataFrame, max_depth: int | None = None, least_split: float = 2, least_leaf: float = 1, cut=None) -> dict[int, Tree]:
    """A tree of each replicate in ``samples(rep, sample_id, label, w)``, all level by level in the same jobs."""
    kept = cells.where("value = 1").select("sample_id", "variant_id", "value").persist()  # read twice a level
    try:
        return grow_levels(kept, samples, max_depth, least_split, least_leaf, cut)
    finally:
        kept.unpersist()


def grow_levels(cells: DataFrame, samples: DataFrame, max_depth: int | None, least_split: float, least_leaf: float, cut) -> dict[int, Tree]:
    """As ``grow_all``, of cells that hold ones only."""
    spark = cells.sparkSession
    end = cut or (lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist())
    assign = samples.select("rep", "sample_id", "label", F.lit(1).cast("bigint").alias("node_id"), "w")
    hit = cells.withColumnRenamed("value", "one")
    trees: dict[int, Tree] = {}
    parents: dict[tuple[int, int], int] = {}
    depth = 0
    while True:
        assign = end(assign)
        totals: dict[tuple[int, int], dict[str, float]] = {}  # as many rows as nodes times labels
        for r in assign.groupBy("rep", "node_id", "label").agg(F.sum("w").alias("t")).collect():
            totals.setdefault((r.rep, r.node_id), {})[r.label] = r.t
        for (rep, i), c in totals.items():
            trees.setdefault(rep, Tree()).nodes[i] = Node(i, depth, sum(c.values()), c, parents.get((rep, i), 0))
        alive = {k for k, c in totals.items() if sum(c.values()) >= least_split and len([v for v in c.values() if v > 0]) > 1}
        if not alive or (max_depth is not None and depth >= max_depth):
            return trees
        best = [r for r in best_splits(split_scores(cells, assign), least_leaf).collect() if (r.rep, r.node_id) in alive]
        if not best:
            return trees
        last = {rep: max(t.nodes) for rep, t in trees.items()}
        picks, parents = [], {}
        for r in sorted(best, key=lambda r: (r.rep, r.node_id)):
            x = trees[r.rep].nodes[r.node_id]
            x.feature, x.gain = r.variant_id, r.gini - r.child
            x.left, x.right = last[r.rep] + 1, last[r.rep] + 2
            last[r.rep] += 2
            parents[r.rep, x.left] = parents[r.rep, x.right] = r.node_id
            picks.append((r.rep, r.node_id, r.variant_id, x.left, x.right))
        chosen = spark.createDataFrame(picks, "rep int, node_id long, variant_id string, left long, right long")
        down = assign.join(F.broadcast(chosen) if len(picks) <= BROADCAST_NODES else chosen, ["rep", "node_id"])
        assign = down.join(hit, ["sample_id", "variant_id"], "left").select("rep", "sample_id", "label", F.when(F.col("one") == 1, F.col("right")).otherwise(F.col("left")).alias("node_id"), "w")
        depth += 1


def predict(tree: Tree, cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, label) by walking the tree one level a join."""
    spark = cells.sparkSession
    rows = tree.rows(spark)
    rows = F.broadcast(rows) if len(tree.nodes) <= BROADCAST_NODES else rows
    hit = cells.where("value = 1").select("sample_id", "variant_id", F.lit(1).alias("one"))
    now = samples.select("sample_id", F.lit(1).cast("bigint").alias("node_id"))
    for _ in range(max(x.depth for x in tree.nodes.values())):
        step = now.join(rows.select("node_id", "variant_id", "left", "right"), "node_id").join(hit, ["sample_id", "variant_id"], "left")
        now = step.select("sample_id", F.when(F.col("variant_id").isNull(), F.col("node_id")).when(F.col("one") == 1, F.col("right")).otherwise(F.col("left")).alias("node_id"))
    return now.join(rows.select("node_id", "label"), "node_id").select("sample_id", "label")


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.withColumnRenamed("label", "guess").join(labels, "sample_id").agg(F.avg((F.col("guess") == F.col("label")).cast("int")).alias("accuracy"))


def interactions(tree: Tree, cells: DataFrame, labels: DataFrame, least: float = 0.05, most: int = 50) -> DataFrame:
    """Parent and child features of the tree with their synergy, strongest first."""
    from .association import synergy

    pairs = cells.sparkSession.createDataFrame(tree.pairs(), "f1 string, f2 string, support double, path_depth int, kind string")
    s = synergy(cells, labels, pairs)
    return pairs.join(s, ["f1", "f2"]).where(F.col("strength") > least).orderBy(F.desc("strength"), "f1", "f2", "path_depth").limit(most)
