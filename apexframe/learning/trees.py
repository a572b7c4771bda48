"""Boosted trees and forests on rows with very many one-hot elements.

Spark's own learners hold every row as wide as the feature vector is long, so
that their work is the number of rows times the number of labels. Here a row
keeps its few numbers, as bins, and the places of its ones. A level of the trees
is one grouping: sums by node, element and bin. What lies on the zero side of a
one-hot element is the node less the one side, so only the ones are read.

Bins, gains and stopping rules are those of Spark's learners, and the result is
an ordinary Spark model. Bins come from all values, none from a sample. Sums
differ in the order of adding, so gains that differ by less than a billionth
of the node's impurity are equal, and the first element wins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexframe.operators.groups import running_sums
from apexframe.session import scratch_dir, stage

# Rows meet the trees of so many levels before they are staged again.
_LEVELS = 8
# A one-hot element of a forest is rare if at most one row in so many has it.
_RARE = 1024
# Shares of at most 0, 1, 2, ... draws of a row among as many draws as there are rows.
_DRAWS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)
_ROUTE = "routes array<array<struct<f int, b int, l int, r int, lv double, rv double>>>"


@dataclass
class _Node:
    """Rows, sum and squares of the target; the split and its children if it has one."""

    n: float
    s: float
    q: float
    feature: int = -1
    cut: float = 0.0
    gain: float = -1.0
    children: list[_Node] = field(default_factory=list)

    @property
    def value(self) -> float:
        return self.s / self.n

    @property
    def impurity(self) -> float:
        return max((self.q - self.s * self.s / self.n) / self.n, 0.0)

    @property
    def pure(self) -> bool:
        return self.impurity <= 1e-12 * self.q / self.n


def fit(estimator: Estimator, rows: DataFrame, numbers: int, size: int) -> Model:
    """The estimator's model from staged rows with its label, ``numbers`` (array of
    doubles, the first elements of the feature vector) and ``ones`` (the places of
    ones among the others). ``size``: the length of the vector."""
    label = F.col(estimator.getLabelCol()).cast("double")
    cuts = thresholds(rows, numbers, estimator.getMaxBins())
    bins = [_below(c, F.col("numbers")[k]) for k, c in enumerate(cuts)]
    binned = rows.select(F.monotonically_increasing_id().alias("id"), label.alias("label"), F.array(*bins).alias("bins"), "ones")
    grower = _Grower(estimator, cuts, size)
    trees, weights = (_boosted if hasattr(estimator, "getMaxIter") else _forest)(estimator, binned, grower)
    return _model(estimator, rows, trees, weights, numbers, size)


def _below(cuts: Sequence[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0)


def _as_bins(places: Column | str) -> Column:
    return F.transform(places, lambda o: F.struct(o.alias("f"), F.lit(1).alias("b")))


def thresholds(rows: DataFrame, numbers: int, most_bins: int) -> list[list[float]]:
    """Cuts between the bins of each number, ascending: all middles between values if
    there are few, else those next to even shares of the rows."""
    one = F.lit(1).cast("long")
    pairs = F.posexplode("numbers").alias("name", "value")
    counts = rows.select(pairs).groupBy("name", "value").agg(F.count(one).alias("n")).withColumn("one", one)
    placed = stage(running_sums(counts, ["name"], "value", ["n", "one"]))
    # One row for each number.
    sizes = {r["name"]: r for r in placed.groupBy("name").agg(F.max("n_total").alias("rows"), F.max("one_total").alias("values")).collect()}
    bins = min(most_bins, max((r["rows"] for r in sizes.values()), default=1))
    share = F.col("n_total") / F.lit(float(bins))
    # How many shares end before the middle of the value.
    ended = F.least(F.ceil((2 * F.col("n_below") + F.col("n")) / (2 * share)) - 1, F.lit(bins))
    many = placed.filter((F.col("one_total") > bins) & (F.col("one_below") > 0))
    # At most a row for each bin.
    firsts = many.groupBy("name", ended.alias("ended")).agg(F.min("one_below").alias("at")).collect()
    wanted = []
    for name, r in sizes.items():
        if r["values"] <= bins:
            wanted += [(name, at) for at in range(1, r["values"])]
            continue
        found, last = {x["ended"]: x["at"] for x in firsts if x["name"] == name}, 0
        for k in range(1, bins + 1):
            reached = [at for e, at in found.items() if e >= k]
            last = max(min(reached), last + 1) if reached else r["values"]
            if last >= r["values"]:
                break
            wanted.append((name, last))
    if not wanted:
        return [[] for _ in range(numbers)]
    spark = rows.sparkSession
    ends = spark.createDataFrame([(name, at - side, at) for name, at in wanted for side in (0, 1)], "name int, one_below long, at long")
    middles = placed.join(F.broadcast(ends), ["name", "one_below"]).groupBy("name", "at").agg(((F.min("value") + F.max("value")) / 2).alias("cut")).collect()
    return [sorted(r["cut"] for r in middles if r["name"] == k) for k in range(numbers)]


class _Grower:
    """Grows trees level by level."""

    def __init__(self, estimator: Estimator, cuts: Sequence[Sequence[float]], size: int) -> None:
        self.cuts, self.size = cuts, size
        self.depth, self.least = estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
        self.gain = estimator.getMinInfoGain()
        # Gini of two classes is twice the variance.
        self.factor = 2.0 if isinstance(estimator, RandomForestClassifier) else 1.0
        # Most rows of a rare element, and the range of y; 0 where no element is put off.
        self.rare_rows, self.low, self.high = 0, 0.0, 0.0

    def grow(self, points: DataFrame, trees: int, weight, chosen=None) -> tuple[list[_Node], DataFrame]:
        """Trees on ``points``: label, y, bins, ones and ``nodes``, the row's node in
        each tree, negative outside. ``weight``: how often a row counts in a tree.
        The points come back with ``leaf``, their value in a single tree."""
        drawn = points.select(F.posexplode("nodes").alias("tree", "node"), "*").filter("node >= 0").withColumn("w", weight(F.col("tree")))
        sums = drawn.groupBy("tree").agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("y") * F.col("y"))).collect()
        roots = {r[0]: _Node(*map(float, r[1:])) for r in sums}
        if len(roots) < trees:
            raise ValueError("a tree has no rows")
        level = [[] if roots[t].pure or self.depth == 0 else [roots[t]] for t in range(trees)]
        points = points.withColumn("leaf", F.lit(roots[0].value))
        for depth in range(self.depth):
            if not any(level):
                break
            splits = self._splits(points, level, weight, chosen, depth)
            level, routes = self._divided(level, splits, depth)
            points = self._routed(points, routes, trees)
            if (trees > 1 or depth % _LEVELS == _LEVELS - 1) and any(level):
                points = stage(points)
        return [roots[t] for t in range(trees)], points

    def _splits(self, points: DataFrame, level: list[list[_Node]], weight, chosen, depth: int) -> dict:
        """The best split of each node of a level: element, bin, gain, and the sums on its left.

        A forest puts off its rare elements. They are summed only for nodes whose best
        split among the others isn't better than any split on a rare one can be.
        """
        active = {(t, k): x for t, own in enumerate(level) for k, x in enumerate(own)}
        numbers = len(self.cuts)
        bins = [F.struct(F.lit(k).alias("f"), F.col("bins")[k].alias("b")) for k in range(numbers)]
        if not self.rare_rows:
            return self._best(points, F.concat(F.array(*bins), _as_bins("ones")), active, weight, chosen, depth)
        best = self._best(points, F.concat(F.array(*bins), _as_bins("common")), active, weight, chosen, depth)
        others = {at: x for at, x in active.items() if self._rare_may_win(x, best.get(at))}
        if others:
            for at, x in self._best(points, _as_bins(F.array_except("ones", "common")), others, weight, chosen, depth).items():
                best[at] = max(best.get(at, x), x, key=lambda r: (r["rated"], -r["f"], -r["b"]))
        return best

    def _rare_may_win(self, x: _Node, best) -> bool:
        """Whether a split on a rare element may gain as much as the best of the others.
        The rows with such an element weigh little, and their mean is in the range of y."""
        most = self.rare_rows * len(_DRAWS)
        if best is None or x.n <= most:
            return True
        far = max(self.high - x.value, x.value - self.low)
        return far * far * most / (x.n - most) >= (best["rated"] - 2e-9) * x.impurity

    def _best(self, points: DataFrame, places: Column, active: dict, weight, chosen, depth: int) -> dict:
        """The best split of each active node on the given places: element and bin."""
        known = [(t, k, x.n, x.s, x.q) for (t, k), x in active.items()]
        whole = F.broadcast(points.sparkSession.createDataFrame(known, "tree int, node int, all_n double, all_s double, all_q double"))
        numbers = len(self.cuts)
        # A place meets the trees one by one, so no list of places is made for each tree.
        placed = points.select("*", F.inline(places).alias("f", "b"))
        drawn = placed.select("f", "b", "y", *[c for c in ("id",) if c in points.columns], F.posexplode("nodes").alias("tree", "node")).filter("node >= 0")
        drawn = drawn.select("tree", "node", weight(F.col("tree")).alias("w"), "y", "f", "b")
        if self.rare_rows:
            drawn = drawn.join(whole.select("tree", "node"), ["tree", "node"], "left_semi")
        if chosen is not None:
            drawn = drawn.filter(chosen(F.lit(depth), F.col("tree"), F.col("node"), F.col("f")))
        y, w = F.col("y"), F.col("w")
        sums = drawn.groupBy("tree", "node", "f", "b").agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"))
        # At most as many rows as a number has bins.
        up_to = Window.partitionBy("tree", "node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        both = sums.withColumns({f"{c}_up": F.sum(c).over(up_to) for c in "nsq"}).join(whole, ["tree", "node"])
        left = {c: F.when(F.col("f") < numbers, F.col(f"{c}_up")).otherwise(F.col(f"all_{c}") - F.col(c)) for c in "nsq"}
        both = both.select("tree", "node", "f", F.when(F.col("f") < numbers, F.col("b")).otherwise(0).alias("b"), "all_n", "all_s", "all_q", *[x.alias(f"l{c}") for c, x in left.items()])
        both = both.withColumns({f"r{c}": F.col(f"all_{c}") - F.col(f"l{c}") for c in "nsq"})
        both = both.filter((F.col("ln") >= self.least) & (F.col("rn") >= self.least) & (F.col("ln") > 0) & (F.col("rn") > 0))

        def spread(n: str, s: str, q: str) -> Column:
            return (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / F.col(n)

        before = spread("all_n", "all_s", "all_q")
        after = F.col("ln") / F.col("all_n") * spread("ln", "ls", "lq") + F.col("rn") / F.col("all_n") * spread("rn", "rs", "rq")
        both = both.withColumn("gain", before - after).withColumn("rated", F.round(F.col("gain") / before, 9))
        both = both.filter((F.col("rated") > 0) & (F.col("gain") * self.factor >= self.gain))
        rank = F.struct("rated", -F.col("f"), -F.col("b"))
        best = both.groupBy("tree", "node").agg(F.max_by(F.struct("f", "b", "rated", "gain", "ln", "ls", "lq"), rank).alias("x"))
        return {(r["tree"], r["node"]): r["x"] for r in best.collect()}

    def _divided(self, level: list[list[_Node]], splits: dict, depth: int) -> tuple[list[list[_Node]], list]:
        below: list[list[_Node]] = [[] for _ in level]
        routes = []
        for t, own in enumerate(level):
            routes.append([])
            for k, node in enumerate(own):
                x = splits.get((t, k))
                if x is None:
                    routes[t].append((-1, 0, -1, -1, node.value, node.value))
                    continue
                node.feature, node.gain = x["f"], x["gain"] * self.factor
                node.cut = self.cuts[x["f"]][x["b"]] if x["f"] < len(self.cuts) else 0.5
                left = _Node(x["ln"], x["ls"], x["lq"])
                node.children = [left, _Node(node.n - left.n, node.s - left.s, node.q - left.q)]
                to = []
                for child in node.children:
                    goes_on = depth + 1 < self.depth and not child.pure
                    to.append(len(below[t]) if goes_on else -1)
                    below[t] += [child] if goes_on else []
                routes[t].append((x["f"], x["b"], *to, *(c.value for c in node.children)))
        return below, routes

    def _routed(self, points: DataFrame, routes: list, trees: int) -> DataFrame:
        """Every row one level further in every tree."""
        table = F.broadcast(points.sparkSession.createDataFrame([(routes,)], _ROUTE))
        rows = points.crossJoin(table)
        numbers = len(self.cuts)

        def left(x: Column) -> Column:
            by_bin = F.col("bins")[F.greatest(x["f"], F.lit(0))] <= x["b"]
            return F.when(x["f"] < 0, True).when(x["f"] < numbers, by_bin).otherwise(~F.array_contains("ones", x["f"]))

        def step(node: Column, tree: Column) -> Column:
            x = F.col("routes")[tree][F.greatest(node, F.lit(0))]
            return F.when(node < 0, F.lit(-1)).otherwise(F.when(left(x), x["l"]).otherwise(x["r"]))

        kept = [c for c in points.columns if c not in ("nodes", "leaf")]
        leaf = F.col("leaf")
        if trees == 1:
            x = F.col("routes")[0][F.greatest(F.col("nodes")[0], F.lit(0))]
            leaf = F.when(F.col("nodes")[0] < 0, leaf).otherwise(F.when(left(x), x["lv"]).otherwise(x["rv"]))
        return rows.select(*kept, F.transform("nodes", step).alias("nodes"), leaf.alias("leaf"))


def _boosted(estimator: Estimator, binned: DataFrame, grower: _Grower) -> tuple[list[_Node], list[float]]:
    """Tree after tree on what is left: the residual, or the slope of the logistic loss."""
    if estimator.getSubsamplingRate() != 1.0 or estimator.getFeatureSubsetStrategy() != "all":
        raise ValueError("boosted trees use all rows and all features")
    classes, label, said = isinstance(estimator, GBTClassifier), F.col("label"), F.col("said")
    kinds = ("logistic",) if classes else ("squared",)
    if estimator.getLossType() not in kinds:
        raise ValueError(f"the loss of boosted trees is {kinds[0]}")
    slope = 4 * label / (1 + F.exp(2 * label * said)) if classes else 2 * (label - said)
    rows = stage(binned.select((2 * label - 1 if classes else label).alias("label"), F.lit(0.0).alias("said"), "bins", "ones"))
    trees: list[_Node] = []
    weights: list[float] = []
    for k in range(estimator.getMaxIter()):
        points = rows.select("*", (slope if k else label).alias("y"), F.array(F.lit(0)).alias("nodes"))
        (tree,), points = grower.grow(points, 1, lambda tree: F.lit(1.0))
        trees.append(tree)
        weights.append(estimator.getStepSize() if k else 1.0)
        if k + 1 < estimator.getMaxIter():
            rows = stage(points.select("label", (said + weights[-1] * F.col("leaf")).alias("said"), "bins", "ones"))
    return trees, weights


def _forest(estimator: Estimator, binned: DataFrame, grower: _Grower) -> tuple[list[_Node], list[float]]:
    """All trees side by side. A row counts in a tree as often as chance has it drawn."""
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    if estimator.getSubsamplingRate() != 1.0:
        raise ValueError("forests draw as many rows as there are")

    def chance(*of: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 31))

    alike = trees == 1 or not estimator.getBootstrap()

    def share(tree: Column) -> Column:
        return chance(F.col("id"), tree.cast("int")) / F.lit(float(1 << 31))

    def weight(tree: Column) -> Column:
        if alike:
            return F.lit(1.0)
        return reduce(add, [(share(tree) >= c).cast("int") for c in _DRAWS]).cast("double")

    count = _subset(estimator, trees, grower.size)

    def chosen(depth: Column, tree: Column, node: Column, feature: Column) -> Column:
        # The elements that a bijection of their places puts first: exactly as many.
        steps = F.array(*map(F.lit, _coprimes(grower.size)))
        of = (depth, tree, node)
        step = steps[F.pmod(chance(F.lit("step"), *of), F.size(steps)).cast("int")]
        return F.pmod(feature.cast("long") * step + chance(F.lit("shift"), *of), F.lit(grower.size)) < count

    def first(tree: Column) -> Column:
        return F.lit(0) if alike else F.when(share(tree) >= _DRAWS[0], 0).otherwise(-1)

    rows = stage(binned)
    found = rows.select(F.explode("ones").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    rows_of, grower.low, grower.high = rows.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    # At most as many as a row has ones, times _RARE.
    often = [r["f"] for r in found.filter(F.col("n") * _RARE > rows_of).select("f").collect()]
    grower.rare_rows = found.filter(F.col("n") * _RARE <= rows_of).agg(F.max("n")).first()[0] or 0
    common = F.expr(f"filter(ones, o -> o IN ({', '.join(map(str, often or [-1]))}))")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), first)
    # A row is much work, as it meets every tree, so a few rows are dealt over all cores.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
    points = stage(dealt.select("id", F.col("label").alias("y"), "bins", "ones", common.alias("common"), nodes.alias("nodes")))
    grown, _ = grower.grow(points, trees, weight, chosen if count < grower.size else None)
    return grown, [1.0] * trees


def _subset(estimator: Estimator, trees: int, size: int) -> int:
    """How many features a node of a forest may split on."""
    kind = estimator.getFeatureSubsetStrategy()
    if kind == "auto":
        kind = "all" if trees == 1 else "sqrt" if isinstance(estimator, RandomForestClassifier) else "onethird"
    counts = {"all": size, "sqrt": math.ceil(math.sqrt(size)), "onethird": math.ceil(size / 3), "log2": max(1, math.ceil(math.log2(size)))}
    if kind not in counts:
        raise ValueError(f"features of a node are one of auto, {', '.join(counts)}")
    return counts[kind]


def _coprimes(size: int, most: int = 64) -> list[int]:
    """Steps without common divisor with the size, spread over it."""
    found = []
    for k in range(most):
        step = max(1, size * (2 * k + 1) // (2 * most))
        while math.gcd(step, size) != 1:
            step += 1
        found.append(step)
    return sorted(set(found))


def _model(estimator: Estimator, rows: DataFrame, trees: Sequence[_Node], weights: Sequence[float], numbers: int, size: int) -> Model:
    """The trees as a Spark model, through the tables that Spark saves one as."""
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession, "ensemble")
    forest, classes = not hasattr(estimator, "getMaxIter"), isinstance(estimator, GBTClassifier | RandomForestClassifier)
    estimator.write().save(f"{folder}/estimator")
    header = json.loads(spark.read.text(f"{folder}/estimator/metadata").first()[0])
    kind = RandomForestClassificationModel if forest and classes else RandomForestRegressionModel if forest else GBTClassificationModel if classes else GBTRegressionModel
    header |= {"class": f"{header['class'].removesuffix('Classifier').removesuffix('Regressor')}{'Classification' if classes else 'Regression'}Model"}
    header |= {"numFeatures": size, "numTrees": len(trees)} | ({"numClasses": 2} if forest and classes else {})
    votes = forest and classes
    each = "Classification" if votes else "Regression"
    shared = {k: v for k, v in {**header["defaultParamMap"], **header["paramMap"]}.items() if k in ("cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "impurity")}
    own = {"class": f"org.apache.spark.ml.{each.lower()}.DecisionTree{each}Model", "timestamp": header["timestamp"], "sparkVersion": header["sparkVersion"], "paramMap": shared, "defaultParamMap": {}}
    own |= {"numFeatures": size} | ({"numClasses": 2} if votes else {})
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{folder}/model/metadata")
    lines = [(t, json.dumps(own | {"uid": f"{header['uid']}_tree_{t}"}), w) for t, w in enumerate(weights)]
    spark.createDataFrame(lines, "_1 int, _2 string, _3 double").write.parquet(f"{folder}/model/treesMetadata")
    nodes = [(t, node) for t, tree in enumerate(trees) for node in _listed(tree, numbers, votes)]
    spark.createDataFrame(nodes, _NODES).write.parquet(f"{folder}/model/data")
    return kind.load(f"{folder}/model")


def _listed(tree: _Node, numbers: int, votes: bool) -> list[tuple]:
    """The nodes of a tree, each before its children; leaves that say the same are one."""

    def said(x: _Node) -> float:
        return float(x.s > x.n - x.s) if votes else x.value

    order = [tree]
    for x in order:
        order += x.children
    for x in reversed(order):
        if x.children and not any(c.children for c in x.children) and said(x.children[0]) == said(x.children[1]):
            x.children = []
    order = [tree]
    for x in order:
        order += x.children
    place, out = {id(x): k for k, x in enumerate(order)}, []
    for k, x in enumerate(order):
        stats = [x.n - x.s, x.s] if votes else [x.n, x.s, x.q]
        turn = -1 if x.children and x.feature >= numbers and x.children[0].value > x.children[1].value else 1
        below = [place[id(c)] for c in x.children][::turn] or [-1, -1]
        # A one-hot element is a category of two values; that with the lower mean goes left.
        split = (-1, [], -1) if not x.children else (x.feature, [x.cut], -1) if x.feature < numbers else (x.feature, [float(turn < 0)], 2)
        impurity = x.impurity * (2.0 if votes else 1.0)
        out.append((k, said(x), impurity, stats, int(x.n), x.gain if x.children else -1.0, *below, split))
    return out
