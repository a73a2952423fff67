"""The learned score of a candidate: boosted trees over its feature vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def train(features: DataFrame, trees: int = 50, depth: int = 4, seed: int = 1) -> GBTClassificationModel:
    """From (features array, label); labels are 1 for the right profile."""
    ready = features.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"))
    return GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed).fit(ready)


def save(model: GBTClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def score(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    """(record_id, aid, score) with the probability of label 1; features of another length fail the job."""
    n = model.numFeatures
    checked = F.when(F.size("features") == n, F.col("features")).otherwise(F.raise_error(F.lit(f"a candidate hasn't {n} features")))
    out = model.transform(features.select("record_id", "aid", array_to_vector(checked).alias("x")))
    return out.select("record_id", "aid", vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class Split:
    """A node: a threshold, or the categories that go left; where missing values (none, zero or NaN) go; both children, below 0 the complement of a leaf."""

    feature: int
    threshold: float
    categories: tuple[int, ...] | None
    missing: int
    missing_left: bool
    left: int
    right: int


@dataclass(frozen=True)
class Tree:
    splits: tuple[Split, ...]
    leaves: tuple[float, ...]

    def sql(self, x: str, at: int | None = None) -> str:
        """The leaf's value for the array of doubles named x."""
        if at is None:
            at = 0 if self.splits else -1
        if at < 0:
            return f"double('{self.leaves[~at]!r}')"
        n, value = self.splits[at], f"{x}[{self.splits[at].feature}]"
        if n.categories is not None:
            # Fractions are cut off first; negative and missing values are in no category.
            left = f"{value} > -1 AND {value} < 2147483648D AND CAST({value} AS BIGINT) IN ({', '.join(map(str, n.categories))})" if n.categories else "false"
        else:
            left = f"{value} <= double('{n.threshold!r}')"
            if n.missing == 2:
                left = f"{left} OR isnan({value})" if n.missing_left else left  # NaN is above every threshold
            elif n.missing == 1:
                gone = f"(isnan({value}) OR abs({value}) <= 1e-35D)"
                left = f"{gone} OR {left}" if n.missing_left else f"NOT {gone} AND {left}"
            else:
                left = f"if(isnan({value}), 0D, {value}) <= double('{n.threshold!r}')"
        return f"if({left}, {self.sql(x, n.left)}, {self.sql(x, n.right)})"


@dataclass(frozen=True)
class TextModel:
    """Boosted trees read from their text form."""

    features: int
    sigmoid: float
    trees: tuple[Tree, ...]

    def raw(self, features: str) -> Column:
        """The sum of the leaves, in the trees' order, of the array column of that name; nulls in it are missing values."""
        clean = f"transform({features}, v -> coalesce(double(v), double('NaN')))"
        # The array is made once a row, under the name x.
        leaves = f"transform(array({clean}), x -> array({', '.join(t.sql('x') for t in self.trees) or '0D'}))[0]"
        return F.aggregate(F.expr(leaves), F.lit(0.0), lambda total, leaf: total + leaf)

    def probability(self, features: str) -> Column:
        return 1 / (1 + F.exp(-self.sigmoid * self.raw(features)))


def parse_text(text: str) -> TextModel:
    """A model with a binary objective, of numeric and categorical splits; other objectives are an error."""
    head, *blocks = text.split("\nTree=")
    fields = lambda block: dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
    top = fields(head)
    objective = top.get("objective", "").split()
    if objective[:1] != ["binary"]:
        raise ValueError("only binary objectives are read")
    sigmoid = next((float(o.split(":")[1]) for o in objective if o.startswith("sigmoid:")), 1.0)
    return TextModel(int(top["max_feature_idx"]) + 1, sigmoid, tuple(_tree(fields(b.split("end of trees")[0])) for b in blocks))


def _tree(t: dict[str, str]) -> Tree:
    numbers = lambda name, kind: [kind(v) for v in t.get(name, "").split()]
    bounds, words = numbers("cat_boundaries", int), numbers("cat_threshold", int)

    def categories(k: int) -> tuple[int, ...]:
        """The k-th set of categories, bits of 32-bit words."""
        own = words[bounds[k] : bounds[k + 1]]
        return tuple(32 * i + b for i, w in enumerate(own) for b in range(32) if w >> b & 1)

    rows = zip(numbers("split_feature", int), numbers("threshold", float), numbers("decision_type", int), numbers("left_child", int), numbers("right_child", int), strict=True)
    splits = tuple(Split(f, v, categories(int(v)) if kind & 1 else None, kind >> 2 & 3, bool(kind & 2), left, right) for f, v, kind, left, right in rows)
    return Tree(splits, tuple(numbers("leaf_value", float)))


def load_text(spark: SparkSession, path: str) -> TextModel:
    return parse_text(spark.read.text(path, wholetext=True).first()["value"])


def score_text(model: TextModel, features: DataFrame) -> DataFrame:
    """(record_id, aid, score) by a model read from text, as expressions of Spark; features of another length, or none, fail the job."""
    n = model.features
    checked = F.when(F.size("features") == n, F.col("features")).otherwise(F.raise_error(F.lit(f"a candidate hasn't {n} features")))
    return features.select("record_id", "aid", checked.alias("features")).select("record_id", "aid", model.probability("features").alias("score"))
