"""Linear heads on Spark ML: feature pipe with group debiasing, out-of-fold scores, leave-one-center-out legs,
calibrated ensembles and nuisance residuals. Fits run on the cluster; only coefficients (one vector per model)
reach the driver."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens import vocabulary as V
from votelens.functions.ordering import hash_index
from votelens.functions.scalars import logit, sigmoid
from votelens.operators import curves as C
from votelens.operators import resample as R
from votelens.operators.evaluation import ensemble_mean
from votelens.operators.labels import gap_fill
from votelens.session import cut_lineage


def pool_l2_normalize(emb: DataFrame, pools: list[str], names: list[str] = V.POOLS, feats: str = "feats") -> DataFrame:
    """Cut the feature array into equal pools, scale each chosen pool to unit length, concatenate."""
    width = (F.size(feats) / F.lit(len(names))).cast("int")
    parts = []
    for p in pools:
        block = F.transform(F.slice(F.col(feats), width * names.index(p) + 1, width), lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(block, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-6)
        parts.append(F.transform(block, lambda x: x / norm))
    return emb.withColumn("x", F.concat(*parts))


def pool_tokens(emb: DataFrame, dims: int, registers: int = 4, feats: str = "feats") -> DataFrame:
    """Token matrix (row-major array) to class token, register mean, patch mean and patch max."""
    token = lambda i: F.slice(F.col(feats), i * dims + 1, dims)
    n = F.floor(F.size(feats) / F.lit(dims)).cast("int")
    column = lambda lo, hi, j: F.transform(F.sequence(lo, hi), lambda t: F.element_at(feats, t * dims + j + 1).cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    over = lambda lo, hi, agg: F.array(*[agg(column(lo, hi, j)) for j in range(dims)])
    first, last = F.lit(registers + 1), n - 1
    return emb.select("name", token(0).alias("cls"), over(F.lit(1), F.lit(registers), mean).alias("reg_mean"),
                      over(first, last, mean).alias("patch_mean"), over(first, last, F.array_max).alias("patch_max"))


@dataclass
class FeaturePipe:
    """Fitted standardiser, optional whitening and center directions."""
    pools: list[str]
    mu: np.ndarray
    sd: np.ndarray
    whiten: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None   # components, mean, std of components
    directions: list[np.ndarray] = field(default_factory=list)

    def transform(self, emb: DataFrame) -> DataFrame:
        """Adds column ``x``: normalised pools, standardised, whitened, with center directions projected out."""
        mu, sd, whiten = self.mu, self.sd, self.whiten
        w = np.array(self.directions) if self.directions else None

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def apply(batch: pd.Series) -> pd.Series:
            x = (np.stack(batch.to_numpy()) - mu) / sd
            if whiten is not None:
                x = ((x - whiten[1]) @ whiten[0]) / whiten[2]
            for d in () if w is None else w:
                x = x - np.outer(x @ d, d)
            return pd.Series(list(x))

        return pool_l2_normalize(emb, self.pools).withColumn("x", apply("x"))


def _moments(df: DataFrame, col: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation per dimension in one tree aggregation."""
    s = Summarizer.metrics("mean", "variance", "count")
    r = df.select(s.summary(array_to_vector(col)).alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = r["count"]
    return np.array(r["mean"]), np.sqrt(np.array(r["variance"]) * ((n - 1) / n if n > 1 else 0.0))


def fit_pipe(emb: DataFrame, pools: list[str] | None = None, whiten_dim: int = 0, debias_k: int = 0,
             extra: DataFrame | None = None) -> FeaturePipe:
    """Standardise on the fit rows (plus optional unlabelled extra rows), optionally whiten, then project out
    ``debias_k`` directions that tell the centers apart."""
    pools = pools or V.POOLS
    x = pool_l2_normalize(emb, pools).select("x", "center")
    src = x.select("x")
    if extra is not None:
        src = src.unionByName(pool_l2_normalize(extra, pools).select("x"))
    mu, sd = _moments(src)
    pipe = FeaturePipe(pools, mu, sd + 1e-6)
    if whiten_dim:
        z = pipe.transform(extra.unionByName(emb, allowMissingColumns=True) if extra is not None else emb)
        z = z.select(array_to_vector("x").alias("v"))
        comp = PCA(k=min(whiten_dim, len(mu)), inputCol="v", outputCol="p").fit(z).pc.toArray()
        mean, _ = _moments(z.select(vector_to_array("v").alias("x")))
        proj = FeaturePipe(pools, mu, sd + 1e-6, (comp, mean, np.ones(comp.shape[1])))
        src_emb = extra.unionByName(emb, allowMissingColumns=True) if extra is not None else emb
        _, std = _moments(proj.transform(src_emb).select("x"))
        n = z.count()
        pipe.whiten = (comp, mean, np.maximum(std * np.sqrt(n / max(n - 1, 1)), 1e-12))
    center_debias(pipe, emb, debias_k)
    return pipe


def center_debias(pipe: FeaturePipe, emb: DataFrame, k: int) -> None:
    """k times: fit a center classifier on the current features, keep its unit weight vector, project it out.

    The weights stay in the space that the earlier directions leave, so the standardised features are written once and never projected:
    there their margins are the same. Gradient and Hessian at zero are those of the first round for every round."""
    if not k:
        return
    base = cut_lineage(pipe.transform(emb.filter(F.col("center").isin("center_1", "center_2")))
                       .select("x", (F.col("center") == "center_1").cast("double").alias("y")))
    fresh: list[np.ndarray] = []
    start = None
    for _ in range(k):
        fitted = newton_logistic(base, [Fit(c=1.0, balanced=False, within=_left_by(fresh, len(pipe.mu) if pipe.whiten is None else pipe.whiten[0].shape[1]))], start=start)
        start = fitted.start
        w = fitted.coefficients[0]
        fresh.append(w / (np.linalg.norm(w) + 1e-9))
    pipe.directions += fresh


def _left_by(directions: list[np.ndarray], dims: int) -> np.ndarray:
    """Projection onto what the unit directions, taken out in turn, leave."""
    left = np.eye(dims)
    for d in directions:
        unit = d / (np.linalg.norm(d) or 1.0)
        left -= np.outer(left @ unit, unit)
    return left


@dataclass
class Fit:
    """One logistic regression of a batch: C * sum(weight * loss) + |w|^2 / 2 over the rows whose ``use`` has bit ``group`` set."""
    c: float
    group: int = 0
    balanced: bool = True
    within: np.ndarray | None = None   # weights are kept in the range of this projection


@dataclass
class Fitted:
    coefficients: list[np.ndarray]
    intercepts: list[float]
    passes: int
    start: list[np.ndarray]


#: Numbers of a batch's Hessians that a task adds up at once (fits * dims^2); more fits take turns.
HESSIANS = 1 << 24
_SLOTS = 64
#: Numbers that all partitions may send to the driver as they are; more are added up on the cluster first.
DRIVER_SUMS = 1 << 22


def _added(parts: DataFrame, numbers: int) -> dict[int, np.ndarray]:
    """Adds binary arrays by fit. ``numbers``: how many the partitions hold together. Beyond DRIVER_SUMS they are added in slots of
    partitions and then by fit, so neither a task nor the driver holds those of all partitions."""
    if numbers <= DRIVER_SUMS:
        out: dict[int, np.ndarray] = {}
        for r in parts.collect():
            held = np.frombuffer(bytes(r["held"]), np.float64)
            out[r["fit"]] = out[r["fit"]] + held if r["fit"] in out else held
        return out

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in rows.column("held").to_pylist())
        return pa.table({"fit": rows.column("fit").slice(0, 1), "held": pa.array([total.tobytes()], pa.binary())})

    near = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(_SLOTS))).groupBy("fit", "slot").applyInArrow(add, "fit long, held binary")
    return {r["fit"]: np.frombuffer(bytes(r["held"]), np.float64) for r in near.groupBy("fit").applyInArrow(add, "fit long, held binary").collect()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features with a last column of ones, labels and group bits of each Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield np.column_stack([x, np.ones(len(x))]), batch.column("y").to_numpy(), batch.column("use").to_numpy()


def newton_logistic(xy: DataFrame, fits: list[Fit], tol: float = 1e-8, max_passes: int = 50, start: list[np.ndarray] | None = None) -> Fitted:
    """All fits by damped Newton steps in the same passes over (x, y[, use]): a task adds up loss, gradient and Hessian of every fit
    over its Arrow blocks, and only those sums travel. ``start`` holds the sums at zero of an earlier call over the same rows."""
    rows = xy.select("x", "y", F.col("use").cast("long").alias("use") if "use" in xy.columns else F.lit(-1).cast("long").alias("use"))

    parts_read = rows.rdd.getNumPartitions()

    def sums(weights: dict[int, np.ndarray], classes: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
        """loss, gradient and Hessian of the weighted losses at the given weights, one array for each fit."""
        out: dict[int, np.ndarray] = {}
        asked = sorted(weights)
        step = max(1, HESSIANS // max(1, next(iter(weights.values())).size ** 2)) if asked else 1
        groups = {i: fits[i].group for i in asked}
        for at in range(0, len(asked), step):
            mine = asked[at:at + step]
            w, cw = np.stack([weights[i] for i in mine], axis=1), [classes[i] for i in mine]
            bits = [groups[i] for i in mine]

            def run(batches, w=w, cw=cw, bits=bits, mine=mine):
                held = None
                for x, y, use in _blocks(batches):
                    held = [np.zeros(1 + x.shape[1] + x.shape[1] ** 2) for _ in mine] if held is None else held
                    margin = x @ w
                    loss, p = np.logaddexp(0, margin) - margin * y[:, None], 1.0 / (1.0 + np.exp(-margin))
                    for j, (c0, c1) in enumerate(cw):
                        weight = np.where(y > 0, c1, c0) * (use >> bits[j] & 1)
                        held[j][0] += weight @ loss[:, j]
                        held[j][1:1 + x.shape[1]] += (weight * (p[:, j] - y)) @ x
                        held[j][1 + x.shape[1]:] += ((x * (weight * p[:, j] * (1 - p[:, j]))[:, None]).T @ x).ravel()
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], names=["fit", "held"])

            out |= _added(rows.mapInArrow(run, "fit long, held binary"), parts_read * len(mine) * (w.shape[0] + 1) ** 2)
        return out

    groups = sorted({f.group for f in fits})

    def count(batches):
        held, dims = np.zeros((len(groups), 2)), 0
        for x, y, use in _blocks(batches):
            dims = x.shape[1]
            for j, g in enumerate(groups):
                for c in (0, 1):
                    held[j, c] += ((use >> g & 1) * ((y > 0) == bool(c))).sum()
        yield pa.RecordBatch.from_arrays([pa.array([dims]), pa.array([held.tobytes()], pa.binary()), pa.array([0])], names=["dims", "held", "fit"])

    counted = rows.mapInArrow(count, "dims long, held binary, fit long")
    if start is None:
        dims = counted.agg(F.max("dims")).first()[0] or 1
        numbers = _added(counted.select("fit", "held"), parts_read * 2 * len(groups)).get(0, np.zeros(2 * len(groups))).reshape(-1, 2)
        classes = {}
        for i, f in enumerate(fits):
            n0, n1 = numbers[groups.index(f.group)]
            classes[i] = ((n0 + n1) / (2 * max(n0, 1)), (n0 + n1) / (2 * max(n1, 1))) if f.balanced else (1.0, 1.0)
        at_zero = sums({i: np.zeros(dims) for i in range(len(fits))}, classes)
        passes = 2
    else:
        at_zero, classes, passes = dict(enumerate(start)), {i: (1.0, 1.0) for i in range(len(fits))}, 0
        dims = int(round((np.sqrt(4 * len(start[0]) - 3) - 1) / 2))
    blank = np.zeros(1 + dims + dims * dims)
    free = np.r_[np.ones(dims - 1), 0.0]  # the intercept is not penalised
    weights = {i: np.zeros(dims) for i in range(len(fits))}
    before, last, found = {i: np.inf for i in weights}, dict(weights), dict(at_zero)
    open_ = set(weights)
    while open_:
        asked = {}
        for i in sorted(open_):
            f, held = fits[i], found.get(i, blank)
            w = weights[i]
            value = f.c * held[0] + 0.5 * (free * w) @ w
            if value > before[i] + 1e-10 * abs(before[i]):  # too long a step
                weights[i] = (w + last[i]) / 2
                asked[i] = weights[i]
                if np.abs(weights[i] - last[i]).max() < 1e-15:
                    open_.discard(i)
                continue
            grad = f.c * held[1:1 + dims] + free * w
            curve = f.c * held[1 + dims:].reshape(dims, dims) + np.diag(free + 1e-12)
            if f.within is not None:
                left = np.eye(dims)
                left[:-1, :-1] = f.within
                grad, curve = left @ grad, left @ curve @ left + (np.eye(dims) - left)
            if np.abs(grad).max() <= tol * max(1.0, f.c * held[0] / dims):
                open_.discard(i)
                continue
            move = np.linalg.lstsq(curve, grad, rcond=1e-12)[0]
            if f.within is not None:
                move = left @ move
            before[i], last[i] = value, w
            weights[i] = w - move
            if grad @ move <= 1e-15 * max(1.0, abs(value)):  # the step changes the loss by less than its rounding
                open_.discard(i)
            asked[i] = weights[i]
        if not open_ or passes >= max_passes:
            if open_:
                warnings.warn(f"{len(open_)} logistic fits have not converged after {passes} passes", stacklevel=2)
            break
        found = sums({i: asked[i] for i in asked if i in open_}, classes)
        passes += 1
    return Fitted([weights[i][:-1] for i in range(len(fits))], [float(weights[i][-1]) for i in range(len(fits))], passes, [at_zero.get(i, blank) for i in range(len(fits))])


def balanced_logistic(train: DataFrame, c: float, balanced: bool = True, max_iter: int = 5000) -> LogisticRegressionModel:
    """L2 logistic regression on (features, y) with inverse penalty ``c`` and optional class balancing.

    A summed loss with penalty |w|^2/2 equals Spark's mean loss with regParam = 1 / (c * sum of weights). Warns when
    ``max_iter`` ends the fit before the loss settles."""
    n = train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    total = sum(r["n"] for r in n)
    weight = F.lit(1.0)
    if balanced:
        for r in n:
            weight = F.when(F.col("y") == r["y"], total / (2.0 * r["n"])).otherwise(weight)
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (c * total),
                            standardization=False, maxIter=max_iter, tol=1e-8)
    model = lr.fit(train.withColumn("w", weight))
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"logistic fit has not converged after {max_iter} iterations", stacklevel=2)
    return model


def positive_probability(model: LogisticRegressionModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Scores from the coefficients alone: a fitted model holds its session, which no task can carry."""
    d = df.withColumn("_x", vector_to_array("features"))
    return linear_score(d, model.coefficients.toArray().tolist(), float(model.intercept), "_x", out).drop("_x")


def _xy(df: DataFrame, label: str = "label") -> DataFrame:
    extra = ["source"] if "source" in df.columns else []
    return df.select("name", "center", "label", array_to_vector("x").alias("features"), F.col(label).cast("double").alias("y"), *extra)


def with_folds(df: DataFrame, k: int, label: str = "y", key: str = "name", salt: str = "fold0", group: str | None = None) -> DataFrame:
    """Adds a fold: a hash split within the class. With ``group`` all rows of one group (copies of a source) share a
    fold; the class of a group is its largest label."""
    if group is None:
        return hash_index(df, [label], key, salt, "_i").withColumn("fold", F.pmod("_i", F.lit(k)).cast("int")).drop("_i")
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.max(label).alias("_l"))
    folds = hash_index(groups, ["_l"], "_g", salt, "_i").select("_g", F.pmod("_i", F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, F.col(group) == F.col("_g")).drop("_g")


def oof_many(xy: DataFrame, grid: list[float], k: int = 5, balanced: bool = True) -> DataFrame:
    """Out-of-fold probabilities for several C: (name, label, center, y, fold, scores), one score for each value of ``grid``. All folds and
    values of C are fitted in the same passes. Where ``xy`` has a column source, all rows of a source are in one fold."""
    d = with_folds(xy, k, group="source" if "source" in xy.columns else None)
    all_folds = F.lit((1 << k) - 1)
    d = cut_lineage(d.select("name", "label", "center", "y", "fold", vector_to_array("features").alias("x"),
                             all_folds.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("fold"))).cast("long").alias("use")))
    fitted = newton_logistic(d, [Fit(c, f, balanced) for c in grid for f in range(k)])
    w = np.array([np.r_[a, b] for a, b in zip(fitted.coefficients, fitted.intercepts)]).reshape(len(grid), k, -1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(x: pd.Series, fold: pd.Series) -> pd.Series:
        rows, own = np.stack(x.to_numpy()), w[:, fold.to_numpy()]
        margin = np.einsum("nd,cnd->nc", rows, own[:, :, :-1]) + own[:, :, -1].T
        return pd.Series(list(1.0 / (1.0 + np.exp(-margin))))

    return d.select("name", "label", "center", "y", "fold", score("x", "fold").alias("scores"))


def oof_scores(xy: DataFrame, c: float, k: int = 5, balanced: bool = True) -> DataFrame:
    """Out-of-fold probabilities (name, label, center, y, fold, score) for one C."""
    return oof_many(xy, [c], k, balanced).withColumn("score", F.element_at("scores", 1)).drop("scores")


def select_c(xy: DataFrame, grid: list[float], reps: int = 500, k: int = 5, seed: int = 12345) -> DataFrame:
    """Bootstrap median precision of out-of-fold scores per C, with the best one flagged. All C share the draws."""
    from pyspark.sql import Window
    names = [f"score_{i}" for i in range(len(grid))]
    d = cut_lineage(oof_many(xy, grid, k).select("name", "label", "center", *[F.element_at("scores", i + 1).alias(n) for i, n in enumerate(names)]))
    counts = cut_lineage(R.stratified_counts(d, reps, seed, values=names))  # every C reads it
    out = None
    for i, n in enumerate(names):
        m = R.replicate_metrics(counts, reps, score=n, bucket=f"bucket_{n}" if i else "bucket")
        row = m.agg(F.percentile("ppv", 0.5).alias("curve_median"), F.percentile("ppv", 0.025).alias("curve_lo"), F.percentile("ppv", 0.975).alias("curve_hi"))
        row = row.select(F.lit(float(grid[i])).alias("C"), "curve_median", "curve_lo", "curve_hi")
        out = row if out is None else out.unionByName(row)
    best = F.max_by("C", F.struct("curve_median", -F.col("C"))).over(Window.partitionBy())  # one row per C
    return out.withColumn("selected", F.col("C") == best)


def loco_scores(emb: DataFrame, train_center: str, eval_center: str, c: float, pools: list[str] | None = None,
                negatives: DataFrame | None = None) -> DataFrame:
    """Train on one center (plus optional unlabelled negatives), score the other."""
    train = emb.filter(F.col("center") == train_center)
    if negatives is not None:
        train = train.unionByName(negatives.withColumn("label", F.lit(0)).withColumn("center", F.lit("")).select(*train.columns))
    pipe = fit_pipe(train, pools)
    m = balanced_logistic(cut_lineage(_xy(pipe.transform(train))), c)
    s = positive_probability(m, _xy(pipe.transform(emb.filter(F.col("center") == eval_center))))
    return s.select("name", "label", "center", "score")


LEGS = [("center_1", "center_2"), ("center_2", "center_1")]


def loco_all(emb: DataFrame, c: float, pools: list[str] | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """Scores of both legs with a leg column."""
    out = None
    for a, b in LEGS:
        s = loco_scores(emb, a, b, c, pools, negatives).withColumn("leg", F.lit(f"{a}->{b}"))
        out = s if out is None else out.unionByName(s)
    return cut_lineage(out)


def loco_report(scores: DataFrame, target: float = 0.9) -> DataFrame:
    """Metrics per leg and pooled, with the mean and the worst leg precision."""
    from pyspark.sql import Window
    m = C.group_report(scores, "leg", target=target).select("leg", "n_pos", "n_neg", "ppv", "fpr_incl", "auroc", "auprc")
    leg = F.when(F.col("leg") != C.POOLED, F.col("ppv"))
    w = Window.partitionBy()  # one row per leg
    return m.withColumn("leg_mean", F.sum(leg).over(w) / F.count(leg).over(w)).withColumn("leg_worst", F.min(leg).over(w))


def center_auroc(x: DataFrame, k: int = 5) -> DataFrame:
    """Adversarial gate: out-of-fold AUROC of predicting the center from the final features."""
    extra = ["source"] if "source" in x.columns else []
    d = x.select("name", "label", "center", array_to_vector("x").alias("features"), (F.col("center") == "center_1").cast("double").alias("y"), *extra)
    o = oof_scores(d, 1.0, k).withColumn("is_c1", F.col("y").cast("int"))
    a = C.score_metrics(o, [], label="is_c1").select(F.col("auroc").alias("center_auroc"))
    return a.withColumn("verdict", F.when(F.col("center_auroc").isNull() | (F.col("center_auroc") <= 0.58), "PASS").otherwise("FAIL"))


@dataclass
class Ensemble:
    """Members (pipe, coefficients, intercept) and the 1-D calibration of their mean probability."""
    members: list[tuple[FeaturePipe, np.ndarray, float]]
    platt: tuple[float, float]

    def score(self, emb: DataFrame) -> DataFrame:
        long = None
        for pipe, w, b in self.members:
            s = linear_score(pipe.transform(emb), w.tolist(), b, "x").select("name", "label", "center", "score")
            long = s if long is None else long.unionByName(s)
        mean = ensemble_mean(long, ["name", "label", "center"], "score", "mean_prob")
        a, b = self.platt
        return mean.withColumn("score", sigmoid(F.lit(a) * F.col("mean_prob") + F.lit(b)))


    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line per member and one for the calibration; coefficients at full precision."""
        rows = [(i, json.dumps({"pools": p.pools, "mu": p.mu.tolist(), "sd": p.sd.tolist(), "w": w.tolist(), "b": b,
                                "whiten": None if p.whiten is None else [x.tolist() for x in p.whiten],
                                "directions": [d.tolist() for d in p.directions]})) for i, (p, w, b) in enumerate(self.members)]
        rows.append((-1, json.dumps({"platt": list(self.platt)})))
        spark.createDataFrame(rows, "member int, value string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        got = {r.member: json.loads(r.value) for r in spark.read.schema("member int, value string").json(path).collect()}  # a row per member
        members = []
        for i in sorted(k for k in got if k >= 0):
            m = got[i]
            whiten = None if m["whiten"] is None else tuple(np.array(x) for x in m["whiten"])
            pipe = FeaturePipe(m["pools"], np.array(m["mu"]), np.array(m["sd"]), whiten, [np.array(d) for d in m["directions"]])
            members.append((pipe, np.array(m["w"]), m["b"]))
        return Ensemble(members, tuple(got[-1]["platt"]))


def linear_score(df: DataFrame, coef: list[float], intercept: float, feats: str = "feats", out: str = "score") -> DataFrame:
    """sigmoid(w.x + b) with built-in array functions."""
    return df.withColumn(out, sigmoid(linear(coef, intercept, feats)))


def linear(coef: list[float], intercept: float, feats: str) -> Column:
    w = F.array(*[F.lit(float(v)) for v in coef])
    dot = F.aggregate(F.zip_with(F.transform(F.col(feats), lambda v: v.cast("double")), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return dot + F.lit(float(intercept))


def ship_ensemble(emb: DataFrame, members: list[tuple[list[str], float]], debias_k: int = 0, k: int = 5) -> Ensemble:
    """Fit every member on all rows and calibrate the mean of their out-of-fold probabilities."""
    fitted, oof = [], None
    for pools, c in members:
        pipe = fit_pipe(emb, pools, debias_k=debias_k)
        xy = cut_lineage(_xy(pipe.transform(emb)))
        o = oof_scores(xy, c, k).select("name", "y", "score")
        oof = o if oof is None else oof.unionByName(o)
        m = balanced_logistic(xy, c)
        fitted.append((pipe, m.coefficients.toArray(), float(m.intercept)))
    cal = ensemble_mean(oof, ["name", "y"], "score", "p").select(array_to_vector(F.array("p")).alias("features"), "y")
    m = balanced_logistic(cut_lineage(cal), 1e6, balanced=False)
    return Ensemble(fitted, (float(m.coefficients[0]), float(m.intercept)))


def concept_ceiling(values: DataFrame, subsets: dict[str, tuple[list[str], bool]]) -> DataFrame:
    """Logistic heads on concept values: AUROC and precision transfer both ways per concept subset. ``values`` has
    (name, label, center, value map, trust map); a subset may weight values by trust."""
    def features(names: list[str], weighted: bool) -> Column:
        return F.array(*[F.coalesce(F.col("value")[n], F.lit(0.0)) * (F.coalesce(F.col("trust")[n], F.lit(0.0)) if weighted else F.lit(1.0)) for n in names])

    # the maps are searched once, before the many passes of the fits
    values = cut_lineage(values.select("name", "label", "center", *[features(*s).alias(f"x{i}") for i, s in enumerate(subsets.values())]))
    long = None
    for i, tag in enumerate(subsets):
        d = _xy(values.withColumn("x", F.col(f"x{i}")))
        for a, _ in LEGS:
            m = balanced_logistic(d.filter(F.col("center") == a), 1.0)
            s = positive_probability(m, d).select(F.lit(tag).alias("subset"), F.lit(a).alias("fit"), "label", "center", "score")
            long = s if long is None else long.unionByName(s)
    long = cut_lineage(long)
    keys = ["subset", "fit"]
    t = C.threshold_transfer(long, keys).filter(F.col("source") == F.col("fit"))
    au = C.score_metrics(long.filter(F.col("center") != F.col("fit")), keys).select(*keys, "auroc")
    return t.join(au, keys).select("subset", "source", "target", "auroc", "ppv", "recall")


def ridge(train: DataFrame, alpha: float, label: str) -> tuple[list[float], float]:
    """Coefficients and intercept of a ridge regression on (features, label): summed squares plus alpha * |w|^2. Spark averages the squares and
    divides its penalty by the label's standard deviation, hence regParam = alpha * std / n."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    m = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0,
                         regParam=alpha * max(r["sd"] or 0.0, 1e-12) / max(r["n"], 1), standardization=False, solver="normal").fit(train)
    return m.coefficients.toArray().tolist(), float(m.intercept)


def residualize(emb: DataFrame, nuisance: list[str], source: str, target: str, held_out: Column | None = None) -> DataFrame:
    """Detector logits against their residual after removing predicted nuisance concepts: negative drift (KS),
    recall and FPR of the source threshold on the target, target AUROC; one row for raw, one for residual.

    ``emb`` has (name, label, center, feats, <nuisance columns>). With ``held_out`` every fit sees the other rows and
    the report covers the held-out ones; without it both see all rows."""
    emb = emb.withColumn("_held", F.lit(False) if held_out is None else held_out)
    fit_rows = ~F.col("_held")
    pipe = fit_pipe(emb.filter(fit_rows))
    x = pipe.transform(emb).withColumn("features", array_to_vector("x")).withColumn("y", F.col("label").cast("double"))
    x = cut_lineage(x.select("name", "label", "center", "features", "y", "x", "_held", *nuisance))
    det = balanced_logistic(x.filter(fit_rows & (F.col("center") == source)).select("features", "y"), 1.0)
    d = positive_probability(det, x, "p").withColumn("s", logit(F.col("p")))
    heads = [ridge(x.filter(fit_rows), 10.0, n) for n in nuisance]
    d = d.withColumn("nh", F.array(*[linear(w, b, "x") for w, b in heads]))
    d = cut_lineage(d.select("name", "label", "center", "s", "nh", "_held"))
    base = d.filter(fit_rows & (F.col("center") == source) & (F.col("label") == 0))
    expected = linear(*ridge(base.select(array_to_vector("nh").alias("features"), "s"), 1.0, "s"), "nh")
    sd = base.select(F.stddev_pop(F.col("s") - expected).alias("sd")).first()["sd"] + 1e-6
    r = d if held_out is None else d.filter("_held")
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("s").alias("score")),
                    F.struct(F.lit("residual").alias("kind"), ((F.col("s") - expected) / F.lit(sd)).alias("score")))
    v = cut_lineage(r.select("label", "center", F.explode(kinds).alias("_k")).select("label", "center", "_k.*"))
    ks = C.ks_two_sample(v.filter(F.col("label") == 0), "score", F.col("center") == source, ["kind"]).select("kind", "ks")
    t = C.threshold_transfer(v, ["kind"]).filter((F.col("source") == source) & (F.col("target") == target)).select("kind", "recall", "fpr")
    a = C.score_metrics(v.filter(F.col("center") == target), ["kind"]).select("kind", "auroc")
    return ks.join(t, "kind").join(a, "kind").select(F.lit(f"{source}->{target}").alias("leg"), "kind", "ks", "recall", "fpr", "auroc")


def encoder_gate(base: DataFrame, cand: DataFrame, c: float = 1.0, reps: int = 1000, seed: int = 12345) -> DataFrame:
    """Two feature sets, same head, same legs: bootstrap precision per leg, paired difference, verdict."""
    sa, sb = loco_all(base, c), loco_all(cand, c)
    joined = sa.join(sb.select("name", F.col("score").alias("score_cand")), "name")
    out = None
    for a, b in LEGS:
        leg = f"{a}->{b}"
        d = cut_lineage(joined.filter(F.col("leg") == leg))
        p = R.paired_bootstrap(d, "score_cand", "score", reps, seed, "curve").select("median_delta", "lo", "hi", "p_gt0")
        m0 = R.bootstrap(d, reps, seed).select(F.col("curve_median").alias("base_median"))
        m1 = R.bootstrap(d.withColumn("score", F.col("score_cand")), reps, seed).select(F.col("curve_median").alias("cand_median"))
        row = p.crossJoin(m0).crossJoin(m1).withColumn("leg", F.lit(leg))  # one row each
        out = row if out is None else out.unionByName(row)
    from pyspark.sql import Window
    w = Window.partitionBy()  # two leg rows
    unclear = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    win = ((F.avg("cand_median").over(w) >= F.avg("base_median").over(w) - 0.005)
           & (F.min("cand_median").over(w) >= F.min("base_median").over(w) - 0.005) & (F.min("median_delta").over(w) >= 0))
    return out.withColumn("verdict", F.when(win, "PASS").when(F.min(unclear.cast("int")).over(w) == 1, "INCONCLUSIVE").otherwise("FAIL"))


def encoder_table(encoders: dict[str, DataFrame], c: float = 1.0, k: int = 5) -> DataFrame:
    """Encoders by regime (cross-validated, both legs): AUROC, strict FPR and implied precision."""
    from votelens.functions.scalars import ppv_from_fpr
    long = None
    for tag, emb in encoders.items():
        cv = oof_scores(_xy(fit_pipe(emb).transform(emb)), c, k).select("name", "label", "score", F.lit("cv").alias("regime"))
        lo = loco_all(emb, c).select("name", "label", "score", F.concat(F.lit("loco "), "leg").alias("regime"))
        rows = cv.unionByName(lo).withColumn("encoder", F.lit(tag))
        long = rows if long is None else long.unionByName(rows)
    m = C.score_metrics(cut_lineage(long), ["encoder", "regime"])
    return m.select("encoder", "regime", "n_pos", "n_neg", "auroc", F.col("fpr_strict").alias("fpr"), ppv_from_fpr(F.col("fpr_strict")).alias("ppv"))


Reader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def batch_score(work: DataFrame, reader: Reader, schema: str, stored: DataFrame | None = None) -> DataFrame:
    """Run a user-supplied model over Arrow batches of the rows that have no stored score; views are averaged."""
    todo = gap_fill(work, stored, ["name"]) if stored is not None else work
    return ensemble_mean(todo.mapInPandas(reader, schema), ["name"], "score")


def linear_reader(coef: np.ndarray, intercept: float) -> Reader:
    """Demo model: linear head over the features and over their mirrored view."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["feats"].to_numpy()).astype(float)
            for view in (x, x[:, ::-1]):
                yield pd.DataFrame({"name": b["name"], "score": 1.0 / (1.0 + np.exp(-(view @ coef + intercept)))})
    return read


def value_maps(trusted: DataFrame, frames: DataFrame) -> DataFrame:
    """(name, label, center, value map, trust map) of labelled frames, at most 35 entries per map."""
    m = trusted.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("value"),
                                    F.map_from_entries(F.collect_list(F.struct("concept", "trust"))).alias("trust"))
    return m.join(frames.filter(F.col("label").isin(0, 1)).select("path", "name", "label", "center"), "path")


def fixed_coefficients(n: int) -> list[float]:
    return [((j * 37) % 11 - 5) / 50.0 for j in range(n)]


