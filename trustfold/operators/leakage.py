"""Leakage detectors over a Workflow; every finding is a risk (type, severity, description, n_affected, source).

Detectors read train and test rows by the ``role`` column of the joined data. Each feature check is one aggregate over
all features, not one job a feature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import epoch, written
from ..functions.metrics import correlation
from . import integrity
from .applicability import nearest

HARD, SOFT = "hard_violation", "soft_inflation"

# Names that suggest a target-derived column.
TARGET_NAMES = [
    "^outcome", "^target", "^label", "^y_", "_outcome$", "_target$", "_label$", "^future_", "_future$", "^next_", "_next$", "^result", "_result$",
    "_encoded$", "_mean_target$", "_target_mean$",
]
# Names of rank-like and of rolling columns.
RANK_NAMES = re.compile("rank|percentile|quantile|pct", re.I)
ROLLING_NAMES = re.compile("roll|rolling|window|moving|lag|lead|cumsum|cummax|cummin|cummean|ewm|ema|sma|diff_", re.I)


@dataclass(frozen=True)
class Risk:
    type: str
    severity: str
    description: str
    n_affected: int = 0
    source: str = "data"

    def fix(self) -> str:
        return FIXES.get(self.type, "Look for information that the evaluation uses twice")


FIXES = {
    "preprocessing_leak": "Fit the preprocessing on training rows only (assimilate does it)",
    "encoding_leak": "Fit categories, terms and target encodings on training rows only (assimilate does it)",
    "threshold_leak": "Choose the threshold on training or validation predictions (assimilate does it)",
    "index_overlap": "Make a new split without shared rows",
    "duplicate_rows": "Drop repeated rows, or keep them in one fold",
    "target_leakage_direct": "Drop features that are made from the target",
    "target_leakage_proxy": "Check that the feature was known before the target",
    "temporal_leak": "Split by time: train on the past, test on the future",
    "group_overlap": "Keep every group in one fold",
    "spatial_autocorrelation": "Use spatial blocks at least as wide as the range of dependence",
    "spatial_duplicate": "Keep rows of one place in one fold",
    "feature_engineering_leak": "Derive features from training rows only",
    "hpo_cv_bias": "Tune in an inner loop and evaluate in an outer one",
    "hpo_test_leak": "Tune without the test rows",
    "nested_cv_leak": "Draw inner folds from the outer training rows",
    "model_scope": "Fit the model again on the training rows only",
    "model_data_leak": "Fit the model again on the training rows only",
    "cv_scope": "Make folds of the training rows only",
    "cv_leak": "Make folds of the training rows only",
    "tune_on_full_data": "Tune on resamples of the training rows",
    "pipeline_postprocessing": "See that steps after the model do not read test rows",
}


@dataclass(frozen=True)
class Workflow:
    data: DataFrame
    split: DataFrame  # row_id, role
    target: str | None = None
    time: str | None = None
    group: str | None = None
    coords: tuple[str, str] | None = None
    block: str | None = None
    buffer: float | None = None
    preprocess: list = field(default_factory=list)
    thresholds: dict | None = None
    hpo: dict | None = None
    inner_folds: DataFrame | None = None

    def rows(self) -> DataFrame:
        return self.data.join(self.split.select("row_id", "role"), "row_id")

    def features(self) -> list[str]:
        kinds = ("int", "bigint", "float", "double")
        out = {self.target, self.time, self.group, self.block, "row_id", "role", *(self.coords or ())}
        return [c for c, t in self.data.dtypes if t in kinds and c not in out]


def target_names(columns: list[str], target: str) -> list[Risk]:
    hit = [c for c in columns if c != target and any(re.search(p, c, re.I) for p in TARGET_NAMES)]
    return [Risk("target_leakage_naming", SOFT, f"the name of {c} suggests that it is made from the target", source=c) for c in hit]


def categorical_target(rows: DataFrame, target: str, categories: list[str]) -> DataFrame:
    """feature, share of the target that its categories explain on training rows (1 is all), and leak.

    Numeric target: 1 - mean within variance / variance, leak above .99. Class target: 1 if every category has one
    class only, with two categories and classes at least.
    """
    numeric = dict(rows.dtypes)[target] in ("int", "bigint", "float", "double")
    train, out = rows.where("role = 'train'"), None
    for c in categories:
        if numeric:
            within = train.groupBy(c).agg(F.var_samp(target).alias("v")).agg(F.avg("v").alias("w"))
            got = within.join(train.agg(F.var_samp(target).alias("t"))).select(F.lit(c).alias("feature"), F.when(F.col("t") > 0, 1 - F.col("w") / F.col("t")).alias("explained"))
            got = got.withColumn("leak", F.coalesce(F.col("explained") > 0.99, F.lit(False)))
        else:
            classes = train.groupBy(c).agg(F.count_distinct(target).alias("n"), F.min(target).alias("a"))
            pure = classes.agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.count_distinct("a").alias("cols"))
            one = (F.col("n") == 1) & (F.col("rows") > 1) & (F.col("cols") > 1)
            got = pure.select(F.lit(c).alias("feature"), F.when(one, 1.0).otherwise(0.0).alias("explained"), F.coalesce(one, F.lit(False)).alias("leak"))
        out = got if out is None else out.unionByName(got)
    return out


def group_mean_target(rows: DataFrame, target: str, group: str, features: list[str]) -> DataFrame:
    """feature, r of the feature with the training mean of the target in its group (training rows); leak above .99."""
    train = rows.where("role = 'train'")
    means = written(train.groupBy(group).agg(F.avg(target).alias("__mean")))
    got = integrity.correlations(train.join(means, group), "__mean", features, None)
    return got.select("feature", "r", F.coalesce(F.abs("r") > 0.99, F.lit(False)).alias("leak"))


def standardised_on_all(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, overall and training mean and deviation, and leak: standard overall but not on the training rows."""
    aggs = []
    for f in features:
        t = F.when(F.col("role") == "train", F.col(f))
        aggs += [F.avg(f).alias(f"a_{f}"), F.stddev_samp(f).alias(f"b_{f}"), F.avg(t).alias(f"c_{f}"), F.stddev_samp(t).alias(f"d_{f}")]
    items = ", ".join(f"'{f}', a_{f}, b_{f}, c_{f}, d_{f}" for f in features)
    got = rows.agg(*aggs).selectExpr(f"stack({len(features)}, {items}) as (feature, mean, sd, train_mean, train_sd)")
    whole = (F.abs("mean") < 0.01) & (F.abs(F.col("sd") - 1) < 0.01)
    part = (F.abs("train_mean") > 0.05) | (F.abs(F.col("train_sd") - 1) > 0.05)
    return got.withColumn("leak", F.coalesce(whole & part, F.lit(False)))


def ranks_on_all(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature and leak of rank-like columns in [0, 1] or [0, 100] whose test range passes the training range by a tenth."""
    aggs = []
    for f in features:
        t, u = F.when(F.col("role") == "train", F.col(f)), F.when(F.col("role") == "test", F.col(f))
        aggs += [g(x).cast("double").alias(f"{n}_{f}") for n, g, x in (("a", F.min, F.col(f)), ("b", F.max, F.col(f)), ("c", F.min, t), ("d", F.max, t), ("e", F.min, u), ("g", F.max, u))]
        aggs.append(F.bool_and(F.col(f) == F.floor(f)).alias(f"h_{f}"))
    items = ", ".join(f"'{f}', a_{f}, b_{f}, c_{f}, d_{f}, e_{f}, g_{f}, h_{f}" for f in features)
    got = rows.agg(*aggs).selectExpr(f"stack({len(features)}, {items}) as (feature, a, b, c, d, e, g, h)")
    scaled = (F.col("a") >= 0) & ((F.col("b") <= 1) | (F.col("h") & (F.col("b") <= 100)))
    return got.select("feature", F.coalesce(scaled & ((F.col("g") > 1.1 * F.col("d")) | (F.col("e") < 0.9 * F.col("c"))), F.lit(False)).alias("leak"))


def bins_only_in_test(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, number of its values that only test rows have, of columns with 2 to 20 values that are fewer than a tenth of the rows."""
    out, n = None, rows.count()
    for f in features:
        by = rows.where(F.col(f).isNotNull()).groupBy(f).agg(F.count_if(F.col("role") == "train").alias("t"))
        got = by.agg(F.count("*").alias("k"), F.count_if(F.col("t") == 0).alias("n_only_test")).select(F.lit(f).alias("feature"), "k", "n_only_test")
        out = got if out is None else out.unionByName(got)
    binned = F.col("k").between(2, 20) & (F.col("k") < 0.1 * n)
    return out.select("feature", "k", "n_only_test", (binned & (F.col("n_only_test") > 0)).alias("leak"))


def lagged_targets(rows: DataFrame, target: str, features: list[str], order: str, lags: int = 5) -> DataFrame:
    """feature, lag, r with the target ``lag`` rows before in time order; leak above .99."""
    from ..functions.common import global_position
    from .diagnosis import lagged

    kind = dict(rows.dtypes)[order]
    placed = written(global_position(rows.withColumn("__t", epoch(F.col(order), kind)), "__t", "row_id"))
    lags = max(1, min(lags, placed.count() // 10))
    shifted = lagged(placed.select("pos", F.col(target).cast("double").alias("v")), lags).drop("v")
    both, out = placed.join(shifted, "pos"), None
    for k in range(1, lags + 1):
        got = integrity.correlations(both, f"l_{k}", features, None).select("feature", F.lit(k).alias("lag"), "r", F.coalesce(F.abs("r") > 0.99, F.lit(False)).alias("leak"))
        out = got if out is None else out.unionByName(got)
    return out


def rolling_features(rows: DataFrame, features: list[str], time: str) -> list[Risk]:
    """Columns that look rolling and run on over the split: small steps at the boundary, or leading nulls under a rolling name."""
    kind = dict(rows.dtypes)[time]
    timed = written(rows.withColumn("__t", epoch(F.col(time), kind)))
    first = timed.where("role = 'test'").agg(F.min("__t")).first()[0]
    if first is None:
        return []
    before = timed.where((F.col("role") == "train") & (F.col("__t") < first)).orderBy(F.col("__t").desc(), F.col("row_id").desc()).limit(3).collect()[::-1]
    after = timed.where(F.col("role") == "test").orderBy("__t", "row_id").limit(3).collect()
    lead = timed.orderBy("__t", "row_id").limit(1).collect()
    out = []
    from ..functions.common import global_position
    from .diagnosis import lagged

    placed = written(global_position(timed, "__t", "row_id"))
    for f in features:
        steps = lagged(placed.select("pos", F.col(f).cast("double").alias("v")), 1)
        spread = steps.agg(F.stddev_samp(F.col("v") - F.col("l_1"))).first()[0]
        edge = [r[f] for r in [*before, *after]]
        named, nulls = bool(ROLLING_NAMES.search(f)), bool(lead) and lead[0][f] is None
        if (named or nulls) and None not in edge and len(edge) > 3 and spread:
            d = [b - a for a, b in zip(edge, edge[1:])]
            m = sum(d) / len(d)
            if (sum((x - m) ** 2 for x in d) / (len(d) - 1)) ** 0.5 / spread < 0.3:
                out.append(Risk("rolling_feature_leak", SOFT, f"{f} runs smoothly from training into test rows", source=f))
                continue
        if named and nulls:
            out.append(Risk("rolling_feature_leak", SOFT, f"{f} is a rolling column computed over all rows", source=f))
    return out


def threshold_rules(thresholds: dict | None, n_test: int = 0) -> list[Risk]:
    t, out = thresholds or {}, []
    if t.get("optimized_on") in ("test", "full"):
        out.append(f"the threshold was chosen on {t['optimized_on']} data")
    if t.get("selection_method") in ("youden", "f1_max", "roc_optimal") and t.get("used_test_predictions"):
        out.append(f"{t['selection_method']} used test predictions")
    if t.get("adjusted_after_test"):
        out.append("the threshold was changed after the test")
    return [Risk("threshold_leak", HARD, d, n_test, "thresholds") for d in out]


def tuning_rules(hpo: dict | None, n_train: int = 0, n_test: int = 0) -> list[Risk]:
    h, out = hpo or {}, []
    add = lambda type_, severity, text: out.append(Risk(type_, severity, text, n_test if severity == HARD else 0, "hpo"))
    if h.get("used_test_data"):
        add("hpo_test_leak", HARD, "tuning used test rows")
    if h.get("model_selected_on") in ("test", "full"):
        add("hpo_selection_leak", HARD, f"the model was selected on {h['model_selected_on']} data")
    if h.get("cv_type") == "simple" and not h.get("nested"):
        add("hpo_cv_bias", SOFT, "tuning and evaluation share one loop of folds")
    if (h.get("n_configurations") or 0) > n_train:
        add("hpo_overfit_risk", SOFT, f"{h['n_configurations']} configurations for {n_train} training rows")
    if (h.get("feature_selection") or {}).get("used_full_data"):
        add("hpo_feature_leak", HARD, "features were selected on all rows")
    if (h.get("early_stopping") or {}).get("used_test_data"):
        add("hpo_early_stopping_leak", HARD, "early stopping watched the test rows")
    return out


def spatial_rules(rows: DataFrame, x: str, y: str, block: str | None = None, buffer: float | None = None) -> list[Risk]:
    """Test rows much nearer to the training rows than these are to each other; shared blocks; rows within the buffer.

    All training rows count; nearest ones come by cells (see applicability.nearest).
    """
    out = []
    train = rows.where("role = 'train'").select("row_id", x, y).dropna()
    test = rows.where("role = 'test'").select("row_id", x, y).dropna()
    if len(train.take(2)) == 2 and not test.isEmpty():
        median = nearest(train, train, [x, y]).agg(F.median("d")).first()[0]
        at = lambda share: F.count_if(F.col("d") < F.lit(share * median))
        n_test, close, same = nearest(test, train, [x, y]).agg(F.count("*"), at(0.5), at(0.01)).first()
        if close > 0.3 * n_test:
            out.append(Risk("spatial_autocorrelation", SOFT, f"{close} of {n_test} test rows are closer to training rows than half their median spacing", close))
        if same:
            out.append(Risk("spatial_duplicate", HARD, f"{same} test rows lie on training rows", same))
    if block and (n := integrity.group_overlap(rows, block).count()):
        out.append(Risk("spatial_block_leak", HARD, f"{n} blocks are in train and test", n, block))
    if buffer:
        n = integrity.within_radius(test, train, buffer, x=x, y=y).select("a").distinct().count()
        if n:
            out.append(Risk("spatial_buffer_violation", SOFT, f"{n} test rows are within {buffer} of a training row", n))
    return out


def validate(w: Workflow, strict: bool = False) -> list[Risk]:
    """All detectors in order. strict: raise on a hard risk."""
    train, test = w.split.where("role = 'train'"), w.split.where("role = 'test'")
    n_train, n_test = train.count(), test.count()
    out: list[Risk] = []
    if n := integrity.index_overlap(train, test).count():
        out.append(Risk("index_overlap", HARD, f"{n} rows are in train and test", n, "split"))
    if n := integrity.index_bounds(w.split, w.data).count():
        out.append(Risk("invalid_indices", HARD, f"{n} rows of the split are not in the data", n, "split"))
        return out
    rows = written(w.rows())
    if n := integrity.duplicate_rows(rows).count():
        out.append(Risk("duplicate_rows", HARD, f"{n} test rows equal a training row", n))
    features = w.features()
    if w.target:
        if features:
            for r in integrity.correlation_leaks(rows, w.target, features).collect() if dict(rows.dtypes)[w.target] != "string" else []:
                out.append(Risk(r.type, r.severity, f"{r.feature} has correlation {r.r:.3f} with the target", source=r.feature))
        out += target_names(w.data.columns, w.target)
        categories = [c for c, t in w.data.dtypes if t == "string" and c not in (w.target, w.group)]
        if categories:
            out += [Risk("target_leakage_categorical", HARD, f"the categories of {r.feature} give the target away", source=r.feature) for r in categorical_target(rows, w.target, categories).where("leak").collect()]
        if w.group and features and dict(rows.dtypes)[w.target] != "string":
            out += [Risk("target_leakage_group_mean", HARD, f"{r.feature} is the group's mean target", source=r.feature) for r in group_mean_target(rows, w.target, w.group, features).where("leak").collect()]
    if w.group and (n := integrity.group_overlap(rows, w.group).count()):
        out.append(Risk("group_overlap", HARD, f"{n} groups are in train and test", n, w.group))
    if w.time:
        late, _ = integrity.temporal_order(rows, w.time)
        if n := late.count():
            out.append(Risk("temporal_leak", SOFT, f"{n} test rows lie before the last training time", n, w.time))
    if features:
        out += [Risk("feature_engineering_leak", HARD, f"{r.feature} was standardised over all rows", source=r.feature) for r in standardised_on_all(rows, features).where("leak").collect()]
        ranked = [f for f in features if RANK_NAMES.search(f)]
        if ranked:
            out += [Risk("feature_engineering_rank", SOFT, f"{r.feature} ranks over all rows", source=r.feature) for r in ranks_on_all(rows, ranked).where("leak").collect()]
        out += [Risk("feature_engineering_binning", SOFT, f"{r.feature} has {r.n_only_test} values in test rows only", source=r.feature) for r in bins_only_in_test(rows, features).where("leak").collect()]
        if w.target and w.time and dict(rows.dtypes)[w.target] != "string":
            out += [Risk("feature_engineering_lag", SOFT, f"{r.feature} is the target {r.lag} rows before", source=r.feature) for r in lagged_targets(rows, w.target, features, w.time).where("leak").collect()]
        if w.time:
            out += rolling_features(rows, features, w.time)
    out += threshold_rules(w.thresholds, n_test)
    if w.coords:
        out += spatial_rules(rows, *w.coords, w.block, w.buffer)
        if n := integrity.spatial_proximity(rows, *w.coords).count():
            out.append(Risk("spatial_proximity", SOFT, f"{n} test rows are very near to training rows", n))
        share = integrity.spatial_overlap(rows, *w.coords)
        if share is not None and share > 0.5:
            out.append(Risk("spatial_overlap", SOFT, f"{share:.0%} of test rows lie within the training rows' hull"))
    out += tuning_rules(w.hpo, n_train, n_test)
    if w.inner_folds is not None:
        n = integrity.index_overlap(test, w.inner_folds).count()
        if n:
            out.append(Risk("nested_cv_leak", HARD, f"{n} outer test rows are in inner folds", n, "inner_folds"))
    for stage in w.preprocess:
        out += inspect_stage(stage, rows)
    if strict and any(r.severity == HARD for r in out):
        raise integrity.HardViolation("; ".join(r.description for r in out if r.severity == HARD))
    return out


#: What a fitted stage has learnt, as numbers, by its class; PCA's axes have no sign.
STAGE_NUMBERS = {
    "StandardScalerModel": lambda s: [s.mean.toArray(), s.std.toArray()],
    "MinMaxScalerModel": lambda s: [s.originalMin.toArray(), s.originalMax.toArray()],
    "MaxAbsScalerModel": lambda s: [s.maxAbs.toArray()],
    "RobustScalerModel": lambda s: [s.median.toArray(), s.range.toArray()],
    "ImputerModel": lambda s: [[float(v) for v in s.surrogateDF.first()]],
    "PCAModel": lambda s: [abs(s.pc.toArray())],
    "IDFModel": lambda s: [s.idf.toArray()],
}
#: And as names: categories and terms that are known to it.
STAGE_NAMES = {
    "StringIndexerModel": lambda s: [set(names) for names in s.labelsArray],
    "CountVectorizerModel": lambda s: [set(s.vocabulary)],
}
#: Stages whose numbers stay in the JVM are compared by what they make of the training rows.
STAGE_OUTPUTS = ("TargetEncoderModel",)


def _columns_of(stage, side: str) -> list[str]:
    """The columns that a stage reads (input) or makes (output), one or several."""
    set_to = lambda p: stage.getOrDefault(p) if stage.hasParam(p) and stage.isSet(p) else None
    return list(set_to(f"{side}Cols") or ([set_to(f"{side}Col")] if set_to(f"{side}Col") else []))


def _refit(stage, train: DataFrame):
    """The estimator of a fitted stage with its parameters, fitted on ``train``; None if that lacks its inputs."""
    from pyspark.ml import feature

    maker = getattr(feature, type(stage).__name__.removesuffix("Model"))()
    stage._copyValues(maker)
    inputs, outputs = _columns_of(stage, "input"), _columns_of(stage, "output")
    if any(c not in train.columns for c in inputs):
        return None
    return maker.fit(train.drop(*[c for c in outputs if c in train.columns]))


def _differs(stage, again, train: DataFrame, tolerance: float) -> str | None:
    """What a stage has learnt otherwise than ``again``: values, names or encodings."""
    import numpy as np

    name = type(stage).__name__
    if name in STAGE_NUMBERS:
        for a, b in zip(STAGE_NUMBERS[name](stage), STAGE_NUMBERS[name](again)):
            a, b = np.asarray(a, float), np.asarray(b, float)
            if a.shape != b.shape:
                return "values"
            scale = float(np.abs(a).max(initial=0.0))
            if float(np.abs(a - b).max(initial=0.0)) > (0.01 if name == "PCAModel" else tolerance * scale if scale else tolerance):
                return "values"
    elif name in STAGE_NAMES:
        if STAGE_NAMES[name](stage) != STAGE_NAMES[name](again):
            return "names"
    else:
        outputs = _columns_of(stage, "output")
        clean = train.drop(*[c for c in outputs if c in train.columns])
        both = again.transform(stage.transform(clean).withColumnsRenamed({c: f"__{c}" for c in outputs}))
        gap = F.greatest(*[F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")), F.lit(0.0)) for c in outputs], F.lit(0.0))
        if (both.agg(F.max(gap)).first()[0] or 0.0) > tolerance:
            return "encodings"
    return None


def inspect_stage(stage, rows: DataFrame, tolerance: float = 1e-10) -> list[Risk]:
    """A fitted Spark ML scaler, imputer, PCA, term weighting or encoder against one fitted on the training rows; pipelines are walked.

    Numbers of the data's scale give ``preprocessing_leak``, categories, terms and target encodings ``encoding_leak``. Other stages, and
    stages whose inputs the rows lack, are not judged.
    """
    name = type(stage).__name__
    if name == "PipelineModel":
        return [r for s in stage.stages for r in inspect_stage(s, rows)]
    if name not in STAGE_NUMBERS and name not in STAGE_NAMES and name not in STAGE_OUTPUTS:
        return []
    train = rows.where("role = 'train'")
    again = _refit(stage, train)
    what = _differs(stage, again, train, tolerance) if again is not None else None
    if not what:
        return []
    kind = "preprocessing_leak" if what == "values" else "encoding_leak"
    return [Risk(kind, HARD, f"{name} was not fitted on the training rows: other {what}", rows.where("role <> 'train'").count(), name)]


def assimilate(w: Workflow) -> tuple[Workflow, list[Risk], list[Risk]]:
    """Refit leaky preprocessing and encodings on the training rows and drop leaky thresholds. Returns the workflow, what was fixed and what is left."""
    found = validate(w)
    fixed = [r for r in found if r.type in ("preprocessing_leak", "encoding_leak", "threshold_leak")]
    stages = []
    rows = w.rows()
    for s in w.preprocess:
        stages.append(_refit(s, rows.where("role = 'train'")) if inspect_stage(s, rows) else s)
    better = replace(w, preprocess=stages, thresholds={**(w.thresholds or {}), "optimized_on": "train", "used_test_predictions": False, "adjusted_after_test": False} if w.thresholds else None)
    return better, fixed, [r for r in found if r not in fixed]


def youden_threshold(predictions: DataFrame, actual: str, score: str, most: int = 101) -> DataFrame:
    """One row: the score quantile (at most ``most`` of them) with the largest sensitivity + specificity - 1, and that value."""
    cuts = sorted(set(predictions.agg(F.percentile(score, [k / (most - 1) for k in range(most)])).first()[0]))
    pos, neg = F.count_if(F.col(actual) == 1), F.count_if(F.col(actual) == 0)
    j = [F.struct((F.count_if((F.col(actual) == 1) & (F.col(score) >= c)) / pos + F.count_if((F.col(actual) == 0) & (F.col(score) < c)) / neg - 1).alias("j"), F.lit(-float(c)).alias("c")) for c in cuts]
    return predictions.agg(F.array_max(F.array(*j)).alias("best")).select((-F.col("best.c")).alias("threshold"), F.col("best.j").alias("j"))


def audit_predictions(predictions: DataFrame, split: DataFrame, actual: str = "actual", predicted: str = "prediction", model_risks: list[Risk] = ()) -> list[Risk]:
    """predictions(row_id, actual, prediction) of test rows: counts, perfect fits, predictions of training rows, and hard risks of their model."""
    out = []
    if n_hard := sum(r.severity == HARD for r in model_risks):
        out.append(Risk("model_leakage", HARD, f"the model behind the predictions has {n_hard} hard risks", 0, "model"))
    joined = predictions.join(split.select("row_id", "role"), "row_id", "left")
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    r = joined.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "train").alias("train"), correlation(F.when(p.isNotNull(), a), F.when(a.isNotNull(), p)).alias("r"), F.max(F.abs(a - p)).alias("gap"), F.avg((F.round(a) == F.round(p)).cast("double")).alias("acc"), F.count_distinct(a).alias("values")).first()
    n_test, n_all = split.where("role = 'test'").count(), split.count()
    if r.n != n_test:
        kind = "full_data_prediction" if r.n == n_all else "prediction_count_mismatch"
        out.append(Risk(kind, HARD if kind.startswith("full") else SOFT, f"{r.n} predictions for {n_test} test rows", r.n, "predictions"))
    if r.n >= 3 and r.r is not None and abs(r.r) > 0.999:
        out.append(Risk("perfect_prediction", HARD, f"correlation {r.r:.4f} with the actual values", r.n, "predictions"))
    if r.n > 5 and r.gap is not None and r.gap < 1e-10:
        out.append(Risk("exact_predictions", HARD, "all predictions are exact", r.n, "predictions"))
    if r.n > 20 and r.values <= 20 and r.acc > 0.99:
        out.append(Risk("suspiciously_high_accuracy", SOFT, f"accuracy {r.acc:.3f}", r.n, "predictions"))
    if r.train:
        out.append(Risk("wrong_prediction_set", HARD, f"{r.train} predictions are of training rows", r.train, "predictions"))
    return out


def fold_leaks(folds: DataFrame, split: DataFrame) -> DataFrame:
    """folds(fold, row_id, role) against the outer split: fold, n_test_leaked, n_not_train."""
    outer = split.select("row_id", F.col("role").alias("outer"))
    return folds.where("role = 'train'").join(outer, "row_id", "left").groupBy("fold").agg(F.count_if(F.col("outer") == "test").alias("n_test_leaked"), F.count_if(F.coalesce(F.col("outer"), F.lit("")) != "train").alias("n_not_train"))


def audit_importance(importances: dict[str, float], n_rows: int, n_train: int, on_test: bool = False, permutation: bool = False, leaked_model: bool = False) -> list[Risk]:
    out, v = [], list(importances.values())
    if n_rows > n_train:
        out.append(Risk("importance_on_full_data", HARD, f"importance over {n_rows} rows, {n_train} of them training rows", n_rows - n_train, "importance"))
    elif n_rows < n_train:
        out.append(Risk("importance_data_size_mismatch", SOFT, f"importance over {n_rows} of {n_train} training rows", 0, "importance"))
    if on_test:
        out.append(Risk("permutation_on_test_data" if permutation else "shap_on_test_data", SOFT, "importance was computed on test rows", 0, "importance"))
    if leaked_model:
        out.append(Risk("importance_from_leaked_model", HARD, "the model itself leaks", 0, "importance"))
    if len(v) > 1 and max(v) > min(v):
        m = sum(v) / len(v)
        if (sum((x - m) ** 2 for x in v) / (len(v) - 1)) ** 0.5 / max(abs(max(v)), abs(min(v))) < 0.05:
            out.append(Risk("uniform_importance", SOFT, "all features matter alike", 0, "importance"))
    if any(x < 0 for x in v):
        out.append(Risk("negative_importance", SOFT, "some features hurt", 0, "importance"))
    return out


def risk_rows(spark, risks: list[Risk]) -> DataFrame:
    return spark.createDataFrame([(r.type, r.severity, r.description, r.n_affected, r.source, r.fix()) for r in risks], "type string, severity string, description string, n_affected bigint, source string, fix string")
