"""Rules over methods texts: which evaluation mistakes does a description suggest? One pass, expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of the two contexts.
SPATIAL_WORDS = [
    "spatial", "geographic", "coordinates", "latitude", "longitude", "species distribution", "occurrence", "site", "location", "raster",
    "remote sensing", "gis", "utm", "epsg",
]
TEMPORAL_WORDS = ["time series", "temporal", "forecast", "year", "monthly", "daily", "panel data", "longitudinal", "date", "season"]

# Fixed values: (name, context or None for all, strict only, pattern, exception or None, severity).
RULES = [
    ("random_cv_spatial", "spatial", False, r"(?:random|stratified)\s+(?:\d+[- ]fold|k[- ]fold|cross[- ]validation)", r"spatial\s+(?:block|buffer|leave|blocked)", "high"),
    ("random_cv_temporal", "temporal", False, r"(?:random|stratified)\s+(?:\d+[- ]fold|k[- ]fold|cross[- ]validation)", r"temporal\s+(?:block|expanding|sliding|purged)", "high"),
    ("preprocess_before_split", None, False, r"(?:normali[sz]|standardi[sz]|pca|principal component|feature select|variable select)\w*\s+(?:before|prior to|then)\s+(?:split|fold|cross|train)", None, "high"),
    ("global_preprocessing", None, False, r"(?:all|entire|full|whole)\s+(?:data|dataset|sample)\s+(?:was|were)\s+(?:normali[sz]|standardi[sz]|scaled|transformed|reduced)", None, "high"),
    ("feature_selection_before_cv", None, False, r"(?:feature|variable|predictor)\s+(?:selection|screening|importance|ranking)\s+(?:was|were)\s+(?:performed|conducted|applied|computed)\s+(?:before|prior|outside|separately)", r"within|inside|each fold", "high"),
    ("no_spatial_blocking", "spatial", False, r"\d+[- ]fold\s+cross[- ]validation", r"spatial|block|buffer|leave.location|llo|knndm", "medium"),
    ("no_embargo", "temporal", False, r"temporal\s+(?:cross|cv|validation|split|block)", r"embargo|gap|buffer|purge", "medium"),
    ("single_holdout", None, True, r"(?:single|one)\s+(?:train|hold)[- ]?(?:out|test)\s+split", None, "low"),
    ("no_test_mentioned", None, True, r"model\s+(?:was|were)\s+(?:fitted|trained|built)\s+(?:on|using)\s+(?:the|all)\s+(?:data|available)", r"cross|validation|test|holdout|split", "medium"),
]

#: Words of which a text must hold one for the rule's pattern to match; a cheap look before the pattern is tried.
NEEDED = {
    "random_cv_spatial": [["random", "stratified"], ["fold", "cross"]],
    "random_cv_temporal": [["random", "stratified"], ["fold", "cross"]],
    "preprocess_before_split": [["before", "prior to", "then"], ["normali", "standardi", "pca", "principal component", "feature select", "variable select"]],
    "global_preprocessing": [["data", "sample"], ["normali", "standardi", "scaled", "transformed", "reduced"]],
    "feature_selection_before_cv": [["selection", "screening", "importance", "ranking"], ["before", "prior", "outside", "separately"]],
    "no_spatial_blocking": [["validation"], ["fold"]],
    "no_embargo": [["temporal"]],
    "single_holdout": [["split"], ["train", "hold"]],
    "no_test_mentioned": [["model"], ["fitted", "trained", "built"]],
}

ADVICE = {
    "random_cv_spatial": "Use spatial blocks, buffered leave-one-out or distance-matched folds.",
    "random_cv_temporal": "Use blocks of time with an embargo, or expanding or sliding windows.",
    "preprocess_before_split": "Fit preprocessing inside each fold.",
    "global_preprocessing": "Fit preprocessing on the training rows of each fold.",
    "feature_selection_before_cv": "Select features inside each fold.",
    "no_spatial_blocking": "Consider spatial blocks or buffers.",
    "no_embargo": "Leave a gap between training and test times.",
    "single_holdout": "Repeat the evaluation over several splits.",
    "no_test_mentioned": "Hold rows out, or cross-validate.",
}


def context_of(text: Column) -> Column:
    """spatial, temporal or general, from the keywords in the lower-cased text."""
    count = lambda words: reduce(Column.__add__, [F.contains(text, F.lit(w)).cast("int") for w in words])
    s, t = count(SPATIAL_WORDS), count(TEMPORAL_WORDS)
    return F.when((s >= 2) & (s > t), "spatial").when((t >= 2) & (t > s), "temporal").when((s >= 1) & (t >= 1), "spatial").otherwise("general")


def check_texts(texts: DataFrame, key: str, text: str = "text", context: str | None = None, strict: bool = False) -> DataFrame:
    """key, context, pattern, severity, matched_text (80 characters at most), recommendation: one row for each rule that a text trips.

    Null texts trip none.
    """
    low = texts.select(key, F.lower(text).alias("__low")).where("__low is not null")
    low = low.withColumn("context", F.lit(context) if context else context_of(F.col("__low")))
    hits = []
    for name, where, only_strict, pattern, exception, level in RULES:
        if only_strict and not strict:
            continue
        found = F.regexp_extract("__low", f"({pattern})", 1)
        # The cheap conditions first: what follows is tried only where they hold.
        any_of = lambda words: reduce(Column.__or__, [F.contains(F.col("__low"), F.lit(w)) for w in words])
        trips = reduce(Column.__and__, [any_of(words) for words in NEEDED[name]])
        if where:
            trips = (F.col("context") == where) & trips
        trips = trips & F.col("__low").rlike(pattern)
        if exception:
            trips = trips & ~F.col("__low").rlike(exception)
        hits.append(F.when(trips, F.struct(F.lit(name).alias("pattern"), F.lit(level).alias("severity"), F.substring(found, 1, 80).alias("matched_text"), F.lit(ADVICE[name]).alias("recommendation"))))
    return low.select(key, "context", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "context", "h.*")
