"""Diagnosis, folds, leakage detectors, evaluation and applicability."""
