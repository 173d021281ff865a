"""Certificates, methods text and explanations. Everything here works on a few numbers on the driver."""

from __future__ import annotations

import base64
import html
import json
from dataclasses import asdict
from pathlib import Path

from ..functions.stats import format_p
from .diagnosis import Diagnosis
from .leakage import HARD, Risk

EXPLANATIONS = {
    "spatial": "Near places are alike, so random folds test a model on what it has all but seen.",
    "temporal": "Near times are alike, so random folds let a model learn from the future.",
    "index_overlap": "{n} rows are in train and test: their scores say nothing.",
    "duplicate_rows": "{n} test rows repeat training rows: a model may answer from memory.",
    "target": "A feature gives the target away; it would not be known when the model is used.",
    "preprocessing_leak": "Test rows took part in the preprocessing.",
    "encoding_leak": "Test rows took part in an encoding: it knows their categories, terms or targets.",
    "nested_cv_leak": "Tuning saw rows on which the model is judged.",
    "threshold_leak": "The threshold was fitted to the test rows.",
}


def explain(risks: list[Risk]) -> list[str]:
    """A sentence each, hard risks first."""
    out = []
    for r in sorted(risks, key=lambda r: r.severity != HARD):
        key = r.type if r.type in EXPLANATIONS else r.type.split("_")[0]
        out.append(f"{r.type}: {EXPLANATIONS.get(key, r.description).format(n=r.n_affected)} {r.fix()}.")
    return out


def methods_text(d: Diagnosis, folds: int = 5) -> str:
    parts = [f"Dependence among the {d.n} rows was diagnosed before evaluation."]
    if d.spatial.get("statistic") is not None and "p" in d.spatial:
        parts.append(f"Spatial autocorrelation was measured by Moran's I ({d.spatial['statistic']:.3f}, {format_p(d.spatial['p'])}).")
    if d.temporal.get("statistic") is not None and "p" in d.temporal:
        parts.append(f"The autocorrelation at lag one was {d.temporal['statistic']:.3f} (Ljung-Box {format_p(d.temporal['p'])}).")
    if d.clustered.get("statistic") is not None:
        parts.append(f"The intraclass correlation was {d.clustered['statistic']:.3f}.")
    if d.dependency == "none":
        parts.append("No dependence was found.")
    parts.append(f"Models were evaluated with {folds} folds of the strategy {d.recommended}.")
    if d.inflation:
        parts.append(f"Random folds would have been optimistic by about {d.inflation['auc_inflation']:.0%}.")
    return " ".join(parts)


def certificate(d: Diagnosis, risks: list[Risk] = ()) -> dict:
    return {
        "n": d.n, "dependency": d.dependency, "severity": d.severity, "recommended": d.recommended, "spatial": d.spatial, "temporal": d.temporal, "clustered": d.clustered, "inflation": d.inflation,
        "risks": [asdict(r) for r in risks], "valid": not any(r.severity == HARD for r in risks), "methods": methods_text(d),
    }


def to_yaml(value, indent: int = 0) -> str:
    pad = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}: {json.dumps(v)}\n" if not isinstance(v, (dict, list)) or not v else f"{pad}{k}:\n{to_yaml(v, indent + 1)}" for k, v in value.items())
    return "".join(f"{pad}- {json.dumps(v)}\n" if not isinstance(v, (dict, list)) or not v else f"{pad}-\n{to_yaml(v, indent + 1)}" for v in value)


def export(cert: dict, path: str) -> None:
    """The ending decides: .json, .yaml or .yml, .html."""
    kind = Path(path).suffix
    if kind == ".json":
        text = json.dumps(cert, indent=2)
    elif kind in (".yaml", ".yml"):
        text = to_yaml(cert)
    elif kind == ".html":
        text = to_html(cert)
    else:
        raise ValueError(f"unknown ending {kind!r}")
    Path(path).write_text(text)


def to_html(cert: dict, pictures: list[bytes] = ()) -> str:
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(json.dumps(v))}</td></tr>" for k, v in cert.items() if k != "methods")
    images = "".join(f'<img src="data:image/png;base64,{base64.b64encode(p).decode()}">' for p in pictures)
    return f"<!doctype html><meta charset='utf-8'><title>Evaluation report</title><p>{html.escape(cert.get('methods', ''))}</p><table>{rows}</table>{images}"
