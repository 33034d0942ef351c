"""A Markdown report of one run, from the few rows that its roll-ups have."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame

from ravenna.operators.metrics import K_VALUES


def shown(x: float | None, decimals: int = 4) -> str:
    return "—" if x is None or math.isnan(x) else f"{x:.{decimals}f}"


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows]] + [""]


def render_report(run_id: str, manifest: dict[str, Any], means: DataFrame, deltas: DataFrame, metrics: DataFrame, coverage: DataFrame | None = None, timings: DataFrame | None = None, encoding: DataFrame | None = None, primary: str = "ndcg@10", k_values=K_VALUES) -> str:
    """Means, mean seconds of each stage, query encoding, paired differences and blocked questions; a dash for what is missing."""
    columns = [primary, *(f"recall@{k}" for k in k_values)]
    covered = {r["config_id"]: r["mean_fraction"] for r in coverage.collect()} if coverage is not None else {}
    rows = sorted(means.collect(), key=lambda r: r["config_id"])
    out = [f"# Retrieval report: {run_id}", "", f"- Corpus: `{manifest.get('corpus_version')}`", f"- Settings: `{manifest.get('config_hash')}`", f"- Configurations: {len(rows)}", f"- Primary metric: **{primary}**", ""]
    out += ["## Means over evaluated questions", "", *_table(["config", *columns, "groups covered"], [[r["config_id"], *(shown(r[c] if c in means.columns else None) for c in columns), shown(covered.get(r["config_id"]))] for r in rows])]
    if timings is not None:
        took = {(r["config_id"], r["stage"]): r["mean_seconds"] for r in timings.collect()}
        stages = sorted({s for _, s in took})
        out += ["## Mean seconds of each stage", "", *_table(["config", *stages], [[r["config_id"], *(shown(took.get((r["config_id"], s)), 6) for s in stages)] for r in rows])]
    if encoding is not None:
        out += ["## Query encoding, shared by configurations", "", *_table(["embedding", "queries", "mean (s)", "total (s)"], [[r["embedding"], str(r["n"]), shown(r["mean_seconds"], 6), shown(r["total_seconds"], 6)] for r in sorted(encoding.collect(), key=lambda r: r["embedding"])])]
    out += ["## Paired differences on the same questions", "", *_table(["comparison", "A", "B", "n", f"delta {primary}"], [[r["label"], r["a"], r["b"], str(r["n"]), shown(r["mean_delta"])] for r in deltas.collect()])]
    blocked = sorted(f"{r['config_id']}:{r['question_id']}" for r in metrics.where("blocked").select("config_id", "question_id").collect())
    out += ["## Blocked questions", "", *([f"- {b} (no relevant chunk is annotated)" for b in blocked] or ["None."]), ""]
    return "\n".join(out)
