"""Reports: text summaries, LaTeX tables, plot-data tables, Beamer decks. Driver-side formatting over small results."""

from __future__ import annotations

import fnmatch
import re
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import evaluate, routing, windows
from ..sources.sinks import write_table

# What LaTeX needs escaped.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape(text: object) -> str:
    return "".join(LATEX.get(c, c) for c in str(text))


def number(value: object, digits: int = 4) -> str:
    """A number for print; unknown and non-finite ones are a dash."""
    if value is None:
        return "-"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return f"{value:.{digits}f}" if value == value and abs(value) != float("inf") else "-"


def latex_table(rows: list[dict], columns: list[str], caption: str, label: str, digits: int = 4) -> str:
    body = [" & ".join(escape(number(r.get(c), digits)) for c in columns) + r" \\" for r in rows]
    head = " & ".join(escape(c) for c in columns) + r" \\"
    return "\n".join([r"\begin{table}[htbp]", r"\centering", rf"\caption{{{escape(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def rows_of(df: DataFrame) -> list[dict]:
    """All rows of a result table (a row for each split, cluster, lead day or run) as dicts."""
    return [r.asDict() for r in df.collect()]


def text_table(rows: list[dict], columns: list[str], digits: int = 4) -> str:
    cells = [columns] + [[number(r.get(c), digits) for c in columns] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths, strict=True)) for r in cells)


def evaluation_report(samples: DataFrame, actual: str = "y", predicted: str = "predicted", threshold: float = 1.0) -> str:
    """Overall, dry/rainy and per-cluster measures and the target's statistics, as text."""
    a, p = F.col(actual), F.col(predicted)
    overall = rows_of(samples.agg(F.count("*").alias("n"), *metrics.regression(a, p)))
    parts = rows_of(samples.agg(*metrics.dry_and_rainy(a, p, threshold)))
    stats = rows_of(samples.agg(F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"), F.min(a).alias("min"), F.max(a).alias("max")))
    out = ["EVALUATION REPORT", "=" * 72, "", "Overall", text_table(overall, list(overall[0])), "", f"Dry (< {threshold}) and rainy", text_table(parts, list(parts[0])), "", "Target", text_table(stats, list(stats[0]))]
    if "cluster" in samples.columns:
        rows = rows_of(metrics.by(samples, "cluster", actual=actual, predicted=predicted).orderBy("cluster"))
        if rows:
            out += ["", "By cluster", text_table(rows, list(rows[0]))]
    return "\n".join(out) + "\n"


def horizon_report(diagnostics: DataFrame) -> str:
    rows = rows_of(diagnostics.orderBy("split"))
    return "FORECAST HORIZON BEHAVIOUR\n" + "=" * 72 + "\n" + (text_table(rows, list(rows[0])) if rows else "no samples") + "\n"


def series(test: DataFrame, keys: tuple[str, ...], n: int = 1) -> DataFrame:
    """keys, part, position, after_gap, window_index, target_date, actual, predicted, residual in order of the windows.

    Axes: the date of the last lead day, or a position that shortens gaps; part: one of n stretches of equal length.
    """
    rows = windows.parts(windows.compressed_positions(test, keys=keys), n, keys=keys)
    date = F.element_at("date_by_lead", -1).alias("target_date")
    return rows.select(*keys, "part", "position", "after_gap", "window_index", date, F.col("y").alias("actual"), "predicted", (F.col("y") - F.col("predicted")).alias("residual")).orderBy(*keys, "window_index")


#: Tables of a row for each window or lead day.
ROW_TABLES = ("predictions", "lead_days", "test_series", "cluster_series")


def plot_tables(samples: DataFrame, history: DataFrame | None = None, selected: DataFrame | None = None, metric: str = "RMSE") -> dict[str, DataFrame]:
    """What figures would show, as tables by name. samples: station_id, split, window_index, cluster, current, y, predicted, y_by_lead, yhat_by_lead, date_by_lead."""
    test = samples.where("split = 'test'")
    lead = evaluate.lead_long(test, ["station_id", "window_index", "cluster"])
    found = {
        "predictions": test.select("station_id", "window_index", "cluster", F.col("y").alias("actual"), "predicted", (F.col("y") - F.col("predicted")).alias("residual")),
        "error_by_magnitude": evaluate.error_by_magnitude(test, actual="y"),
        "cluster_performance": metrics.by(test, "cluster", actual="y"),
        "cluster_histogram": evaluate.histogram(samples, ("cluster",)),
        "cluster_boxes": evaluate.box_summary(samples),
        "cluster_splits": evaluate.batch_statistics(samples),
        "lead_days": lead,
        "lead_day_metrics": metrics.by(lead, "lead_day"),
        "horizon_diagnostics": evaluate.horizon_diagnostics(samples),
        "scatter_limits": evaluate.scatter_limits(test, "y", "predicted"),
        "test_series": series(test, ("station_id",), 4),
        "cluster_series": series(test, ("station_id", "cluster")),
        "lead_day_limits": lead.groupBy("lead_day").agg(F.least(F.min("actual"), F.min("predicted")).alias("low"), F.greatest(F.max("actual"), F.max("predicted")).alias("high")),
    }
    if history is not None:
        found["training_history"] = history
    if selected is not None:
        found |= {"oracle_metric_summary": routing.metric_summary(selected), "oracle_transfer_matrix": routing.transfer_matrix(selected, metric), "oracle_clusters": routing.cluster_summary(selected, metric), "oracle_pairs": routing.pair_summary(selected, metric)}
    return found


def save_run(folder: str, samples: DataFrame, history: DataFrame | None = None, selected: DataFrame | None = None) -> dict:
    """Write a run's tables and return its row of the sweep: test measures by name."""
    for name, table in plot_tables(samples, history, selected).items():
        write_table(table, folder, name, summary=name not in ROW_TABLES)
    if selected is not None:
        # The same tables as if the oracle had routed every test window.
        routed = samples.where("split = 'test'").withColumn("idx", F.col("window_index"))
        best = routing.aligned(routed, selected, "RMSE").withColumn("predicted", F.coalesce("selected_prediction", "predicted"))
        best = best.withColumn("yhat_by_lead", F.concat(F.slice("yhat_by_lead", 1, F.size("yhat_by_lead") - 1), F.array("predicted")))
        for name in ("predictions", "error_by_magnitude", "cluster_performance", "scatter_limits", "test_series", "cluster_series"):
            write_table(plot_tables(best)[name], f"{folder}/oracle_model", name, summary=name not in ROW_TABLES)
    by_split = {r["split"]: r for r in rows_of(metrics.by(samples, "split", actual="y"))}
    return {f"{s}_{m}": by_split[s][m] for s in ("train", "val", "test") if s in by_split for m in ("rmse", "mae", "r2")}


def document(title: str, sections: list[tuple[str, str]]) -> str:
    """A LaTeX article of titled sections whose bodies are LaTeX."""
    body = "\n\n".join(rf"\section{{{escape(t)}}}" + "\n" + b for t, b in sections)
    return "\n".join([r"\documentclass{article}", r"\usepackage{graphicx}", r"\begin{document}", rf"\title{{{escape(title)}}}", r"\maketitle", body, r"\end{document}", ""])


def compile_tex(path: Path) -> Path | None:
    """The PDF of a .tex file, if a LaTeX tool is installed; else None."""
    tool = next((t for t in ("latexmk", "pdflatex") if shutil.which(t)), None)
    if tool is None:
        return None
    command = [tool, "-pdf", "-interaction=nonstopmode", path.name] if tool == "latexmk" else [tool, "-interaction=nonstopmode", path.name]
    done = subprocess.run(command, cwd=path.parent, capture_output=True, timeout=300)
    return path.with_suffix(".pdf") if done.returncode == 0 else None


# Decks of a run's figures.

PLOT_TYPES = (".png", ".pdf", ".jpg", ".jpeg")


def humanized(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_\-]+", " ", name)).strip().capitalize()


def discover(folder: Path) -> list[Path]:
    return sorted(p for p in folder.rglob("*") if p.suffix.lower() in PLOT_TYPES)


def selected_plots(plots: list[Path], folder: Path, selectors: list[str]) -> list[Path]:
    """Plots matched by each selector in turn (exact path, glob, or part of the path), each once; all, without selectors."""
    if not selectors:
        return plots
    out: list[Path] = []
    for selector in selectors:
        names = {p: p.relative_to(folder).as_posix() for p in plots}
        hits = [p for p, n in names.items() if selector in (n, str(p), p.name)]
        hits = hits or [p for p, n in names.items() if any(c in selector for c in "*?[") and fnmatch.fnmatch(n, selector)]
        hits = hits or [p for p, n in names.items() if selector.lower() in n.lower()]
        if not hits:
            raise ValueError(f"no plot matches {selector!r}")
        out += [p for p in hits if p not in out]
    return out


def deck(title: str, folder: Path, selectors: list[str] | None = None) -> str:
    """A Beamer deck: an overview, then each folder's plots under a section slide."""
    plots = selected_plots(discover(folder), folder, selectors or [])
    groups: dict[str, list[Path]] = {}
    for p in plots:
        part = p.relative_to(folder).parts
        groups.setdefault(part[0] if len(part) > 1 else "Other", []).append(p)
    out = [r"\documentclass{beamer}", r"\usepackage{graphicx}", rf"\title{{{escape(title)}}}", r"\begin{document}", r"\frame{\titlepage}", r"\begin{frame}{Overview}\begin{itemize}"]
    out += [rf"\item {escape(humanized(g))}: {len(ps)}" for g, ps in groups.items()]
    out.append(r"\end{itemize}\end{frame}")
    for g, ps in groups.items():
        out.append(rf"\section{{{escape(humanized(g))}}}")
        out += [rf"\begin{{frame}}{{{escape(humanized(p.stem))}}}\centering\includegraphics[width=\textwidth,height=0.8\textheight,keepaspectratio]{{{p.relative_to(folder).as_posix()}}}\end{{frame}}" for p in ps]
    return "\n".join([*out, r"\end{document}", ""])
