"""Text reports of the batch jobs.  Each is small by its nature: at most 500 candidates, nine cells, one row of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = {"positive": "Pos", "neutral": "Neu", "negative": "Neg"}
TOP = 20


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates of a lexicon, tab-separated, best first, under two comment lines."""
    values = F.format_string(
        "%s\t%.2f\t%d\t%d\t%d\t%d\t%.4f", "stem", "score", "pos", "neg", "neu", F.col("pos") + F.col("neg") + F.col("neu"), "llr"
    )
    head = candidates.sparkSession.createDataFrame(
        [(-2, "# Lexicon expansion candidates"), (-1, "# stem\tscore\tpos_docs\tneg_docs\tneu_docs\ttotal_docs\tllr")], "rank int, value string"
    )
    head.union(candidates.select("rank", values.alias("value"))).coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)


def evaluation(matrix: DataFrame, metrics: DataFrame, candidates: DataFrame, lexicon_size: int) -> list[str]:
    """The lines of a report on a lexicon: confusion matrix (``jobs.confusion``), accuracy, ``jobs.class_metrics``, best candidates."""
    cells = {(r["actual"], r["predicted"]): r["n"] for r in matrix.collect()}
    rated = {r["class"]: r for r in metrics.collect()}
    sizes = {c: sum(cells.get((c, p), 0) for p in CLASSES) for c in CLASSES}
    total = sum(sizes.values())
    right = sum(cells.get((c, c), 0) for c in CLASSES)
    lines = [
        "Lexicon Evaluation Report", "=" * 25,
        f"Dataset: {total} reviews ({sizes['positive']} positive, {sizes['negative']} negative, {sizes['neutral']} neutral)",
        f"Lexicon: {lexicon_size} entries", "", "Confusion Matrix:", " " * 14 + "Predicted", " " * 14 + "Pos   Neu   Neg",
    ]
    for actual, short in CLASSES.items():
        label = "Actual " if actual == "positive" else " " * 7
        lines.append(f"{label}{short}    " + " ".join(f"{cells.get((actual, p), 0):5d}" for p in CLASSES))
    lines += ["", f"Accuracy: {100 * right / total if total else 0:.2f}%"]
    for name in ("positive", "negative", "neutral"):
        r = rated.get(name) or {"precision": 0.0, "recall": 0.0, "f1": 0.0}
        lines.append(f"{name.capitalize():8}: P={r['precision']:.2f} R={r['recall']:.2f} F1={r['f1']:.2f}")
    lines += ["", f"Top {TOP} candidates:", f"{'stem':<20} {'score':>6} {'pos':>6} {'neg':>6} {'llr':>10}"]
    for r in candidates.orderBy("rank").limit(TOP).collect():
        lines.append(f"{r['stem']:<20} {r['score']:6.2f} {r['pos']:6d} {r['neg']:6d} {r['llr']:10.4f}")
    return lines


def corpus_lines(totals: DataFrame, shares: DataFrame) -> list[str]:
    """The lines of a report on a corpus, from ``jobs.corpus_totals`` and ``jobs.token_type_shares``."""
    row = totals.first()
    labels = {
        "files": "Files scanned", "bytes": "Total bytes", "rebuilt": "Reconstruction OK", "not_rebuilt": "Reconstruction FAIL",
        "outliers": "Sentence outliers", "cyrillic": "Cyrillic files", "translit_rebuilt": "Translit recon OK", "translit_not_rebuilt": "Translit recon FAIL",
    }
    lines = [f"{label + ':':<24} {row[name]}" for name, label in labels.items()] + ["", "Token type distribution:"]
    return lines + [f"  {r['type'] + ':':<15} {r['n']}  ({r['percent']:.1f}%)" for r in shares.collect()]


def write_lines(spark, lines: list[str], path: str) -> None:
    """The lines of a report as one text file, in their order."""
    spark.createDataFrame(list(enumerate(lines)), "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
