"""Plain-text renderings of one-row or few-row results; only such results are brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

# How metrics are shown.
DISPLAY = {"ndcg": "NDCG", "recall": "Recall", "mrr": "MRR", "map": "MAP", "precision": "Precision", "hits": "Hits"}
MOST_ROWS = 200


def display_metric(metric: str) -> str:
    name, _, k = metric.partition("@")
    return f"{DISPLAY.get(name, name)}@{k}" if k else DISPLAY.get(name, name)


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return rows


def retrieval_report(means: DataFrame) -> str:
    """From metric, value, n_queries."""
    rows = sorted(_rows(means), key=lambda r: r.metric)
    head = f"Queries: {rows[0].n_queries if rows else 0}"
    return "\n".join([head, *(f"{display_metric(r.metric)}: {r.value:.4f}" for r in rows)])


def doc_level_report(diagnosis: DataFrame) -> str:
    r = _rows(diagnosis)[0]
    return f"Queries: {r.n_queries}\nexact: {r.exact_pct:.1%}\nsibling only: {r.sibling_only_pct:.1%}\nmiss: {r.miss_pct:.1%}\ndocument precision: {r.mean_doc_precision:.3f}"


def comparison_report(summary: DataFrame, a: str, b: str) -> str:
    """From metric, mean_a, mean_b, delta, win, loss, tie, and ci_low, ci_high, p where they are joined."""
    lines = [f"{a} -> {b}"]
    for r in sorted(_rows(summary), key=lambda r: r.metric):
        got = r.asDict()
        line = f"{display_metric(r.metric)}: {r.mean_a:.4f} -> {r.mean_b:.4f} ({r.delta:+.4f})"
        if "ci_low" in got:
            line += f" [{r.ci_low:+.4f}, {r.ci_high:+.4f}]"
        if "p" in got:
            line += f" p={r.p:.2g}"
        lines.append(f"{line} win {r.win:.1%} / loss {r.loss:.1%} / tie {r.tie:.1%}")
    return "\n".join(lines)


def table_report(df: DataFrame, title: str) -> str:
    """Any other small result: shares as percentages, other doubles to three digits."""
    lines = [title]
    for r in _rows(df):
        parts = []
        for name, value in r.asDict().items():
            if isinstance(value, float):
                value = f"{value:.1%}" if name.endswith("_pct") or "_pct_" in name or name.startswith("pct_") or name.endswith("loss") else f"{value:.3f}"
            parts.append(f"{name}: {value}")
        lines.append(", ".join(parts))
    return "\n".join(lines)
