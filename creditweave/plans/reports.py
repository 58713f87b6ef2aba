"""An evaluation as text and as Markdown. Only aggregates of a row each, a scenario, a strategy or a threshold reach the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions.money import format_inr
from . import evaluate


def by_scenario(judged: DataFrame, key: str = "scenario") -> DataFrame:
    """The breakdown of one key, the most payments first, then by name."""
    return evaluate.breakdown(judged).where(F.col(key).isNotNull()).orderBy(F.desc("total"), key)


def _share(part: float, whole: float, digits: int) -> str:
    return f"{part / whole:.{digits}%}" if whole else "-"


def _tables(judged: DataFrame, cfg: Scoring) -> tuple[Row, list[tuple[str, list[str], list[list[str]]]]]:
    """The headline row, and titled tables of text cells."""
    head = evaluate.report(judged).withColumns({f"{c}_shown": format_inr(F.col(f"{c}_paise")) for c in ("value", "auto_wrong_value")}).first()
    groups = []
    for key in ("scenario", "strategy"):
        rows = [[r[key], str(r["total"]), _share(r["auto_applied"], r["total"], 0), _share(r["auto_applied"] - r["auto_wrong"], r["auto_applied"], 1), _share(r["correct"], r["total"], 1)] for r in by_scenario(judged, key).collect()]
        groups.append((f"By {key}", [key, "payments", "applied", "precision", "accuracy"], rows))
    cuts = evaluate.sweep(judged, cfg).withColumn("shown", format_inr(F.col("auto_wrong_value_paise"))).orderBy("threshold").collect()
    rows = [[f"{r['threshold']:.2f}{' (now)' if abs(r['threshold'] - cfg.auto_apply) < 1e-9 else ''}", f"{r['auto_rate']:.1%}", f"{r['precision']:.2%}", str(r["auto_wrong"]), _share(r["review"], r["total"], 1), r["shown"]] for r in cuts]
    groups.append(("Thresholds", ["auto from", "applied", "precision", "errors", "review", "value at risk"], rows))
    worst = evaluate.worst_errors(judged.withColumn("shown", format_inr(F.col("amount_paise")))).collect()
    groups.append(("Costly errors", ["payment", "amount", "scenario", "strategy"], [[r["statement_ref"], r["shown"], r["scenario"], r["strategy"]] for r in worst]))
    return head, groups


def _headline(r: Row) -> Iterable[tuple[str, str]]:
    yield "payments judged", f"{r['total']} ({r['value_shown']})"
    yield "applied automatically", f"{_share(r['auto_applied'], r['total'], 1)} ({r['auto_applied']})"
    yield "precision of these", f"{_share(r['auto_applied'] - r['auto_wrong'], r['auto_applied'], 2)} ({r['auto_wrong']} wrong, {r['auto_wrong_value_shown']})"
    yield "sent for review", f"{_share(r['needs_review'], r['total'], 1)} ({r['review_correct']} of {r['needs_review']} right)"
    yield "left unapplied", f"{_share(r['unapplied'], r['total'], 1)} ({r['missed']} missed)"
    yield "accuracy", _share(r["correct"], r["total"], 1)
    if r["reason_scored"]:
        yield "deduction reasons", f"{_share(r['reason_correct'], r['reason_scored'], 1)} ({r['reason_correct']} of {r['reason_scored']})"


def as_text(judged: DataFrame, cfg: Scoring, title: str = "Evaluation") -> str:
    head, groups = _tables(judged, cfg)
    out = [title, "=" * len(title), "", *(f"{k:<24}{v}" for k, v in _headline(head))]
    for name, columns, rows in groups:
        if rows:
            wide = [max(len(x[i]) for x in [columns, *rows]) for i in range(len(columns))]
            out += ["", name, *("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(x, wide, strict=True))) for x in [columns, *rows])]
    return "\n".join(out) + "\n"


def as_markdown(judged: DataFrame, cfg: Scoring, title: str = "Evaluation") -> str:
    head, groups = _tables(judged, cfg)
    out = [f"# {title}", "", "| Measure | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in _headline(head))]
    for name, columns, rows in groups:
        if rows:
            out += ["", f"## {name}", "", *(f"| {' | '.join(x)} |" for x in [columns, ["---"] * len(columns), *rows])]
    return "\n".join(out) + "\n"
