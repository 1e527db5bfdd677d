"""Reports over small results: one nested summary, console text, an HTML page with the worst chunks. Only aggregates and a top list reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import quality

TOP_HTML, TOP_CONSOLE = 200, 5
LOW, MIDDLE = 50, 75


def summary_json(parents: DataFrame, children: DataFrame, structure: DataFrame) -> str:
    """The two summaries and the structure, one row each, as one JSON text."""
    one = lambda df: json.loads(df.toJSON().first())
    return json.dumps({"parent_summary": one(parents), "child_summary": one(children), "structure": one(structure)}, ensure_ascii=False, indent=2)


def console(summary: dict, title: str) -> str:
    """Plain text of one summary: totals, shares, statistics, top lists."""
    stats, scores = summary["length_stats"], summary["score_stats"]
    total = stats["count"]
    share = lambda n: f"{n} ({100 * n / total:.1f} %)" if total else str(n)
    lines = [f"== {title} ==", f"chunks: {total}", f"issues: {summary['errors']} errors, {summary['warnings']} warnings", f"chunks with errors: {share(summary['chunks_with_error'])}"]
    if total:
        lines += [f"length: {stats['min']} to {stats['max']}, mean {stats['mean']}, median {stats['median']}", f"score: {scores['min']} to {scores['max']}, mean {scores['mean']}"]
    lines += [f"  {k}: {share(n)}" for k, n in sorted(summary["quality_dist"].items())]
    lines += [f"  {x['key']}: {x['count']}" for x in summary["top_issues"]]
    return "\n".join(lines)


def console_details(found: DataFrame, order: str, structure: dict, pairs: DataFrame) -> str:
    """Plain text below a summary: the worst chunks, the structure's figures, and the pairs that overlap most (``overlap`` and their keys)."""
    lines = [f"== worst {TOP_CONSOLE} =="]
    for r in quality.worst(found, TOP_CONSOLE, order).select(order, "score", "quality_label", "issues").collect():
        lines.append(f"  {r[order]}: {r['score']} {r['quality_label']} ({', '.join(f'{i.severity}:{i.code}' for i in r['issues'])})")
    lines += ["== structure ==", *(f"  {k}: {v}" for k, v in structure.items()), "== pairs =="]
    keys = [c for c in pairs.columns if c != "overlap"]
    for r in pairs.orderBy(F.desc("overlap"), *keys).limit(TOP_CONSOLE).collect():
        lines.append(f"  {', '.join(f'{k} {r[k]}' for k in keys)}: {100 * r['overlap']:.0f} %")
    return "\n".join(lines)


def html_report(parents: DataFrame, children: DataFrame, order: str, cards: dict[str, object]) -> str:
    """Cards and the worst chunks of both kinds; rows are coloured by score."""

    def rows(found: DataFrame) -> str:
        out = []
        for r in quality.worst(found, TOP_HTML, order).select(order, "score", "quality_label", "length", "issues").collect():
            colour = "#f8d7da" if r["score"] < LOW else "#fff3cd" if r["score"] < MIDDLE else "#ffffff"
            codes = html.escape(", ".join(f"{i.severity}:{i.code}" for i in r["issues"]))
            out.append(f'<tr style="background:{colour}"><td>{html.escape(str(r[order]))}</td><td>{r["score"]}</td><td>{r["quality_label"]}</td><td>{r["length"]}</td><td>{codes}</td></tr>')
        return "".join(out)

    head = "<tr><th>Chunk</th><th>Score</th><th>Label</th><th>Length</th><th>Issues</th></tr>"
    tiles = "".join(f'<div class="card"><b>{html.escape(str(v))}</b><br>{html.escape(k)}</div>' for k, v in cards.items())
    return f"<!doctype html><meta charset=utf-8><title>Chunk quality</title><style>.card{{display:inline-block;border:1px solid #ccc;margin:4px;padding:8px}}</style>{tiles}<h2>Parents</h2><table>{head}{rows(parents)}</table><h2>Children</h2><table>{head}{rows(children)}</table>"
