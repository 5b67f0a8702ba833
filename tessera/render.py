"""Results and counters as text or JSON."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable


class Style:
    def __init__(self, on: bool | None = None):
        self.on = sys.stdout.isatty() if on is None else on

    def __call__(self, code: str, text: str) -> str:
        return f"\x1b[{code}m{text}\x1b[0m" if self.on else text


def results(query: str, rows: Iterable, style: Style | None = None) -> str:
    style, rows = style or Style(False), list(rows)
    if not rows:
        return f"no results for {query!r}"
    out = []
    for rank, r in enumerate(rows, 1):
        out += [f"{rank}. {style('1', r['title'] or 'untitled')}  {style('2', format(r['score'], '.3f'))}", f"   {style('36', r['uri'] or '')}", f"   {r['snippet']}", ""]
    return "\n".join(out).rstrip()


def results_json(query: str, rows: Iterable, stats=None, elapsed_ms: float = 0.0) -> str:
    hits = [{k: r[k] for k in ("uri", "title", "score", "snippet")} for r in rows]
    body = {"query": query, "elapsed_ms": round(elapsed_ms, 3), "count": len(hits)}
    if stats is not None:
        body |= {k: stats[k] for k in ("pruned", "blocks_skipped") if k in stats}
        body |= {"strategy": stats["strategy"], "candidates": stats["candidates"], "scored": stats["scored"]}
    return json.dumps(body | {"results": hits}, ensure_ascii=False)


def explain(stats) -> str:
    avoided = 100 * (1 - stats["scored"] / stats["candidates"]) if stats["candidates"] else 0.0
    return f"strategy: {stats['strategy']}\npostings: {stats['candidates']}\nscored:   {stats['scored']}\navoided:  {avoided:.1f} %" + (f"\nblocks:   {stats['blocks_skipped']} of {stats['blocks']} skipped" if "blocks" in stats else "")


def stats(path: str, row, on_disk: bool) -> str:
    per = row["postings_bytes"] / row["postings"] if row["postings"] else 0.0
    lines = [
        ("index", path), ("storage", "parquet" if on_disk else "memory"), ("documents", row["documents"]), ("vocabulary", row["vocabulary"]),
        ("postings", row["postings"]), ("average length", f"{row['avg_doc_len']:.1f}"), ("postings size", f"{row['postings_bytes'] / 1024:.1f} KiB ({per:.2f} bytes/posting)"),
    ]
    return "\n".join(f"{k + ':':<16}{v}" for k, v in lines)
