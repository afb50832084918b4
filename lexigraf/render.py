"""Results of the services as text for a terminal."""

from __future__ import annotations


def _place(r: dict) -> str:
    return f"{r['path']}:{r['start_line']}-{r['end_line']}" + (f"  {r['symbol']}" if r.get("symbol") else "")


def search(rows: list[dict]) -> str:
    out = []
    for i, r in enumerate(rows, 1):
        versions = f"  [{', '.join(v[:7] for v in r['versions'])}]" if r.get("versions") else ""
        out.append(f"{i}. {_place(r)}  {r['score']:.4f}{versions}")
        out += [f"     {line}" for line in (r.get("snippet") or r.get("text") or "").splitlines()[:5]]
    return "\n".join(out) or "nothing found"


def symbols(rows: list[dict]) -> str:
    return "\n".join(f"{r['symbol_id']}  {r['kind']}  lines {r['start_line']}-{r['end_line']}" for r in rows) or "no such symbol"


def dependencies(rows: list[dict]) -> str:
    line = lambda r: r["symbols"][0] + "".join(f" -{k}-> {s}" for k, s in zip(r["kinds"], r["symbols"][1:], strict=True))
    return "\n".join(f"{r['score']:.3f}  {line(r)}" for r in rows) or "no dependencies"


def comparison(got: dict) -> str:
    out = [f"{got['from'][:7]}..{got['to'][:7]}  " + ", ".join(f"{n} {c}" for c, n in sorted(got["summary"].items()))]
    for s in got["symbols"]:
        name = s["new"] or s["old"]
        out.append(f"{s['change']}: {name}" + (f" (was {s['old']}, {s['similarity']:.2f})" if s["old"] and s["new"] and s["old"] != s["new"] else ""))
        out += [f"    {line}" for line in s["diff"].splitlines()]
    out += [f"{'+' if e['change'] == 'added' else '-'} {e['src']} -{e['kind']}-> {e['dst']}" for e in got["edges"]]
    out += [f"{c['commit'][:7]} {c['subject']}" + (f": {', '.join(c['symbols'])}" if c["symbols"] else "") for c in got["commits"]]
    return "\n".join(out)


def versions(rows: list[dict]) -> str:
    return "\n".join(f"{r['version_id'][:7]}  {r['tag'] or '-'}  {r['message']}" for r in rows) or "nothing is indexed"


def history(rows: list[dict]) -> str:
    return "\n".join(f"{r['commit_id'][:7]}  {r['change_type']}  {r['path']}::{r['symbol']}" for r in rows) or "no such symbol"


def fields(row: dict) -> str:
    return "\n".join(f"{k}: {v}" for k, v in row.items())
