"""Command line: ``python -m lexigraf.cli index|search|symbol|deps|compare|versions|history|diff|smoke``."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import tempfile

from . import render, service
from .config import REPO, STORE
from .session import session
from .sources.store import VersionedStore

SMOKE = {
    "one": {"app/conf.py": "import json\n\n\ndef load(path):\n    with open(path) as f:\n        return json.load(f)\n", "app/run.py": "from .conf import load\n\n\ndef main():\n    return load('a.json')\n"},
    "two": {"app/conf.py": "import json\n\n\ndef read_conf(path):\n    with open(path) as f:\n        return json.load(f)\n\n\ndef cached(path, held={}):\n    return held.setdefault(path, read_conf(path))\n", "app/run.py": "from .conf import cached\n\n\ndef main():\n    return cached('a.json')\n"},
}


def commit_files(repo: str, files: dict[str, str], message: str, gone: list[str] = ()) -> str:
    for path in gone:
        os.remove(f"{repo}/{path}")
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{repo}/{path}") or repo, exist_ok=True)
        with open(f"{repo}/{path}", "w") as f:
            f.write(text)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", "-C", repo, *a], check=True, capture_output=True, text=True).stdout
    if not os.path.isdir(f"{repo}/.git"):
        run("init", "-q")
    run("add", "-A")
    run("commit", "-q", "-m", message)
    return run("rev-parse", "HEAD").strip()


def smoke(spark) -> dict[str, bool]:
    """Checks over a small repository made for it."""
    with tempfile.TemporaryDirectory() as folder:
        repo = f"{folder}/repo"
        os.makedirs(repo)
        first, second = (commit_files(repo, SMOKE[k], k) for k in ("one", "two"))
        store = VersionedStore(spark, f"file://{folder}/store", repo)
        one, two = store.index_commit(first), store.index_commit(second)
        found = service.search(store, "load json config", second)
        changes = service.compare_versions(store, first, second)
        return {
            "indexes": one.total_chunks == 2 and two.total_chunks == 3,
            "knows its base": two.base == first,
            "searches": bool(found) and found[0]["symbol"] in ("read_conf", "cached"),
            "finds symbols": [r["symbol_id"] for r in service.find_symbol(store, "read_conf", second)] == ["app/conf.py::read_conf"],
            "follows calls": any(r["symbols"][-1] == "app/conf.py::read_conf" for r in service.find_dependencies(store, "main", second)),
            "sees the rename": any(s["change"] == "renamed" and s["old"] == "app/conf.py::load" for s in changes["symbols"]),
            "sees the addition": changes["summary"].get("added") == 1,
        }


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexigraf")
    parser.add_argument("--repo", default=os.environ.get(REPO, "."))
    parser.add_argument("--store", default=os.environ.get(STORE))
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="what", required=True)
    for name, extra in {"index": ["ref"], "search": ["text"], "symbol": ["name"], "deps": ["name"], "compare": ["a", "b"], "versions": [], "history": ["name"], "diff": ["name", "a", "b"], "smoke": []}.items():
        p = sub.add_parser(name)
        for e in extra:
            p.add_argument(e, nargs="?" if e == "ref" else None, default="HEAD" if e == "ref" else None)
        if name in ("search", "symbol", "deps"):
            p.add_argument("--ref", default="HEAD")
        if name == "search":
            p.add_argument("--limit", type=int, default=10)
            p.add_argument("--history", action="store_true")
            p.add_argument("--graph", action="store_true")
            p.add_argument("--engine", choices=["hybrid", "baseline"], default="hybrid")
        if name == "deps":
            p.add_argument("--direction", choices=["in", "out", "both"], default="out")
            p.add_argument("--depth", type=int, default=3)
    got = parser.parse_args(args)
    spark = session()
    if got.what == "smoke":
        out = smoke(spark)
    else:
        store = VersionedStore(spark, got.store or f"file://{os.path.abspath(got.repo)}/.lexigraf", os.path.abspath(got.repo))
        out = {
            "index": lambda: vars(store.index_commit(got.ref)),
            "search": lambda: (
                service.search_baseline(store, got.text, got.ref, service.bounded("limit", got.limit, 1, 20), got.history)
                if got.engine == "baseline"
                else service.search(store, got.text, got.ref, service.bounded("limit", got.limit, 1, 20), got.history, got.graph)
            ),
            "symbol": lambda: service.find_symbol(store, got.name, got.ref),
            "deps": lambda: service.find_dependencies(store, got.name, got.ref, got.direction, depth=got.depth),
            "compare": lambda: service.compare_versions(store, got.a, got.b),
            "versions": lambda: service.versions(store),
            "diff": lambda: service.diff_symbol(store, got.name, got.a, got.b),
            "history": lambda: service.symbol_history(store, got.name),
        }[got.what]()
    show = {"search": render.search, "symbol": render.symbols, "deps": render.dependencies, "compare": render.comparison, "versions": render.versions, "history": render.history}
    print(json.dumps(out, default=str) if got.json else show.get(got.what, render.fields)(out))
    return int(got.what == "smoke" and not all(out.values()))


if __name__ == "__main__":
    sys.exit(main())
