"""Git as a Spark source, format ``lexigraf_git``.

``table`` is one of ``files`` (path, blob, content), ``log`` (commit_id, parent, author,
timestamp, subject, files) or ``tags`` (commit_id, tag).  Files are listed once and their
blobs dealt over ``partitions`` readers; suffix and size are tested before a blob is read.
"""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .chunkers import MOST_BYTES, eligible, language_of


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def lines(repo: str, *args: str) -> list[str]:
    return git(repo, *args).decode("utf-8", "replace").splitlines()


def resolve(repo: str, ref: str) -> str:
    return lines(repo, "rev-parse", "--verify", f"{ref}^{{commit}}")[0]


def tree(repo: str, ref: str) -> list[tuple[str, str, int]]:
    """(path, blob, size) of the files of a commit that may be indexed."""
    out = []
    for entry in git(repo, "ls-tree", "-r", "-l", "-z", ref).decode("utf-8", "replace").split("\0"):
        if entry:
            meta, path = entry.split("\t", 1)
            _, kind, blob, size = meta.split()
            if kind == "blob" and language_of(path) and int(size) <= MOST_BYTES:
                out.append((path, blob, int(size)))
    return out


def changed(repo: str, base: str, ref: str) -> set[str]:
    return {p for p in git(repo, "diff", "--name-only", "-z", base, ref).decode("utf-8", "replace").split("\0") if p}


def log(repo: str, spec: list[str], most: int | None = None) -> list[tuple]:
    """(commit, parent, author, timestamp, subject, files), newest first."""
    args = ["log", "--name-only", "--format=%x01%H%x02%P%x02%an%x02%ct%x02%s%x03", *([f"-{most}"] if most else []), *spec]
    out = []
    for part in git(repo, *args).decode("utf-8", "replace").split("\x01")[1:]:
        head, _, names = part.partition("\x03")
        commit, parents, author, when, subject = head.split("\x02")
        files = [n for n in names.strip().splitlines() if n and language_of(n)]
        out.append((commit, parents.split(" ")[0] or None, author, int(when), subject, files))
    return out


def commits_between(repo: str, a: str, b: str, most: int = 100) -> list[tuple]:
    return log(repo, [f"{a}..{b}"], most)


def tags(repo: str) -> list[tuple[str, str]]:
    """(commit, tag), annotated tags peeled; of several tags of a commit the first."""
    out: dict[str, str] = {}
    for row in lines(repo, "for-each-ref", "--format=%(objectname) %(*objectname) %(refname:short)", "refs/tags"):
        parts = row.split(" ")
        out.setdefault(parts[1] or parts[0], parts[2])
    return sorted(out.items())


def ancestors(repo: str, ref: str, most: int = 5000) -> list[str]:
    """First parents, nearest first."""
    return lines(repo, "rev-list", "--first-parent", f"-{most}", ref)[1:]


def oldest_first(repo: str, commits: list[str]) -> list[str]:
    rank = {c: i for i, c in enumerate(lines(repo, "rev-list", "--topo-order", "--reverse", *commits))} if commits else {}
    return sorted(commits, key=lambda c: rank.get(c, -1))


def commit_info(repo: str, commits: list[str]) -> dict[str, tuple[int, str]]:
    """commit -> (timestamp, subject), some hundreds at a time."""
    out: dict[str, tuple[int, str]] = {}
    for i in range(0, len(commits), 500):
        for row in lines(repo, "log", "--no-walk=unsorted", "--format=%H%x02%ct%x02%s", *commits[i : i + 500]):
            commit, when, subject = row.split("\x02", 2)
            out[commit] = (int(when), subject)
    return out


def is_ancestor(repo: str, a: str, b: str) -> bool:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "merge-base", "--is-ancestor", a, b], capture_output=True).returncode == 0


def is_repository(repo: str) -> bool:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def first_commit(repo: str) -> str | None:
    """The oldest root of all branches, or None without a commit."""
    roots = lines(repo, "rev-list", "--max-parents=0", "--all")
    return roots[-1] if roots else None


def ignore(repo: str, folder: str) -> None:
    """If the folder lies in the working tree, let Git ignore it."""
    top = os.path.abspath(repo)
    at = os.path.abspath(re.sub(r"^file:/*", "/", folder))
    if at.startswith(f"{top}/"):
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/.gitignore", "w") as f:
            f.write("*\n")


class _Blobs(InputPartition):
    def __init__(self, entries: list):
        super().__init__(None)
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref, self.table, self.n = options["path"], options.get("ref", "HEAD"), options.get("table", "files"), int(options.get("partitions", "8"))

    def partitions(self):
        if self.table != "files":
            return [InputPartition(0)]
        entries = tree(self.repo, self.ref)
        return [_Blobs(entries[i :: self.n]) for i in range(self.n) if entries[i :: self.n]]

    def read(self, partition):
        if self.table == "tags":
            yield from tags(self.repo)
        elif self.table == "log":
            yield from log(self.repo, [self.ref])
        else:
            for path, blob, _ in getattr(partition, "entries", []):
                content = git(self.repo, "cat-file", "blob", blob)
                if eligible(path, content):
                    yield path, blob, content.decode("utf-8", "replace")


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexigraf_git"

    def schema(self) -> str:
        return {
            "files": "path string, blob string, content string",
            "log": "commit_id string, parent string, author string, timestamp long, subject string, files array<string>",
            "tags": "commit_id string, tag string",
        }[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(GitSource)
