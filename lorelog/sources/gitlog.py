"""A Python data source over a local clone: spark.read.format("gitlog").option("path", ...).load().

The commit list is split into contiguous shards, each read by one partition with one process.  Records are framed by
NUL and read by position, never by look, as paths may hold anything else.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorelog.model import UserError
from lorelog.storage import stored

#: Sharding, limits, and the settings that decide which changes the log shows.
SHARD_FROM, SHARD_MAX, SHARD_LEAST = 5_000, 16, 500
BAD_SHARE = 0.01
MIN_VERSION = (2, 22, 0)
TIMEOUT = 600
#: Bytes of the log, and of contents, that a task holds at a time.
CHUNK = 4 << 20
HASH_DIGITS = 40
BLOB_BYTES = 64 << 20
SETTINGS = (
    "core.quotePath=false", "diff.renames=true", "diff.renameLimit=1000", "diff.algorithm=myers", "log.showRoot=true", "i18n.logOutputEncoding=UTF-8",
    "core.attributesFile=/dev/null", "mailmap.file=", "mailmap.blob=HEAD:.mailmap", "log.showSignature=false",
)
FORMAT = "%x1e%H%x1f%T%x1f%P%x1f%aN%x1f%aE%x1f%ae%x1f%aI%x1f%cI%x1f%s%x1f%b%x1f"
SCHEMA = (
    "hash string, seq bigint, tree string, parents array<string>, author_name string, author_email string, author_source_email string, author_ts timestamp_ntz, author_off_min int, "
    "committer_ts timestamp_ntz, committer_off_min int, is_merge boolean, subject string, body string, diff_no int, "
    "files array<struct<path:string,previous_path:string,added:bigint,deleted:bigint,is_binary:boolean,old_blob:string,new_blob:string>>, bad boolean"
)


def command(path: str, *args: str) -> list[str]:
    return ["git", "-C", path, "--no-replace-objects", *(x for s in SETTINGS for x in ("-c", s)), *args]


def environment() -> dict[str, str]:
    return os.environ | {"GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_ATTR_NOSYSTEM": "1", "LC_ALL": "C"}


def git(path: str, *args: str, given: bytes | None = None) -> bytes:
    done = subprocess.run(command(path, *args), input=given, capture_output=True, timeout=TIMEOUT, env=environment())
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace')[:300]}")
    return done.stdout


def preflight(path: str, allow_shallow: bool = False) -> dict:
    """Checks in a fixed order; the first that fails refuses the run."""
    try:
        said = subprocess.run(["git", "--version"], capture_output=True, text=True, timeout=TIMEOUT).stdout
    except OSError as e:
        raise UserError("git_unavailable", "git isn't on the path") from e
    found = re.search(r"(\d+)\.(\d+)(?:\.(\d+))?", said)
    if not found:
        raise UserError("git_unavailable", "git doesn't tell its version")
    if tuple(int(x or 0) for x in found.groups()) < MIN_VERSION:
        raise UserError("git_version_unsupported", found[0])
    if not os.path.exists(path):
        raise UserError("path_not_found", "the path doesn't exist")
    try:
        top = git(path, "rev-parse", "--show-toplevel").decode().strip()
    except RuntimeError as e:
        raise UserError("not_a_repository", "no repository there") from e
    shallow = git(path, "rev-parse", "--is-shallow-repository").strip() == b"true"
    if shallow and not allow_shallow:
        raise UserError("shallow_clone", "the clone is shallow")
    common = git(path, "rev-parse", "--git-common-dir").decode().strip()
    grafts = os.path.exists(os.path.join(top, common, "info", "grafts"))
    try:
        head = git(path, "rev-parse", "--verify", "HEAD^{commit}").decode().strip()
    except RuntimeError as e:
        raise UserError("empty_repository", "the repository has no commits") from e
    try:
        branch = git(path, "symbolic-ref", "--short", "HEAD").decode().strip()
    except RuntimeError:
        branch = ""
    return {"path": top, "name": os.path.basename(top), "head_commit": head, "default_branch": branch, "is_shallow": shallow, "has_grafts": grafts}


def shards(count: int, cores: int) -> list[tuple[int, int]]:
    """Contiguous (start, end) of the commit list; one below SHARD_FROM commits."""
    n = 1 if count < SHARD_FROM else max(1, min(cores, SHARD_MAX, count // SHARD_LEAST))
    cuts = [count * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _instant(text: str) -> tuple[datetime, int]:
    """(UTC without zone, the recorded offset in minutes)."""
    t = datetime.fromisoformat(text)
    offset = int((t.utcoffset() or timedelta()).total_seconds() // 60)
    return t.astimezone(timezone.utc).replace(tzinfo=None), offset


def _blob(oid: str, mode: str) -> str | None:
    """No blob for a side that doesn't exist or is a submodule."""
    return None if set(oid) == {"0"} or mode == "160000" else oid


def _changes(tokens: list[str], at: int) -> tuple[list[dict], int]:
    """The raw entries and the numstat entries that follow a header, joined by position; their paths must agree."""
    raw, stats = [], []
    while at < len(tokens) and tokens[at].startswith(":"):
        old_mode, new_mode, old, new, status = tokens[at][1:].split(" ")
        two = status[0] in "RC"
        previous, path = (tokens[at + 1], tokens[at + 2]) if two else (None, tokens[at + 1])
        raw.append((path, previous, _blob(old, old_mode), _blob(new, new_mode), status[0]))
        at += 3 if two else 2
    while at < len(tokens) and not tokens[at].startswith("\x1e"):
        added, deleted, path = tokens[at].split("\t", 2)
        if path:
            stats.append((added, deleted, path))
            at += 1
        else:
            stats.append((added, deleted, tokens[at + 2]))
            at += 3
    if len(raw) != len(stats) or any(r[0] != s[2] for r, s in zip(raw, stats)):
        raise ValueError("the two lists of changes differ")
    out = []
    for (path, previous, old, new, status), (added, deleted, _) in zip(raw, stats):
        binary = added == "-"
        out.append({
            "path": path, "previous_path": previous if status == "R" else None, "added": 0 if binary else int(added), "deleted": 0 if binary else int(deleted),
            "is_binary": binary, "old_blob": old, "new_blob": new,
        })
    return out, at


def parse(data: bytes, first_seq: int, order: dict[str, int] | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA.  A record that can't be read is a row with ``bad`` set, and the next header goes on."""
    tokens = data.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode().split("\0")
    if tokens[-1] == "":  # behind the last NUL
        tokens.pop()
    at, seen = 0, {}
    while at < len(tokens):
        if not tokens[at].lstrip("\n").startswith("\x1e"):
            at += 1
            continue
        header = tokens[at].lstrip("\n")[1:].split("\x1f")
        at += 1
        if len(header) < 11:
            yield (*[None] * 16, True)
            continue
        tree_hash, tree, parents, name, mapped, source, authored, committed, subject = header[:9]
        body = "\x1f".join(header[9:-1])
        tokens_at = at
        a = c = a_off = c_off = None
        try:
            if at < len(tokens):
                tokens[at] = tokens[at].lstrip("\n")
            files, at = _changes(tokens, at)
            (a, a_off), (c, c_off) = _instant(authored), _instant(committed)
            bad = False
        except (ValueError, IndexError, OverflowError):
            files, bad, at = [], True, max(at, tokens_at)
        up = parents.split()
        diff_no = seen.get(tree_hash, -1) + 1
        seen[tree_hash] = diff_no
        seq = order[tree_hash] if order else first_seq + len(seen) - 1
        yield (tree_hash, seq, tree, up, name, mapped, source, a, a_off, c, c_off, len(up) > 1, subject, body, diff_no, [tuple(f.values()) for f in files], bad)


class Shard(InputPartition):
    def __init__(self, hashes: list[str], first: int):
        super().__init__(first)
        self.hashes, self.first = hashes, first


def resolved_bounds(path: str, since: str | None = None, until: str | None = None) -> dict[str, int]:
    """The instants (seconds) that texts like "2 weeks ago" stand for; asked once, so that all shards use the same ones."""
    out = {}
    for name, text, kind in (("since", since, "--max-age="), ("until", until, "--min-age=")):
        if text:
            out[name] = int(git(path, "rev-parse", f"--{name}={text}").decode().strip().removeprefix(kind))
    return out


_HEADER = re.compile(b"\0\x1e")


def records(stream) -> Iterator[bytes]:
    """The log cut in front of headers, whole commits at a time, as it comes: no more than CHUNK bytes and one commit are held."""
    held = b""
    while data := stream.read(CHUNK):
        held += data
        end = len(held) - HASH_DIGITS  # up to the last header whose hash is there as a whole
        heads = [0, *(m.start() + 1 for m in _HEADER.finditer(held, 0, max(0, end)))] if end > 0 else [0]
        # a merge's diffs stay together, as they are numbered within the commit
        cut = heads[-1]
        while len(heads) > 1 and held[heads[-2] + 1 : heads[-2] + 1 + HASH_DIGITS] == held[cut + 1 : cut + 1 + HASH_DIGITS]:
            heads.pop()
            cut = heads[-1]
        if cut:
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bounds = resolved_bounds(self.path, options.get("since"), options.get("until"))
        self.cores = int(options.get("shards", os.cpu_count() or 1))

    def partitions(self) -> list[InputPartition]:
        ages = {"since": "max", "until": "min"}
        hashes = git(self.path, "rev-list", "--all", "--date-order", *(f"--{ages[k]}-age={v}" for k, v in self.bounds.items())).decode().split()
        return [Shard(hashes[a:z], a) for a, z in shards(len(hashes), self.cores)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.hashes:
            return
        order = {h: partition.first + i for i, h in enumerate(partition.hashes)}
        args = ["log", "--no-walk=unsorted", "--stdin", "-z", "--raw", "--numstat", "--no-abbrev", "-M", "-m", f"--format={FORMAT}"]
        with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as said:
            given.write("\n".join(partition.hashes).encode())
            given.seek(0)
            with subprocess.Popen(command(self.path, *args), stdin=given, stdout=subprocess.PIPE, stderr=said, env=environment()) as process:
                for part in records(process.stdout):
                    yield from parse(part, partition.first, order)
            if process.returncode:
                said.seek(0)
                raise RuntimeError(f"git log: {said.read(300).decode(errors='replace')}")


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(dict(self.options))


def read_history(spark: SparkSession, path: str, **options) -> DataFrame:
    """All diffs of all commits (a merge has one row per shown diff); refuses a log of which over 1 % can't be read."""
    spark.dataSource.register(GitLogSource)
    found = stored(spark.read.format("gitlog").option("path", path).options(**options).load(), "gitlog")  # the log is read once
    n = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    if n["bad"] > BAD_SHARE * n["n"]:
        raise RuntimeError(f"{n['bad']} of {n['n']} records can't be read")
    return found.filter("not bad")


def tree_at(spark: SparkSession, path: str, commit: str = "HEAD") -> DataFrame:
    """(path, type, blob) of all entries of a commit's tree."""
    rows = []
    for entry in git(path, "ls-tree", "-r", "-z", commit).decode("utf-8", "replace").split("\0")[:-1]:
        meta, name = entry.split("\t", 1)
        _, kind, oid = meta.split(" ")
        rows.append((name, kind, oid))
    return spark.createDataFrame(rows, "path string, type string, blob string")


def _first_bytes(path: str, oid: str, n: int) -> bytes:
    with subprocess.Popen(command(path, "cat-file", "blob", oid), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=environment()) as process:
        out = process.stdout.read(n)
        process.kill()
    return out


def _contents(path: str, oids: list[str]) -> Iterator[tuple[str, bytes]]:
    data, at = git(path, "cat-file", "--batch", given="\n".join(oids).encode()), 0
    for oid in oids:
        end = data.index(b"\n", at)
        size = int(data[at:end].split()[2])
        yield oid, data[end + 1 : end + 1 + size]
        at = end + 2 + size


def blobs(oids: DataFrame, path: str, limit: int = 32 << 20, sniffed: int = 8000) -> DataFrame:
    """(oid, content, size, oversized) of a column ``oid``; of a content over the limit only its first bytes are read.

    Sizes are asked first; contents come up to BLOB_BYTES at a time.
    """

    def run(batches):
        import pandas as pd

        for t in batches:
            names = t["oid"].tolist()
            said = [line.split() for line in git(path, "cat-file", "--batch-check", given="\n".join(names).encode()).decode().splitlines()]
            sizes = {oid: int(words[2]) if len(words) == 3 else None for oid, words in zip(names, said)}
            rows = [(oid, None, 0, False) for oid in names if sizes[oid] is None]
            rows += [(oid, _first_bytes(path, oid, sniffed), sizes[oid], True) for oid in names if sizes[oid] is not None and sizes[oid] > limit]
            if rows:
                yield pd.DataFrame(rows, columns=["oid", "content", "size", "oversized"])
            some, held = [], 0
            for oid in [*(x for x in names if sizes[x] is not None and sizes[x] <= limit), None]:
                if some and (oid is None or held + sizes[oid] > BLOB_BYTES):
                    yield pd.DataFrame([(x, content, sizes[x], False) for x, content in _contents(path, some)], columns=["oid", "content", "size", "oversized"])
                    some, held = [], 0
                if oid is not None:
                    some, held = [*some, oid], held + sizes[oid]

    return oids.select("oid").distinct().mapInPandas(run, "oid string, content binary, size long, oversized boolean")
