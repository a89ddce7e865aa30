"""Command line over a repository.

    python -m strata.cli new PATH [--name N]         heads | states | snapshots | logs PATH
    python -m strata.cli list|get|set|rm PATH ...    header PATH-OF-A-BINARY-FILE
    python -m strata.cli snapshot|merge PATH
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata.errors import ArgError, CmdFailed, StrataError
from strata.operators import dag, merge
from strata.repository import Repository
from strata.sources import codec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strata")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("new", "heads", "states", "snapshots", "logs", "list", "get", "set", "rm", "snapshot", "merge", "header"):
        s = sub.add_parser(name)
        s.add_argument("path")
        if name == "new":
            s.add_argument("--name")
        if name in ("list", "get", "set", "rm"):
            s.add_argument("--commit", help="a state by the first digits of its sum")
        if name in ("get", "set", "rm"):
            s.add_argument("elt_id", type=int)
        if name == "set":
            s.add_argument("--file", help="the new content; - for standard input; without it $VISUAL or $EDITOR is run")
        if name in ("set", "rm"):
            s.add_argument("--force", action="store_true", help="change a state that is not the tip, which starts a branch")
    return p


def edited(text: str) -> str:
    """The text after the user's editor ran on it."""
    editor = os.environ.get("VISUAL") or os.environ.get("EDITOR")
    if not editor:
        raise CmdFailed("neither VISUAL nor EDITOR is set")
    with tempfile.NamedTemporaryFile("w+", suffix=".txt", delete=False) as f:
        f.write(text)
    try:
        if subprocess.run([*editor.split(), f.name], check=False).returncode:
            raise CmdFailed(editor)
        with open(f.name, encoding="utf-8") as got:
            return got.read()
    finally:
        os.unlink(f.name)


def run(spark: SparkSession, argv: list[str], out=print) -> None:
    a = parser().parse_args(argv)
    if a.command == "header":
        with open(a.path, "rb") as f:
            h = codec.read_header(codec.Input(f.read()))
        out(f"{h.kind} {h.version} {h.name}")
        for x in h.user:
            out(f"{x.kind}: {x.value}")
        return
    if a.command == "new":
        Repository.create(spark, a.path, a.name or codec.short_name(os.path.basename(a.path.rstrip("/"))))
        return
    repo = Repository.open(spark, a.path)
    if a.command == "heads":
        for tip in repo.tips():
            out(tip)
    elif a.command == "states":
        for r in dag.listing(repo.states()).toLocalIterator():
            out(f"{r['number']} {r['statesum']} {'tip' if r['is_tip'] else ''} {r['extra'] or ''}".rstrip())
    elif a.command == "snapshots":
        for r in repo.snapshot_index().orderBy("ss").toLocalIterator():
            out(f"{r['ss']} {r['statesum']}")
    elif a.command == "logs":
        for r in repo.commits().groupBy("ss", "cl").agg(F.count(F.lit(1)).alias("n")).orderBy("ss", "cl").toLocalIterator():
            out(f"{r['ss']} {r['cl']} {r['n']}")
    elif a.command == "snapshot":
        out(str(repo.write_snapshot()))
    elif a.command == "merge":
        made = repo.merge(merge.chain(merge.ancestor, merge.renaming))
        repo.write_full()
        out("\n".join(made))
    else:
        state = repo.state_from_string(a.commit) if a.commit else repo.tip_key()
        if a.command == "list":
            for r in repo.state(state).select("elt_id").orderBy(F.col("elt_id") < 0, "elt_id").toLocalIterator():
                out(str(r[0] % 2**64))
            return
        if a.command == "get":
            out(str(repo.get(a.elt_id, state)))
            return
        if state not in repo.tips() and not a.force:
            raise ArgError("not a tip: changing it starts a branch; use --force")
        draft = repo.draft(state)
        if a.command == "rm":
            draft.remove(spark.createDataFrame([(a.elt_id,)], "elt_id bigint"))
        else:
            have = repo.state(state).where(F.col("elt_id") == a.elt_id).collect()  # present or not, whatever its content
            if a.file == "-":
                text = sys.stdin.read()
            elif a.file:
                with open(a.file, encoding="utf-8") as f:
                    text = f.read()
            else:
                text = edited(have[0]["elt"] or "" if have else "")
            rows = spark.createDataFrame([(a.elt_id, text)], "elt_id bigint, elt string")
            draft.replace(rows) if have else draft.insert(rows)
        out(draft.push() or "nothing changed")
        repo.write_full()


def main() -> None:
    spark = SparkSession.builder.appName("strata").config("spark.ui.enabled", "false").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    except StrataError as e:
        sys.exit(f"{type(e).__name__}: {e}")


if __name__ == "__main__":
    main()
