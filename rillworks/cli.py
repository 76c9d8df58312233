"""python -m rillworks run NAME | examples | catalog | bench [NAME...] | bench-check OLD NEW | version."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable, Sequence

from rillworks import __version__
from rillworks.measure import Timing, measure, regressed
from rillworks.plans.pipelines import PIPELINES
from rillworks.session import session
from rillworks.stream import Stream


def load(name: str) -> Callable[..., Stream]:
    """A named pipeline, or `module:function` that takes a session and gives a stream."""
    if name in PIPELINES:
        return PIPELINES[name]
    module, _, function = name.partition(":")
    if not function:
        raise SystemExit(f"no pipeline {name!r}; see `examples`, or give module:function")
    return getattr(importlib.import_module(module), function)


def _timings(path: str) -> dict[str, Timing]:
    with open(path) as file:
        return {name: Timing(name, tuple(seconds)) for name, seconds in json.load(file).items()}


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser("rillworks", description=__doc__)
    parser.add_argument("--master", default="local[*]")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run", help="run a pipeline and print its rows")
    one.add_argument("name")
    one.add_argument("--parallelism", type=int)
    one.add_argument("--rows", type=int, default=20, help="rows to print")
    one.add_argument("--report", choices=["markdown", "json"])
    sub.add_parser("examples", help="name the pipelines")
    timed = sub.add_parser("bench", help="time pipelines")
    timed.add_argument("names", nargs="*")
    timed.add_argument("--trials", type=int, default=5)
    timed.add_argument("--json", action="store_true", help="print every trial, for bench-check")
    sub.add_parser("catalog", help="name the queries, and which of them have SQL to agree with")
    held = sub.add_parser("bench-check", help="compare two outputs of bench --json; fails where the newer is slower")
    held.add_argument("old")
    held.add_argument("new")
    sub.add_parser("version")
    got = parser.parse_args(args)
    if got.command == "version":
        print(__version__)
    elif got.command == "examples":
        print("\n".join(PIPELINES))
    elif got.command == "catalog":
        from rillworks.plans.catalogue import ORACLES, QUERIES

        print("\n".join(f"{name}\t{'SQL' if name in ORACLES else 'rows'}" for name in QUERIES))
    elif got.command == "run":
        stream = load(got.name)(session(master=got.master))
        for row in stream.map(lambda df: df.limit(got.rows)).run(parallelism=got.parallelism).to_pylist():
            print(row)
        if got.report:
            report = stream.profile()
            print(report.to_markdown() if got.report == "markdown" else report.to_json())
    elif got.command == "bench-check":
        old, new = (_timings(path) for path in (got.old, got.new))
        slower = [name for name in new if name in old and regressed(new[name], old[name])]
        for name in new:
            if name in old:
                print(f"{name}: {old[name].median:.3f} s, now {new[name].median:.3f} s{', slower' if name in slower else ''}")
        return 1 if slower else 0
    else:
        spark, found = session(master=got.master), {}
        for name in got.names or [n for n in PIPELINES if n.startswith("bench-")]:
            make = load(name)
            timing = measure(name, lambda make=make: make(spark).df.write.format("noop").mode("overwrite").save(), trials=got.trials)
            found[name] = timing.seconds
            if not got.json:
                print(f"{name}: {timing.median:.3f} s, spread {timing.spread:.0%}")
        if got.json:
            print(json.dumps(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
