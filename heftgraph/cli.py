"""Command line: reports over an executable and its listing.

    python -m heftgraph.cli prune --binary app --listing listing.json --controlled 'example.org/team/...'

Ends with 0, with 2 where a budget fails, and with 1 on errors.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from heftgraph import tools
from heftgraph.analysis import Analysis
from heftgraph.operators import texts
from heftgraph.operators.budget import Budget
from heftgraph.operators.policy import Policy
from heftgraph.sources import settings

VERSION = "0.3"
FORMATS = ("table", "json", "markdown")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="heftgraph", description="What a build weighs, and what leaves when dependencies are cut.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, build: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--format", "-o", choices=FORMATS, default="table")
        p.add_argument("--folder", default=".", help="where configuration and release files are looked for")
        for flag in ("--controlled", "--lock", "--unlock"):
            p.add_argument(flag, action="append", default=[])
        if build:
            p.add_argument("--binary", "-b", required=True)
            p.add_argument("--listing", required=True)
            p.add_argument("--dump")
            p.add_argument("--sources")
        return p

    for name, text in (("anatomy", "sizes by content and owner"), ("prune", "what leaves when dependencies are cut")):
        p = command(name, text)
        p.add_argument("--top", "-t", type=int, default=texts.LISTS)
        p.add_argument("--why", action="store_true")
        p.add_argument("--hide-locked", action="store_true")
        if name == "prune":
            p.add_argument("--blame", action="store_true")
    command("go-version", "the lowest version that dependencies allow")
    command("check", "hold the build against a budget").add_argument("--on-disk", action="store_true")
    command("inspect", "one module in full").add_argument("module")
    for name in ("--before-binary", "--before-listing"):
        p = command("diff", "the change from another build") if name == "--before-binary" else p
        p.add_argument(name, required=True)
    p = command("matrix", "a build over platforms", build=False)
    p.add_argument("--cell", action="append", default=[], metavar="OS/ARCH[+TAGS]=BINARY,LISTING", required=True)
    p.add_argument("--wide", action="store_true")
    command("modules", "the modules of a listing", build=False).add_argument("--listing", required=True)
    sub.add_parser("version", help="the version of this program")
    sub.add_parser("serve", help="answer tool requests from standard input")
    command("config", "the settings in force", build=False).add_argument("--platform", action="append", default=[])
    return top


def _limits(block: dict) -> Budget:
    return Budget(str(block.get("max-binary-size") or ""), str(block.get("max-go-version") or ""), tuple(settings.listed(block.get("deny"))), {k: str(v) for k, v in (block.get("max-module-size") or {}).items()}, str(block.get("action") or ""))


def _text(command: str, answer: dict, markdown: bool, args: argparse.Namespace) -> str:
    if command in ("anatomy", "prune", "diff"):
        return getattr(texts, command)(answer, markdown, getattr(args, "top", texts.LISTS))
    if command == "matrix":
        return texts.matrix(answer, markdown, args.wide)
    return {"go-version": texts.go_version, "check": texts.check, "inspect": texts.inspect}[command](answer, markdown)


def run(args: argparse.Namespace, spark) -> tuple[int, str]:
    """The exit code and what is printed."""
    from heftgraph.operators import session
    from heftgraph.sources import modules

    conf = settings.load(args.folder, args.controlled, args.lock, args.unlock, getattr(args, "platform", ()))
    policy = Policy(conf.controlled, conf.locked, conf.unlock)
    code = 0
    if args.command == "config":
        answer = {"target": conf.target, "controlled": list(conf.controlled), "lock": list(conf.locked), "unlock": list(conf.unlock), "cells": [c.label for c in conf.cells], "check": dict(conf.check)}
        return 0, json.dumps(answer, indent=2)
    if args.command == "modules":
        answer = tools.many(modules.listed(modules.packages(modules.read(spark, args.listing))), "module")
        return 0, json.dumps(answer["rows"], indent=2)
    if args.command == "matrix":
        cells = {}
        for text in args.cell:
            label, _, files = text.partition("=")
            binary, _, listing = files.partition(",")
            cells[settings.parse_cell(label).label] = lambda binary=binary, listing=listing: Analysis.of(spark, binary, listing, policy)
        answer = tools.platform_matrix(cells)
    else:
        a = Analysis.of(spark, args.binary, args.listing, policy, args.dump, args.sources)
        if args.command == "anatomy":
            answer = tools.anatomy(a)
            if args.hide_locked:
                answer["modules"] = tools.many(a.size_modules(True), "place")
        elif args.command == "prune":
            answer = tools.size_targets(a)
            if args.hide_locked:
                locked = {r["module"] for r in a.graph.classes.filter("locked").collect()}
                answer["candidates"]["rows"] = [r for r in answer["candidates"]["rows"] if r["module"] not in locked]
            if args.blame:
                answer["blame"] = tools.many(a.graph.shapley().drop("alone"), "module")
        elif args.command == "go-version":
            answer = tools.go_floor(a)
        elif args.command == "inspect":
            answer = tools.locate_cuts(a, args.module)
        elif args.command == "diff":
            answer = tools.diff(a, Analysis.of(spark, args.before_binary, args.before_listing, policy))
        else:
            answer = tools.check(a, _limits(conf.check), args.on_disk)
            code = 0 if answer["passes"] else 2
        if getattr(args, "why", False):
            answer["why"] = tools.many(session.import_why(a.graph), "root", "place")
    if args.format == "json":
        return code, json.dumps(answer, indent=2)
    return code, _text(args.command, answer, args.format == "markdown", args)


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"heftgraph {VERSION}")
        return 0
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("heftgraph").getOrCreate()
        if args.command == "serve":
            from heftgraph.server import Server

            Server(spark).serve(sys.stdin, sys.stdout)
            return 0
        code, text = run(args, spark)
    except Exception as e:  # whatever went wrong is told in a line, and by the exit code
        print(f"heftgraph: {texts.first_line(str(e)) or type(e).__name__}", file=sys.stderr)
        return 1
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
