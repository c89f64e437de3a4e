"""Command line: run a request, list fonts, serve JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quiresmith.operators import fonts, runner
from quiresmith.sources import epub


def _families(spark: SparkSession, files: list[str]) -> list[dict]:
    members = epub.members(epub.books(spark, files))
    bad = {r.book_id: r.error for r in members.where("error IS NOT NULL").select("book_id", "error").collect()}
    good = {r.book_id: r.families for r in fonts.list_families(members.where("error IS NULL")).collect()}
    return [{"ok": b not in bad, "input_file": b, "font_families": good.get(b, []), "error": bad.get(b)} for b in sorted({*bad, *good})]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quiresmith")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("request", help="a JSON file, or - for standard input")
    for name in ("list-fonts", "list-fonts-batch"):
        commands.add_parser(name).add_argument("files", nargs="+")
    commands.add_parser("serve")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("quiresmith").getOrCreate()
    say = lambda x: print(runner.json_line(x), flush=True)
    if given.command == "run":
        text = sys.stdin.read() if given.request == "-" else open(given.request).read()  # noqa: SIM115
        done = runner.run(spark, runner.Request.of(json.loads(text)))
        for event in done["events"]:
            say(event)
        say(done["result"])
        return 0 if done["result"]["ok"] else 1
    if given.command == "serve":
        for line in sys.stdin:
            key = None
            try:
                payload = json.loads(line)
                key = payload.get("request_id")
                if payload.get("command") == "list-fonts-batch":
                    say({"event": "worker.response", "request_id": key, "ok": True, "result": _families(spark, payload["input_files"])})
                else:
                    result = runner.run(spark, runner.Request.of(payload.get("request", payload)))["result"]
                    say({"event": "worker.response", "request_id": key, "ok": True, "result": result})
            except Exception as e:
                say({"event": "worker.response", "request_id": key, "ok": False, "error": f"{type(e).__name__}: {e}"})
        return 0
    found = _families(spark, given.files)
    for row in found:
        say(row)
    return 0 if all(r["ok"] for r in found) else 1


if __name__ == "__main__":
    sys.exit(main())
