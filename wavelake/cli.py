"""python -m wavelake.cli COMMAND FILE [--patient] [--limit N] [--list]: header, validate, events, gaps, signals or json.

Exit codes: 0 fine, 1 unreadable or failed validation, 2 bad usage.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .diagnostics import summarize
from .errors import WaveError
from .functions.text import printable
from .functions.ticks import to_seconds
from .operators.annotations import counts_by_text
from .operators.validate import validate
from .recording import open_recording
from .report import PRIVATE, format_annotations, format_diagnostics, format_header, format_validation

COMMANDS = ("header", "validate", "events", "gaps", "signals", "json")


class UsageError(Exception):
    pass


def parse_args(argv: list[str]) -> dict:
    args = {"command": None, "file": None, "patient": False, "list": False, "limit": None, "color": False}
    rest = list(argv)
    while rest:
        word = rest.pop(0)
        if word in ("--patient", "--list", "--color"):
            args[word[2:]] = True
        elif word == "--limit" or word.startswith("--limit="):
            value = word.partition("=")[2] or (rest.pop(0) if rest else "")
            if not value.isdigit():
                raise UsageError("--limit takes a whole number")
            args["limit"] = int(value)
        elif word.startswith("--"):
            raise UsageError(f"unknown option {word}")
        elif args["command"] is None:
            args["command"] = word
        elif args["file"] is None:
            args["file"] = word
        else:
            raise UsageError(f"one file at a time, not also {word}")
    if args["command"] not in COMMANDS:
        raise UsageError(f"a command is one of {', '.join(COMMANDS)}")
    if args["file"] is None:
        raise UsageError("no file given")
    return args


def run(args: dict, spark: SparkSession, out: Callable[[str], None]) -> int:
    r = open_recording(spark, args["file"])
    h, hide = r.header, () if args["patient"] else PRIVATE
    found = [*h.diagnostics, *r.timeline["diagnostics"]]
    if args["command"] == "header":
        out(format_header(h, args["patient"]))
        out(format_diagnostics(found, args["color"], args["limit"], hide))
        out(f"From the record probes: start offset {to_seconds(r.timeline['start_offset_ticks'])} s, span {to_seconds(r.timeline['span_ticks'])} s, covered {to_seconds(r.timeline['covered_ticks'])} s")
    elif args["command"] == "validate":
        report = validate(r, scan_samples=True)
        out(format_validation(report, args["color"], args["limit"], hide))
        return 0 if report["ok"] else 1
    elif args["command"] == "events":
        if args["list"]:
            rows = r.annotations().limit(args["limit"] + 1).collect() if args["limit"] is not None else r.annotations().collect()
            shown = rows[: args["limit"]]
            for a in shown:
                out("\t".join([str(to_seconds(a["onset_ticks_from_first_record"])), "" if a["duration_ticks"] is None else str(to_seconds(a["duration_ticks"])), printable(a["text"]), printable(a["channel_label"] or "")]))
            if len(shown) < len(rows):
                out("... more events follow; raise --limit")
        else:
            for row in counts_by_text(r.annotations()).collect()[: args["limit"]]:
                out(f"{row['count']}\t{printable(row['text'])}")
    elif args["command"] == "gaps":
        r.build_index()
        for g in r.gaps()[: args["limit"]]:
            out(f"{to_seconds(g['start_ticks'])}\t{to_seconds(g['end_ticks'])}\t{to_seconds(abs(g['duration_ticks']))}\t{'overlap' if g['duration_ticks'] < 0 else 'gap'}")
        out(r.contiguity())
    elif args["command"] == "signals":
        for s in h.signals:
            out("\t".join(map(str, (s.index, printable(s.label), s.kind, "" if s.sample_rate_hz is None else s.sample_rate_hz, printable(s.physical_dimension), s.samples_per_record))))
    else:
        body = {"variant": h.variant, "records": h.record_count, "span_seconds": to_seconds(r.timeline["span_ticks"]), "signals": [{"index": s.index, "label": s.label, "kind": s.kind, "sample_rate_hz": s.sample_rate_hz, "samples_per_record": s.samples_per_record} for s in h.signals], "diagnostics": [c for c, _, n in summarize(found)["by_code"] for _ in range(n)]}
        out(json.dumps(body | ({"patient": h.patient["raw"].strip(), "recording": h.recording["raw"].strip()} if args["patient"] else {})))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parse_args(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"{e}\n{__doc__}", file=sys.stderr)
        return 2
    try:
        spark = SparkSession.builder.appName("wavelake").getOrCreate()
        return run(args, spark, print)
    except (WaveError, OSError) as e:
        print(f"{args['file']}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
