"""python -m quarry index|check|extract|recompress ..."""

from __future__ import annotations

import argparse
import atexit
import os
import sys
import tempfile

from quarry import __version__


#: What is said of a recompressed file; fixed values, as users look for them.
FAILED = "Repair Failed"
DONE = "{n} records read and recompressed to file: {output}"
REPAIRED, WHOLE = "Compression Errors Found and Fixed!", "No Errors Found!"
#: What is said of a file that can't be read on; fixed value.
SKIPPED = "skipping rest of file"


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _inputs(names: list[str]) -> list[str]:
    """Files; - is standard input, kept in a temporary file until the process ends."""
    out = []
    for n in names or ["-"]:
        if n == "-":
            with tempfile.NamedTemporaryFile(delete=False, suffix=".warc") as f:
                f.write(sys.stdin.buffer.read())
            n = f.name
            atexit.register(os.unlink, n)
        out.append(os.path.abspath(n))
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("-V", "--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("index")
    p.add_argument("inputs", nargs="*")
    p.add_argument("-f", "--fields", default="offset,warc-type,warc-target-uri")
    p.add_argument("-o", "--output")
    p.add_argument("--folder", help="write the lines from the workers as text files below a new folder, in no order")
    p = sub.add_parser("check")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-v", "--verbose", action="store_true")
    p = sub.add_parser("extract")
    p.add_argument("filename")
    p.add_argument("offset", type=int)
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--payload", action="store_true")
    kind.add_argument("--headers", action="store_true")
    p = sub.add_parser("recompress")
    p.add_argument("filename")
    p.add_argument("output")
    p.add_argument("-v", "--verbose", action="store_true")
    given = parser.parse_args(args)

    from quarry.codec.container import ArchiveError
    from quarry.operators import archive

    if given.cmd == "extract":
        sys.stdout.buffer.write(archive.extract(given.filename, given.offset, "payload" if given.payload else "headers" if given.headers else "record"))
        return 0
    spark = _session()
    if given.cmd == "recompress":
        try:
            n, repaired = archive.recompress(spark, os.path.abspath(given.filename), given.output)
        except ArchiveError as e:
            print(FAILED + (f": {e}" if given.verbose else ""), file=sys.stderr)
            return 1
        print(DONE.format(n=n, output=given.output))
        print(REPAIRED if repaired else WHOLE)
        return 0
    failed = 0
    if given.cmd == "index" and given.folder:
        rows = archive.read(spark, _inputs(given.inputs), arc2warc=True, parse_http=archive.needs_http(given.fields), payload="none", mode="failfast")
        archive.index_lines(archive.index(rows, given.fields)).write.text(given.folder)
        return 0
    out = open(given.output, "w") if given.cmd == "index" and given.output else sys.stdout
    for name in _inputs(given.inputs):
        if given.cmd == "index":
            rows = archive.read(spark, name, arc2warc=True, parse_http=archive.needs_http(given.fields), payload="none", mode="failfast")
            lines = archive.index_lines(archive.index(rows.coalesce(1), given.fields))
            for r in lines.toLocalIterator():
                print(r.value, file=out)
            continue
        rows = archive.check(archive.read(spark, name, check_digests=True, payload="none"))
        shown = False
        for r in rows.coalesce(1).toLocalIterator():
            failed |= r.verdict in ("fail", "error")
            said = list(r.problems) if r.verdict == "fail" else [r.error, SKIPPED] if r.verdict == "error" else [archive.MESSAGES[r.verdict]] if given.verbose else []
            if said:
                if not shown:
                    print(name)
                    shown = True
                print("  offset", r.offset, "WARC-Record-ID", r.record_id, r.rec_type)
                for s in said:
                    print("    " + s)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
