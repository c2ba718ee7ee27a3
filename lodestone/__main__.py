"""A shell over one folder of indexes: ``python -m lodestone FOLDER COMMAND ...``.

    put INDEX KEY VALUE | get INDEX KEY | delete INDEX KEY
    range INDEX START END [LIMIT] | query STATEMENT | txn INDEX OP...
    compact INDEX | status INDEX

An OP of a transaction is ``put:KEY=VALUE`` or ``delete:KEY``.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import LodestoneError


def run(engine: Engine, command: str, args: list[str]) -> list[str]:
    """Lines of the answer."""
    named = re.search(r"(?is)\b(?:from|into|update)\s+(\w+)", args[0]) if command == "query" and args else None
    index = named[1] if named else args[0]
    engine.create(index)
    match command, args:
        case "put", [_, key, value]:
            engine.put(index, key, value)
            return ["ok"]
        case "get", [_, key]:
            found, value = engine.get(index, key)
            return [value or ""] if found else ["(not found)"]
        case "delete", [_, key]:
            return ["ok" if engine.delete(index, key) else "(not found)"]
        case "range", [_, start, end, *limit]:
            return [f"{r['key']}\t{r['value']}" for r in engine.get_range(index, start, end, int(limit[0]) if limit else 10000).collect()]
        case "query", [statement]:
            found = engine.gql(statement)
            return ["\t".join(map(str, r)) for r in found.df.collect()] if found.df is not None else [f"{found.rows_affected} rows"]
        case "txn", [_, *ops]:
            txn = engine.begin(index)
            for op in ops:
                kind, _, rest = op.partition(":")
                key, _, value = rest.partition("=")
                txn.put(key, value) if kind == "put" else txn.delete(key)
            return [txn.commit()]
        case "compact", [_]:
            engine.compact(index)
            return ["ok"]
        case "status", [_]:
            return [f"lsn {engine.log(index).last_lsn()}", f"keys {engine.size(index)}"]
    raise SystemExit(__doc__)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("folder")
    parser.add_argument("command", choices="put get delete range query txn compact status".split())
    parser.add_argument("args", nargs="+")
    asked = parser.parse_args(argv)
    try:
        print("\n".join(run(Engine(SparkSession.builder.getOrCreate(), asked.folder), asked.command, asked.args)))
    except LodestoneError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
