"""``python -m lumenql FOLDER TABLE,TABLE,... [SCRIPT]``: run a script (or what
comes from standard input) over a folder of Parquet tables, print the results."""

from __future__ import annotations

import sys

from .engine import Engine, StatementError
from .plans.dialect import statements
from .session import session
from .sources.delimited import grid_lines


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    engine = Engine(session())
    engine.open(args[0], args[1].split(","))
    script = open(args[2]).read() if len(args) > 2 else sys.stdin.read()
    failed = 0
    for s in statements(script):
        try:
            found = engine.execute(s)
            for line in ["done"] if found is None else grid_lines(found):
                print(line)
        except StatementError as e:
            failed += 1
            print(f"error: {e}")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
