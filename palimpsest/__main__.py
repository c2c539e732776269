"""python -m palimpsest ROOT [PORT]: serve the entities kept under ROOT over HTTP."""

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .server import serve


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    engine = Engine(SparkSession.builder.appName("palimpsest").getOrCreate(), argv[0])
    with serve(engine, "0.0.0.0", int(argv[1]) if len(argv) > 1 else 3000) as server:
        server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
