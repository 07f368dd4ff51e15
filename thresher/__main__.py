"""python -m thresher [folder]: print the functions of the changed files of a work tree."""

from __future__ import annotations

import sys

from thresher.plans.pipeline import analyse_changed, stream
from thresher.session import local_session


def main(args: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    for chunk in stream(analyse_changed(spark, args[0] if args else None)):
        print(f"\n{[f.asDict() | {'path': chunk['path']} for f in chunk['fragments']]}\n")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
