"""python -m codelode walk ROOT | query NAME FOLDER [OUT] | names"""

from __future__ import annotations

import sys

from codelode.plans import catalogue
from codelode.session import local_session, ship
from codelode.sources.tree import TreeSource


def main(args: list[str]) -> int:
    if args[:1] == ["names"]:
        print(*catalogue.queries(), sep="\n")
        return 0
    if len(args) < 2 or args[0] not in ("walk", "query") or (args[0] == "query" and len(args) < 3):
        print(__doc__, file=sys.stderr)
        return 2
    spark = local_session()
    ship(spark)
    if args[0] == "walk":
        spark.dataSource.register(TreeSource)
        spark.read.format("tree").load(args[1]).orderBy("path").show(100, truncate=False)
        return 0
    if args[1] not in catalogue.queries():
        print(f"no query {args[1]}; names lists them", file=sys.stderr)
        return 1
    df = catalogue.queries()[args[1]](spark, args[2])
    if len(args) > 3:
        df.write.mode("overwrite").parquet(args[3])
    else:
        df.show(40, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
