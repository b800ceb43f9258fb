"""python -m quireframe import BOOKS STORE | preview FILE [CLASS...] | export STORE TO | dump STORE TO"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, *rest = args
    if command == "preview":
        from quireframe.api import region_preview

        print(region_preview(Path(rest[0]).read_text(encoding="utf-8"), rest[1:] or None))
        return 0
    from quireframe.functions.breaks import suppressions
    from quireframe.operators import importing, store
    from quireframe.schema import RCLASSES
    from quireframe.session import ship
    from quireframe.sources import books, export

    spark = SparkSession.builder.appName("quireframe").getOrCreate()
    ship(spark)
    if command == "import":
        found = books.read_books(spark, f"{rest[0]}/*.txt")
        if list(Path(rest[0]).glob("*.regions.csv")):
            found = books.with_given(found, books.read_regions(spark, f"{rest[0]}/*.regions.csv"))
        importing.save(importing.annotate(found, suppressions(spark)), rest[1])
    elif command == "export":
        t = importing.load(spark, rest[0])
        export.write_texts(t["book"], f"{rest[1]}/texts")
        export.write_regions(export.region_rows(store.regions(t["text_region"]), t["book"], RCLASSES), f"{rest[1]}/regions")
    elif command == "dump":
        importing.dump(spark, rest[0], rest[1])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
