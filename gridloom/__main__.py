"""Commands: encode, append, validate, info, doctor, stac, bands, consolidate, plan, publish."""

from __future__ import annotations

import argparse
import json
import sys


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gridloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def encode(a: argparse.Namespace) -> int:
    """A table of pixels (t, b, y, x, v) with rising times becomes a store with overviews."""
    from gridloom.operators import pyramid
    from gridloom.sources import zarr

    spark = _spark()
    px = pyramid.pyramid(spark.read.parquet(a.pixels), a.height, a.width, a.levels)
    out = zarr.write_levels(px, a.store, a.times, a.bands, a.height, a.width, a.levels, cell=a.cell, codec=a.codec, shard=a.shard)
    print(f"{out.count()} objects")
    return 0


def append(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from gridloom.operators import pyramid
    from gridloom.sources import zarr

    about = zarr.describe(a.store)
    base, spark = about["levels"][0], _spark()
    new = spark.read.parquet(a.pixels).withColumn("t", F.col("t") + len(about["times"]))
    px = pyramid.pyramid(new, base["height"], base["width"], len(about["levels"]) - 1)
    print(f"{zarr.append_steps(px, a.store, a.times, cell=a.cell, codec=a.codec).count()} objects")
    return 0


def validate(a: argparse.Namespace) -> int:
    from gridloom.sources import zarr

    found = zarr.validate(a.store) + [("problem", place, f"consolidated metadata is {what}") for place, what in zarr.stale_metadata(a.store)]
    for severity, place, message in found:
        print(f"{severity}: {place}: {message}")
    return int(any(s == "problem" for s, _, _ in found))


def info(a: argparse.Namespace) -> int:
    from gridloom.sources import zarr

    print(json.dumps(zarr.describe(a.store), indent=1))
    return 0


def doctor(a: argparse.Namespace) -> int:
    """Rules of metadata, then every chunk of every level is decoded."""
    from gridloom.sources import zarr

    bad = validate(a)
    about = zarr.describe(a.store)
    for level in range(len(about["levels"])):
        print(f"level {level}: {zarr.open_store(_spark(), a.store, level).count()} pixels decoded")
    return bad


def stac(a: argparse.Namespace) -> int:
    from datetime import UTC, datetime

    from gridloom.sources import zarr

    about = zarr.describe(a.store)
    iso = [datetime.fromtimestamp(t / 1000, UTC).isoformat().replace("+00:00", "Z") for t in (about["times"][0], about["times"][-1])]
    print(json.dumps({"type": "Collection", "stac_version": "1.0.0", "id": a.store.rstrip("/").rpartition("/")[2], "extent": {"temporal": {"interval": [iso]}}, "summaries": {"bands": about["bands"]}}, indent=1))
    return 0


def bands(a: argparse.Namespace) -> int:
    from gridloom.sources import zarr

    print(" ".join(zarr.set_bands(a.store, dict(r.split("=", 1) for r in a.roles))))
    return 0


def consolidate(a: argparse.Namespace) -> int:
    from gridloom.sources import zarr

    print(f"{zarr.consolidate(a.store)} nodes")
    return 0


def plan(a: argparse.Namespace) -> int:
    """Dates that names in a folder hold."""
    from gridloom.sources import manifest

    manifest.list_rasters(_spark(), a.folder, a.date_pattern).orderBy("day", "uri").show(a.rows, truncate=False)
    return 0


def publish(a: argparse.Namespace) -> int:
    from gridloom.sources import zarr

    zarr.publish_local(a.staged, a.store)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(required=True)
    for f in (encode, append, validate, info, doctor, stac, bands, consolidate, plan, publish):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        if f in (encode, append):
            p.add_argument("pixels")
        if f is publish:
            p.add_argument("staged")
        p.add_argument("folder" if f is plan else "store")
        if f in (encode, append):
            p.add_argument("--times", type=int, nargs="+", required=True, help="milliseconds since 1970")
            p.add_argument("--cell", type=int, default=512)
            p.add_argument("--codec", default="zstd", choices=["zstd", "gzip", "none"])
        if f is encode:
            p.add_argument("--bands", nargs="+", required=True)
            for name, default in (("height", None), ("width", None), ("levels", 2), ("shard", 0)):
                p.add_argument(f"--{name}", type=int, default=default, required=default is None)
        if f is bands:
            p.add_argument("roles", nargs="+", help="BAND=ROLE")
        if f is plan:
            p.add_argument("--date-pattern")
            p.add_argument("--rows", type=int, default=1000)
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
