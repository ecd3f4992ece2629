"""Promotion that can fail half way: staged versions, order-free fingerprints, a manifest that readers follow."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_current.json"


class Refused(ValueError):
    """A promotion that would change what may not change."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def content_print(rows: DataFrame) -> tuple[int, str]:
    """(rows, a sum over hashes of all rows), the same in any order and of any partitioning; repeated rows count as often."""
    columns = sorted(rows.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    n, a, b = rows.agg(F.count("*"), *halves).first()
    return n, f"{int(a or 0) % (1 << 60):015x}{int(b or 0) % (1 << 60):015x}"


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of what is live under root; None before the first promotion."""
    path, fs = _path(spark, f"{root}/{MANIFEST}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_live(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the live version; a reader that began before a promotion goes on with the version it began with."""
    manifest = current(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"nothing is promoted under {root}")
    return spark.read.parquet(f"{root}/{manifest['version']}")


def stage(rows: DataFrame, root: str) -> dict:
    """Writes a version beside the live one and reads it back; returns its manifest, which nothing follows yet."""
    version = f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{version}")
    n, seal = content_print(rows.sparkSession.read.parquet(f"{root}/{version}"))
    return {"version": version, "rows": n, "print": seal}


def census(rows: DataFrame, label: str) -> dict:
    """Label to [rows, print]: labels are kinds, of which there are few (at most 10,000)."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("p"))
    found = counted.limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError(f"{label} has more than 10,000 values")
    return {str(r[label]): [r["n"], r["p"]] for r in found}


def promote(spark: SparkSession, root: str, staged: dict, label: str | None = None, protected: list[str] | None = None, keep: int = 2) -> dict:
    """Makes a staged version live by replacing the manifest, in one rename; returns the manifest.

    Refused (the live version stays) if the staged files no longer have the print they were staged with, or if the rows of a
    protected label differ from the live version's. Promoting the live version again changes nothing. Until the rename
    readers see the old version whole, after it the new one whole; what a failure leaves behind is a version that nothing
    follows, and `keep` versions before the live one stay for readers under way."""
    rows = spark.read.parquet(f"{root}/{staged['version']}")
    if list(content_print(rows)) != [staged["rows"], staged["print"]]:
        raise Refused(f"{staged['version']} is not what was staged")
    live = current(spark, root)
    if live and live["version"] == staged["version"]:
        return live
    manifest = dict(staged, before=([live["version"], *live.get("before", [])] if live else [])[:keep])
    if label:
        manifest["census"] = census(rows, label)
        old = (live or {}).get("census", {})
        changed = sorted(x for x in protected or [] if x in old and manifest["census"].get(x) != old[x])
        if changed:
            raise Refused(f"protected labels changed: {', '.join(changed)}")
    _replace(spark, root, manifest)
    return manifest


def _replace(spark: SparkSession, root: str, manifest: dict) -> None:
    """The manifest is written whole under another name, then takes the old one's place."""
    fresh, fs = _path(spark, f"{root}/_next-{uuid.uuid4().hex}.json")
    stream = fs.create(fresh)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    target, _ = _path(spark, f"{root}/{MANIFEST}")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context.rename(fresh, target, overwrite)


def verify(spark: SparkSession, root: str) -> dict:
    """found and expected rows and print of the live version, and ok."""
    manifest = current(spark, root)
    if manifest is None:
        return {"ok": False, "found": None, "expected": None}
    found = list(content_print(read_live(spark, root)))
    return {"ok": found == [manifest["rows"], manifest["print"]], "found": found, "expected": [manifest["rows"], manifest["print"]]}
