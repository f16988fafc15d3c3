"""Deterministic outputs: canonical JSON, bundles with hashes, a guard against texts where none may go."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.functions import text as t


def canonical(df: DataFrame) -> Column:
    """A row as JSON with sorted keys."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def require_textless(df: DataFrame) -> DataFrame:
    """df, or an error if a record holds Arabic script or a long run of Latin prose."""
    bad = df.select(canonical(df).alias("j")).where(F.col("j").rlike(t.ARABIC) | F.col("j").rlike(r"[A-Za-z][A-Za-z ,;'’-]{79,}")).limit(1).count()
    if bad:
        raise ValueError("a manifest record holds text")
    return df


def write_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines, one directory of part files."""
    df.select(canonical(df).alias("value")).write.mode("errorifexists").text(path)


def write_bundle(members: dict[str, DataFrame], path: str, force: bool = False) -> str:
    """A zip of ordered JSON-lines members and a manifest of their hashes; returns the bundle's id.

    Members stream through the driver row by row; the file is moved into place when whole.
    """
    target = Path(path)
    if target.exists() and not force:
        raise FileExistsError(path)
    made: dict[str, dict] = {}
    part = target.with_suffix(".part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(members):
            if "/" in name or name.startswith("."):
                raise ValueError(f"{name} isn't a plain member name")
            digest, size = hashlib.sha256(), 0
            df = members[name]
            with z.open(zipfile.ZipInfo(f"{name}.jsonl", (1980, 1, 1, 0, 0, 0)), "w") as f:
                for row in df.select(canonical(df).alias("j")).toLocalIterator():
                    line = (row["j"] + "\n").encode()
                    f.write(line)
                    digest.update(line)
                    size += len(line)
            made[name] = {"sha256": digest.hexdigest(), "bytes": size}
        identity = json.dumps(made, sort_keys=True, separators=(",", ":"))
        bundle = hashlib.sha256(identity.encode()).hexdigest()
        z.writestr(zipfile.ZipInfo("manifest.json", (1980, 1, 1, 0, 0, 0)), json.dumps({"bundle_id": bundle, "members": made}, sort_keys=True, separators=(",", ":")) + "\n")
    os.replace(part, target)
    return bundle


def verify_bundle(path: str) -> dict:
    """The manifest, if every member is there once and has its hash and size."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        manifest = json.loads(z.read("manifest.json"))
        if sorted(names) != sorted([f"{m}.jsonl" for m in manifest["members"]] + ["manifest.json"]):
            raise ValueError("the members aren't those of the manifest")
        for m, facts in manifest["members"].items():
            data = z.read(f"{m}.jsonl")
            if len(data) != facts["bytes"] or hashlib.sha256(data).hexdigest() != facts["sha256"]:
                raise ValueError(f"{m} isn't what the manifest says")
        identity = json.dumps(manifest["members"], sort_keys=True, separators=(",", ":"))
        if hashlib.sha256(identity.encode()).hexdigest() != manifest["bundle_id"]:
            raise ValueError("the bundle's id doesn't fit its members")
    return manifest


def write_csv(df: DataFrame, path: str, columns: list[str], rows_per_file: int = 0) -> None:
    w = df.select(*columns).write.option("header", True).option("escape", '"')
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).csv(path)
