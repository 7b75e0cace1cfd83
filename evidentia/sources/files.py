"""Configurations, document trees, snapshots, run bundles, matrices, reports and receipts, through any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json
import platform
import posixpath
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.validation import digest
from evidentia.sources import trec
from evidentia.sources.publish import publish


class PathBoundaryError(ValueError):
    """A path outside the folders that may be written."""


def require_write_path(path: str, roots: Iterable[str], protected: Iterable[str] = ()) -> str:
    """`path` in normal form, if it lies below one of `roots` and below none of `protected`; a path with `..` is refused."""
    if ".." in path.split("/"):
        raise PathBoundaryError(f"{path} leaves its folder")
    scheme, mark, rest = path.rpartition("://") if "://" in path else ("", "", path)
    plain = scheme + mark + posixpath.normpath(rest)
    below = lambda base: plain == base.rstrip("/") or plain.startswith(base.rstrip("/") + "/")
    if not any(map(below, roots)) or any(map(below, protected)):
        raise PathBoundaryError(f"{path} may not be written")
    return plain


def canonical(record: object) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(*parts: object, length: int = 40) -> str:
    """A hash of records, the same whenever they are."""
    return hashlib.sha256("\0".join(map(canonical, parts)).encode()).hexdigest()[:length]


def write_json(spark: SparkSession, record: object, path: str) -> None:
    """One file of canonical JSON; the commit of the job makes it appear whole or not at all."""
    publish(spark, path, spark.createDataFrame([(canonical(record),)], "value string").coalesce(1).write.text)


def read_json(spark: SparkSession, path: str) -> dict:
    """A configuration or manifest; anything but one JSON object raises."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    record = json.loads(text)
    if not isinstance(record, dict):
        raise ValueError(f"{path} holds no object")
    return record


def documents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, sha256, text) of all files below `root` whose name fits, name being the path below it; a byte-order mark at a text's start goes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/")
    name = F.substring_index("path", f"{base.split('://')[-1]}/", -1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), text.alias("text"))


def snapshot(spark: SparkSession, root: str) -> dict[str, dict]:
    """Bytes and SHA-256 of each file below `root`, such as a model's: one row a file reaches the driver."""
    return {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in documents(spark, root).select("name", "bytes", "sha256").collect()}


def check_snapshot(spark: SparkSession, root: str, expected: dict[str, dict]) -> None:
    """Raise for files that are missing, new or changed."""
    found = snapshot(spark, root)
    if wrong := sorted(n for n in found.keys() | expected.keys() if found.get(n) != expected.get(n)):
        raise ValueError(f"{root} differs from its manifest: {', '.join(wrong[:5])}")


def write_run_bundle(run: DataFrame, qrels: DataFrame, metrics: DataFrame, config: dict, system: str, root: str, cards: DataFrame | None = None) -> dict:
    """Write a run's configuration, TREC file, first ten items with their grades, metrics and, if given, cards (query_id, ..) below `root`/<run id>, and return its manifest.

    The id hashes the configuration and the digests of run and judgments, so the same inputs give the same folder. The folder appears as a whole, once all in it
    has been read back.
    """
    spark = run.sparkSession
    rows = run.select("query_id", "item_id", "rank", "score")
    inputs = {"run": digest(rows).first().asDict(), "qrels": digest(qrels.select("query_id", "item_id", "grade")).first().asDict()}
    run_id = identity(system, config, inputs)
    top = rows.where("rank <= 10").join(qrels.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")
    manifest: dict = {"id": run_id, "system": system, "inputs": inputs}

    def write(at: str) -> None:
        write_json(spark, config, f"{at}/config")
        trec.write_run(rows, f"{at}/run.trec", system)
        trec.write_json_lines(top, f"{at}/top10", "query_id")
        trec.write_json_lines(metrics, f"{at}/metrics", metrics.columns[0])
        if cards is not None:
            trec.write_json_lines(cards, f"{at}/cards", "query_id")
        manifest["outputs"] = {n: _lines_digest(spark, f"{at}/{n}") for n in ("config", "run.trec", "top10", "metrics", *(["cards"] if cards is not None else []))}
        write_json(spark, manifest, f"{at}/manifest")

    publish(spark, f"{root.rstrip('/')}/{run_id}", write, lambda at: read_json(spark, f"{at}/manifest"))
    return manifest


def _lines_digest(spark: SparkSession, path: str) -> dict:
    return digest(spark.read.text(path)).first().asDict()


def read_approved_run(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    """The run of a matrix entry (id, system, manifest_sha256); raises unless manifest, identity and file are those that were approved."""
    at = f"{root.rstrip('/')}/{entry['id']}"
    manifest = read_json(spark, f"{at}/manifest")
    if identity(manifest, length=64) != entry["manifest_sha256"]:
        raise ValueError(f"manifest of run {entry['id']} has changed")
    if (manifest["id"], manifest["system"]) != (entry["id"], entry["system"]):
        raise ValueError(f"run {entry['id']} is another run")
    if _lines_digest(spark, f"{at}/run.trec") != manifest["outputs"]["run.trec"]:
        raise ValueError(f"file of run {entry['id']} has changed")
    return trec.read_run(spark, f"{at}/run.trec")


def read_matrix(spark: SparkSession, root: str, matrix: dict, queries: DataFrame) -> dict[str, DataFrame]:
    """All runs of a matrix, by system, once every one of them is as approved and has exactly the given queries (query_id)."""
    runs = {e["system"]: read_approved_run(spark, root, e) for e in matrix["runs"]}
    wanted = queries.select(F.col("query_id").cast("string")).distinct()
    for system, run in runs.items():
        have = run.select("query_id").distinct()
        if not have.exceptAll(wanted).isEmpty() or not wanted.exceptAll(have).isEmpty():
            raise ValueError(f"run of {system} has other queries")
    return runs


def matrix_manifest(manifests: list[dict]) -> dict:
    """A matrix of runs: entries in order of system and id, and an id that hashes them."""
    entries = [{"id": m["id"], "system": m["system"], "manifest_sha256": identity(m, length=64)} for m in sorted(manifests, key=lambda m: (m["system"], m["id"]))]
    return {"id": identity(entries), "runs": entries}


def markdown_table(rows: DataFrame, order: str, most: int = 1000) -> str:
    """A report's table of `rows` in order of a column; a report has at most `most` rows, more raise."""
    got = rows.orderBy(order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in got)]) + "\n"


def write_report(spark: SparkSession, title: str, sections: dict[str, DataFrame], order: dict[str, str], path: str) -> str:
    """Write and return a report: a heading and a table for each section."""
    text = f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(rows, order[name])}" for name, rows in sections.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def receipt(spark: SparkSession, phase: str) -> dict:
    """What a phase ran on: versions, master, cores, time zone and shuffle partitions."""
    conf = spark.conf
    return {
        "phase": phase,
        "python": sys.version.split()[0],
        "spark": spark.version,
        "platform": platform.platform(),
        "master": spark.sparkContext.master,
        "cores": spark.sparkContext.defaultParallelism,
        "time_zone": conf.get("spark.sql.session.timeZone"),
        "shuffle_partitions": conf.get("spark.sql.shuffle.partitions"),
    }
