"""Command line: search a data set for the trajectories of a query set and report the run as JSON.

    python -m nearpath.plans.run build --data DIR (--config FILE | flags) --out TABLE [--steps N]
    python -m nearpath.plans.run query --data DIR --queries DIR (--config FILE | flags) --out TABLE
        [--limit N] [--candidates FOLDER]

Flags: --resolution, -k, -l, --seed; with any of --bits, --radius, --errors, --in-weight, --split-threshold
a tree search, else a table search with --distance and --verify-fraction.
"""

from __future__ import annotations

import argparse
import itertools
import json
import time
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.config import LshConfig, TableConfig, TrieConfig, load
from nearpath.operators import collide, hamming, preprocess
from nearpath.plans.index import TableIndex, TrieIndex, family_for
from nearpath.sources import points

_TREE = {"bits": int, "radius": int, "errors": int, "in_weight": float, "split_threshold": float}


def grid(**options) -> Iterator[dict]:
    """Every combination of the listed values."""
    for values in itertools.product(*options.values()):
        yield dict(zip(options, values))


def list_datasets(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files and folders below a folder, on any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    plain = system.getFileStatus(top).getPath().toUri().getScheme() == "file"
    out, left = [], [top]
    while left:
        for status in system.listStatus(left.pop()):
            path = status.getPath()
            if path.getName().endswith(".parquet"):
                if not path.getName().startswith("part-"):
                    out.append(path.toUri().getPath() if plain else path.toString())
            elif status.isDirectory():
                left.append(path)
    return sorted(out)


def index_for(data: DataFrame, lsh: LshConfig, config: TrieConfig | TableConfig) -> TableIndex | TrieIndex:
    return (TrieIndex if isinstance(config, TrieConfig) else TableIndex)(data, lsh, config)


def settings(a: argparse.Namespace) -> tuple[LshConfig, TrieConfig | TableConfig]:
    """From the file, or from the flags."""
    if a.config:
        return load(a.config)
    if a.resolution is None:
        raise SystemExit("either --config or --resolution is needed")
    lsh = LshConfig(**{n: v for n in ("resolution", "k", "l", "seed") if (v := getattr(a, n)) is not None})
    tree = {n: v for n in _TREE if (v := getattr(a, n)) is not None}
    if tree:
        return lsh, TrieConfig(distance=a.distance, **tree)
    return lsh, TableConfig(distance=a.distance, verify_fraction=a.verify_fraction)


def memory_sample(spark: SparkSession, table: str | None = None) -> dict:
    """Bytes: the driver's resident and virtual memory, its JVM's heap in use, and a written table."""
    status = dict(line.split(":", 1) for line in Path("/proc/self/status").read_text().splitlines() if ":" in line)
    jvm = spark._jvm.java.lang.Runtime.getRuntime()
    out = {"memory": int(status["VmRSS"].split()[0]) * 1024, "virtual_memory": int(status["VmSize"].split()[0]) * 1024, "heap": jvm.totalMemory() - jvm.freeMemory()}
    if table is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        out["index_size"] = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return out


def build(data: DataFrame, lsh: LshConfig, out: str, steps: int = 1) -> dict[int, dict]:
    """Append the signatures in so many steps; a memory sample by the number of trajectories so far."""
    family, samples, n = family_for(lsh), {}, 0
    for step in range(steps):
        part = data if steps == 1 else data.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) == step)
        collide.signatures(part, family).write.mode("append").parquet(out)
        n += part.count()
        samples[n] = memory_sample(data.sparkSession, out)
    return samples


def index_stats(signed: DataFrame, config: TrieConfig | TableConfig) -> dict:
    """Leaves and splits of the tree, or distinct hashes of each table."""
    if isinstance(config, TrieConfig):
        codes = signed.withColumnRenamed("hashes", "code")
        return hamming.index_statistics(codes, hamming.leaf_depths(codes, config), config).first().asDict()
    return {str(r.t): r.distinct_hashes for r in collide.distinct_hashes(signed).orderBy("t").collect()}


def report(name: str, pairs: DataFrame, seconds: dict[str, float], **more) -> dict:
    """Run statistics; of the result only its counts reach the driver."""
    row = pairs.agg(F.count("*").alias("pairs"), F.countDistinct("query").alias("queries")).first()
    return {"name": name, "index_query_size": row.pairs, "queries_with_candidates": row.queries, **{k: round(v, 3) for k, v in seconds.items()}, **more}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Trajectory similarity search")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "query"):
        p = commands.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--config", "-c")
        p.add_argument("--out", required=True)
        p.add_argument("--limit", type=int, help="only the first trajectories of the data set, by id")
        p.add_argument("--resolution", type=float)
        for n in "kl":
            p.add_argument(f"-{n}", type=int)
        p.add_argument("--seed", type=int)
        for n, kind in (*_TREE.items(), ("distance", float), ("verify_fraction", float)):
            p.add_argument("--" + n.replace("_", "-"), type=kind)
        p.add_argument("--steps", type=int, default=1, help="parts of the build, with a memory sample after each")
        if name == "query":
            p.add_argument("--queries", required=True)
            p.add_argument("--candidates", help="folder for the candidates of each query as JSON")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    lsh, config = settings(a)
    given = {"dataset": a.data, "config": {"lsh": asdict(lsh), "index": asdict(config)}}
    began = time.perf_counter()
    data = points.assemble(points.read_points(spark, a.data))
    data = points.first_n(data, a.limit) if a.limit else data
    n, loaded = data.count(), time.perf_counter()
    if a.command == "build":
        mem = build(data, lsh, a.out, a.steps)
        took = {"dataset_load": round(loaded - began, 3), "index_build_time": round(time.perf_counter() - loaded, 3)}
        print(json.dumps({"name": "build", **given, "trajectories": n, "max_points": preprocess.max_points(data), **took, "mem": mem, "index_stats": index_stats(spark.read.parquet(a.out), config)}))
        return
    queries = points.assemble(points.read_points(spark, a.queries))
    asked = time.perf_counter()
    points.write_pairs(index_for(data, lsh, config).query(queries), a.out)
    took = {"dataset_load": loaded - began, "index_query_time": time.perf_counter() - asked}
    pairs = spark.read.parquet(a.out)
    if a.candidates:
        points.write_results_json(pairs, a.candidates, "query")
    print(json.dumps(report("query", pairs, took, **given, queryset=a.queries, mem={n: memory_sample(spark, a.out)})))


if __name__ == "__main__":
    main()
