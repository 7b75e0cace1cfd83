"""A closed-loop load generator over one session, and summaries of its request log."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.numeric import rounded
from evidentia.operators.metrics import percentiles

#: Warm-up requests, least requests and seconds of a measurement, and the harness's largest share.
WARM_UP, LEAST_REQUESTS, LEAST_SECONDS, MOST_OVERHEAD = 20, 1024, 60.0, 0.05
LOG = "request int, worker int, queued_ns long, service_ns long"


def closed_loop(spark: SparkSession, request: Callable[[int], object], concurrency: int, requests: int = LEAST_REQUESTS, seconds: float = LEAST_SECONDS, warm_up: int = WARM_UP) -> DataFrame:
    """LOG rows of requests by `concurrency` workers, each sending its next when its last has ended, until both bounds are met.

    Workers' jobs share the session in fair scheduler pools.
    """
    for i in range(warm_up):
        request(i)
    log: list[tuple[int, int, int, int]] = []
    lock, began, sent = threading.Lock(), time.perf_counter(), 0

    def work(worker: int) -> None:
        nonlocal sent
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"worker-{worker}")
        ready = time.perf_counter_ns()
        while True:
            with lock:
                if sent >= requests and time.perf_counter() - began >= seconds:
                    return
                number, sent = sent, sent + 1
            start = time.perf_counter_ns()
            request(number)
            end = time.perf_counter_ns()
            with lock:
                log.append((number, worker, start - ready, end - start))
            ready = end

    with ThreadPoolExecutor(concurrency) as pool:
        for f in [pool.submit(work, w) for w in range(concurrency)]:
            f.result()
    return spark.createDataFrame(log, LOG)


def summary(log: DataFrame) -> DataFrame:
    """One row of requests, service percentiles in milliseconds, the harness's share of the loop, and whether it is small enough."""
    share = F.sum("queued_ns") / (F.sum("queued_ns") + F.sum("service_ns"))
    return log.agg(F.count("*").alias("requests"), *percentiles(F.col("service_ns") / 1e6), rounded(share).alias("overhead"), (share <= MOST_OVERHEAD).alias("accepted"))


def resources() -> dict[str, int]:
    """Peak and present resident bytes of this process, and its CPU nanoseconds."""
    import resource

    use = resource.getrusage(resource.RUSAGE_SELF)
    with open("/proc/self/statm") as f:
        pages = int(f.read().split()[1])
    return {"peak_bytes": use.ru_maxrss * 1024, "resident_bytes": pages * resource.getpagesize(), "cpu_ns": int((use.ru_utime + use.ru_stime) * 1e9)}


class Sampler:
    """Resources every `seconds` while a block runs; `rows` has them afterwards, with nanoseconds since it began."""

    def __init__(self, seconds: float = 1.0) -> None:
        self.seconds, self.rows, self._stop = seconds, [], threading.Event()

    def __enter__(self) -> Sampler:
        began = time.perf_counter_ns()

        def take() -> None:
            while True:
                self.rows.append({"at_ns": time.perf_counter_ns() - began, **resources()})
                if self._stop.wait(self.seconds):
                    return

        self._thread = threading.Thread(target=take, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()


class Runtime:
    """Single queries against a loaded index, with the nanoseconds of each stage; the index's rows are cached."""

    def __init__(self, index, k: int = 10) -> None:
        from evidentia.operators.index import Index

        self.index, self.k = Index(*[t.cache() for t in index]), k
        self.spark = index.postings.sparkSession

    def query(self, text: str) -> tuple[list, dict[str, int]]:
        """The ranking's rows for a text, and stage -> nanoseconds."""
        from evidentia.operators import index as I
        from evidentia.operators import retrieval as R

        stages, began = {}, time.perf_counter_ns()
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        found = I.matches(self.index, asked)
        stages["plan"] = time.perf_counter_ns() - began
        rows = R.top_k(R.bm25_of(found), self.k).orderBy("rank").collect()
        stages["search"] = time.perf_counter_ns() - began - stages["plan"]
        return rows, stages

    def close(self) -> None:
        for t in self.index:
            t.unpersist()


def matrix(spark: SparkSession, variants: dict[str, Callable[[int], object]], concurrencies: list[int], done: dict[str, dict], **bounds) -> dict[str, dict]:
    """Summaries by `variant@concurrency` of closed loops over all variants; those in `done` with the same bounds are taken over, not run again."""
    out = {}
    for name, request in sorted(variants.items()):
        for c in concurrencies:
            key, settings = f"{name}@{c}", {"concurrency": c, **bounds}
            if key in done and done[key].get("settings") == settings:
                out[key] = done[key]
                continue
            with Sampler() as sampler:
                row = summary(closed_loop(spark, request, c, **bounds)).first().asDict()
            out[key] = {**row, "settings": settings, "peak_bytes": max(r["peak_bytes"] for r in sampler.rows)}
    return out


def promoted(results: dict[str, dict], quality: dict[str, float], baseline: str, most_p50: float = 10.0, most_drop: float = 0.005) -> list[str]:
    """Names of results whose median is below `most_p50` milliseconds and whose quality is at most `most_drop` below the baseline's."""
    return sorted(n for n, r in results.items() if r["p50"] < most_p50 and quality[n.rpartition("@")[0]] >= quality[baseline] - most_drop)
