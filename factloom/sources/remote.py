"""Remote archive as a Spark data source: throttled, retried, cached by anti-join.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("user_agent", "Jane jane@example.com").option("urls", "...").load()

URLs are read in as many partitions as `partitions` says; the request budget is divided among
them, so the total rate holds however many executors take part.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom import scope

SCHEMA = T.StructType().add("url", T.StringType()).add("content", T.BinaryType())


class AccessDenied(RuntimeError):
    """The archive refused the request; retrying will not help."""


class TokenBucket:
    """Blocking and non-blocking budget for one process."""

    def __init__(self, rate: float = scope.REMOTE_RATE, capacity: float = scope.REMOTE_BURST,
                 clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if rate <= 0 or capacity <= 0:
            raise ValueError("rate and capacity must be positive")
        self.rate, self.capacity, self.clock, self.sleep = rate, capacity, clock, sleep
        self.tokens, self.at, self.lock = capacity, clock(), threading.Lock()

    def _shortfall(self, wanted: float) -> float:
        """Seconds until `wanted` tokens are there; takes them when that is now."""
        with self.lock:  # refill and take are one step for concurrent callers
            now = self.clock()
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
            self.at = now
            missing = wanted - self.tokens
            if missing <= 0:
                self.tokens -= wanted
            return max(missing, 0.0) / self.rate

    def try_acquire(self, wanted: float = 1.0) -> bool:
        return self._shortfall(wanted) == 0.0

    def acquire(self, wanted: float = 1.0) -> float:
        if wanted > self.capacity:
            raise ValueError("more tokens than the bucket can hold")
        waited = 0.0
        while (wait := self._shortfall(wanted)) > 0:
            self.sleep(wait)
            waited += wait
        return waited


def check_user_agent(value: str | None) -> str:
    agent = (value or "").strip()
    if not agent:
        raise ValueError("user_agent is required: 'Name email@domain'")
    if "@" not in agent:
        raise ValueError(f"user_agent {agent!r} has no contact address")
    return agent


def open_url(url: str, agent: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read()


def fetch(url: str, agent: str, bucket: TokenBucket, timeout: float = 30.0, opener=open_url, sleep=time.sleep) -> bytes:
    """One URL, at most three attempts with growing pauses; a refusal ends at once."""
    problem: Exception | None = None
    for attempt in range(scope.MAX_ATTEMPTS):
        bucket.acquire()
        try:
            return opener(url, agent, timeout)
        except urllib.error.HTTPError as error:
            if error.code == 403:
                raise AccessDenied(f"{url} refused for user agent {agent!r}") from error
            if error.code not in scope.RETRY_STATUSES:
                raise
            problem = error
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            problem = error
        sleep(2**attempt)
    raise RuntimeError(f"{url} failed after {scope.MAX_ATTEMPTS} attempts") from problem


class _Urls(InputPartition):
    def __init__(self, urls: list[str], share: float) -> None:
        super().__init__(0)
        self.urls, self.share = urls, share


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.agent = check_user_agent(options.get("user_agent"))
        self.urls = json.loads(options.get("urls", "[]"))
        self.timeout = float(options.get("timeout", 30))
        self.rate = float(options.get("rate", scope.REMOTE_RATE))
        self.slots = max(1, min(int(options.get("partitions", 1)), len(self.urls) or 1))

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i :: self.slots], self.rate / self.slots) for i in range(self.slots)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        bucket = TokenBucket(partition.share, max(1.0, partition.share))
        for url in partition.urls:
            yield url, fetch(url, self.agent, bucket, self.timeout)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArchiveReader(self.options)


def fetch_table(urls: DataFrame, agent: str, slots: int = 4, rate: float = scope.REMOTE_RATE, timeout: float = 30.0) -> DataFrame:
    """(url, content) for a table of URLs too long for an option. Each of `slots` tasks streams
    through its URLs with its share of the rate."""
    agent = check_user_agent(agent)

    def read(batches):
        import pandas as pd

        bucket = TokenBucket(rate / slots, max(1.0, rate / slots))
        for batch in batches:
            yield pd.DataFrame({"url": batch["url"], "content": [fetch(u, agent, bucket, timeout) for u in batch["url"]]})

    return urls.select("url").repartition(slots).mapInPandas(read, SCHEMA)


def download_missing(manifest: DataFrame, stored: DataFrame, agent: str, **options) -> DataFrame:
    """Fetch what the store (url, content) does not hold; amendments are recorded, not fetched.

    Append the result to the store: file output is committed atomically, so an interrupted run
    never leaves half a file behind that later counts as cached."""
    wanted = manifest.filter(~F.col("is_amendment")).select("url").distinct()
    return fetch_table(wanted.join(stored.select("url"), "url", "left_anti"), agent, **options)


def record_downloads(filings: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest rows: filings plus path, hash and size of what is held."""
    held = stored.select(
        "url", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes")
    )
    joined = filings.join(held, "url", "left")
    got = F.col("sha256").isNotNull() & ~F.col("is_amendment")
    return (
        joined.withColumn("downloaded", got)
        .withColumn("local_path", F.when(got, F.col("local_path")).otherwise(F.lit("")))
        .withColumn("sha256", F.when(got, F.col("sha256")).otherwise(F.lit("")))
        .withColumn("size_bytes", F.when(got, F.col("size_bytes")).otherwise(F.lit(0)))
    )
