"""Fetching daily archives into a store, on the driver; where they come from is the caller's matter.

``python -m panelkit.sources.fetch --url TEMPLATE`` fetches a range of days. The template has the fields
``{market}``, ``{data_type}``, ``{symbol}`` and ``{day}``; next to each archive a ``.CHECKSUM`` file is looked for.
"""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import io
import logging
import time
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from panelkit.sources.store import DATA_TYPES, FUTURES, MARKETS, build_hive_path, csv_to_parquet, date_range, get_market_string

log = logging.getLogger(__name__)
#: Bytes that go to the file system at a time.
PART_BYTES = 4 << 20


def validate(data_type: str, market_type: str, futures_type: str) -> str:
    if data_type not in DATA_TYPES:
        raise ValueError(f"unknown data type: {data_type}")
    return get_market_string(market_type, futures_type)


def day_list(start: dt.datetime, end: dt.datetime) -> list[dt.date]:
    """Days from ``start`` up to but not with ``end``."""
    return [(start + dt.timedelta(days=k)).date() for k in range((end.date() - start.date()).days)]


def verify_checksum(data: bytes, text: str) -> bool:
    """Whether the first word of a checksum file is the SHA-256 of the data."""
    words = text.split()
    return bool(words) and hashlib.sha256(data).hexdigest() == words[0].lower()


def extract_csv(data: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return archive.read(archive.namelist()[0])


def http_get(url: str) -> bytes:
    with urllib.request.urlopen(url) as answer:
        return answer.read()


class Fetcher:
    """Downloads, verifies and converts days; days that fail after all attempts are logged and returned.

    ``work_dir`` is a folder that the executors see, as they read the files there; default is one in the store.
    """

    def __init__(self, spark, base: str | Path, url_template: str, work_dir: str | Path | None = None, get: Callable[[str], bytes] = http_get, max_concurrent: int = 5, retry_attempts: int = 3, retry_delay: float = 1.0):
        self.spark, self.base, self.template, self.work = spark, base, url_template, str(work_dir or f"{base}/.fetch")
        self.get, self.max_concurrent, self.attempts, self.delay = get, max_concurrent, retry_attempts, retry_delay

    def _one(self, symbol: str, data_type: str, market: str, day: dt.date) -> bool:
        url = self.template.format(market=market, data_type=data_type, symbol=symbol, day=day.isoformat())
        for attempt in range(self.attempts):
            try:
                data = self.get(url)
                if not verify_checksum(data, self.get(f"{url}.CHECKSUM").decode()):
                    raise ValueError("checksum mismatch")
                csv = f"{self.work}/{symbol}-{data_type}-{day}.csv"
                with self._file(csv) as put:
                    put(extract_csv(data))
                    csv_to_parquet(self.spark, csv, build_hive_path(self.base, market, data_type, symbol, day.year, day.month, day.day), data_type=data_type)
                return True
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                log.warning("%s, attempt %d: %s", url, attempt + 1, e)
                if attempt + 1 < self.attempts:
                    time.sleep(self.delay)
        log.error("%s: given up", url)
        return False

    @contextmanager
    def _file(self, path: str) -> Iterator[Callable[[bytes], None]]:
        """Writes a file to the file system of its path, and deletes it afterwards."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

        def put(data: bytes) -> None:
            out = system.create(place, True)
            for k in range(0, len(data), PART_BYTES):
                out.write(bytearray(data[k : k + PART_BYTES]))
            out.close()

        try:
            yield put
        finally:
            system.delete(place, False)

    def __call__(self, symbol: str, data_type: str, market: str, days: list[dt.date]) -> list[dt.date]:
        with ThreadPoolExecutor(self.max_concurrent) as pool:
            done = list(pool.map(lambda d: self._one(symbol, data_type, market, d), days))
        return [d for d, ok in zip(days, done, strict=True) if not ok]


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Fetch daily archives into a tick store.")
    p.add_argument("-s", "--symbol", required=True)
    p.add_argument("-t", "--data-type", default="trades", choices=DATA_TYPES)
    p.add_argument("-m", "--market-type", default="spot", choices=MARKETS)
    p.add_argument("-f", "--futures-type", default="cm", choices=FUTURES)
    p.add_argument("-d", "--days", type=int)
    p.add_argument("-p", "--path", default="./Data")
    p.add_argument("-r", "--date-range", help="START:END, the end exclusive")
    p.add_argument("--url", required=True)
    p.add_argument("--max-concurrent", type=int, default=5)
    p.add_argument("--retry-attempts", type=int, default=3)
    p.add_argument("--retry-delay", type=float, default=1.0)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parse_args(argv)
    market = validate(args.data_type, args.market_type, args.futures_type)
    start, end = date_range(*(args.date_range.split(":") if args.date_range else (None, None)), days=args.days)
    fetcher = Fetcher(SparkSession.builder.getOrCreate(), args.path, args.url, max_concurrent=args.max_concurrent, retry_attempts=args.retry_attempts, retry_delay=args.retry_delay)
    return int(bool(fetcher(args.symbol, args.data_type, market, day_list(start, end))))


if __name__ == "__main__":
    raise SystemExit(main())
