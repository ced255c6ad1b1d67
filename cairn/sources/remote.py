"""A paged REST source read in parallel, with retries and without leaking keys.

The transport, a function of parameters to (status, text), is named by module and function, so that
executors can import it and tests can put captured answers in the place of a network.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[dict[str, str]], tuple[int, str]]

# Tries, seconds between them, records of a page by kind of scan.
TRIES, PAUSES, PAGE = 3, (2.0, 4.0), {"genre": 30, "keyword": 20}
# What is scanned where nothing else is asked for.
STANDARD = {
    "areas": ["Z011"],
    "genres": ["G008", "G029", "G016", "G017", "G048"],
    "keywords": ["焼肉専門店", "ホルモン焼き", "牛タン専門店", "ジンギスカン", "ステーキハウス", "鉄板焼き 和牛", "ローストビーフ", "ローストポーク", "焼き鳥 塩", "焼きとん", "鶏料理 専門店", "しゃぶしゃぶ 食べ放題", "すき焼き", "もつ鍋 専門店", "牛すじ 料理", "テールスープ", "韓国焼肉", "サムギョプサル", "シュラスコ", "アメリカンBBQ", "ポークリブ", "ラムチョップ", "羊肉串", "タンドリーチキン", "シークカバブ"],
}


class RequestError(Exception):
    """A request that failed; says nothing of its URL or parameters."""


def request(transport: Transport, parameters: dict[str, str], sleep: Callable[[float], None] = time.sleep) -> dict:
    """``results`` of an answer. Failures of the transport are tried again; its errors are not shown, as they may hold the key."""
    for attempt in range(TRIES):
        try:
            status, text = transport(parameters)
            if status >= 400:
                raise OSError(f"status {status}")
            break
        except Exception as error:
            if attempt + 1 == TRIES:
                raise RequestError(f"no answer after {TRIES} tries: {type(error).__name__}") from None
            sleep(PAUSES[attempt])
    try:
        results = json.loads(text).get("results")
    except (ValueError, AttributeError):
        raise RequestError("the answer is no JSON object") from None
    if not results:
        raise RequestError("the answer has no results")
    if errors := results.get("error"):
        raise RequestError("; ".join(str(e.get("message", "")) for e in errors))
    return results


def pages(transport: Transport, parameters: dict[str, str], count: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """Pages of records, until one is empty or short, or the start is past the number that there are."""
    start = 1
    while True:
        results = request(transport, parameters | {"start": str(start), "count": str(count)}, sleep)
        found = results.get("shop") or []
        if found:
            yield found
        start += len(found)
        available = int(results.get("results_available") or 0)
        if not found or len(found) < count or available and start > available:
            return


class _Scan(InputPartition):
    def __init__(self, rank: int, scan: int, area: str, name: str, value: str, count: int):
        super().__init__(scan)
        self.rank, self.scan, self.area, self.name, self.count = rank, scan, area, name, count
        self.wanted = value


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """S3: areas times values of each kind of scan; blank values are passed over."""
        split = lambda k: [v.strip() for v in self.options.get(k, ",".join(STANDARD[k])).split(",") if v.strip()]
        out: list[InputPartition] = []
        for rank, kind in enumerate(("genre", "keyword")):
            for area in split("areas"):
                for value in split(f"{kind}s"):
                    out.append(_Scan(rank, len(out), area, kind, value, int(self.options.get(f"{kind}_count", PAGE[kind]))))
        return out

    def read(self, scan: _Scan) -> Iterator[tuple]:
        module, _, name = self.options["transport"].rpartition(".")
        transport = getattr(importlib.import_module(module), name)
        parameters = {"large_area": scan.area, scan.name: scan.wanted, "order": "4"}
        seq = 0
        for found in pages(transport, parameters, scan.count, time.sleep if self.options.get("wait", "true") == "true" else lambda s: None):
            for shop in found:
                yield scan.rank, (scan.scan, seq), str(shop.get("id") or ""), json.dumps(shop, ensure_ascii=False)
                seq += 1


class ApiSource(DataSource):
    """Records (rank, seq, id, shop as JSON) of genre scans (rank 0) and keyword scans (rank 1), a partition each.

    Options: transport; areas, genres, keywords (comma-separated; ``STANDARD`` if not given); genre_count, keyword_count, wait. ``seq`` is
    the scan's number and the record's place in it. ``cairn.sources.files.fetched_shops`` makes one row an id of them.
    """

    @classmethod
    def name(cls) -> str:
        return "poi_api"

    def schema(self) -> str:
        return "rank int, seq struct<scan:int,at:long>, id string, shop string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ApiSource)


def throttled(transport: Transport, limit: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> Transport:
    """At most ``limit`` requests, ``delay`` seconds after each; further ones get status 429."""
    sent = 0

    def call(parameters: dict[str, str]) -> tuple[int, str]:
        nonlocal sent
        if sent >= limit:
            return 429, ""
        sent += 1
        answer = transport(parameters)
        if delay > 0:
            sleep(delay)
        return answer

    return call


def geocoder_answers(text: str) -> list[tuple[float, float, str]]:
    """(lat, lng, title) of a geocoder's answer; entries without two coordinates drop out."""
    out = []
    for item in json.loads(text):
        at = (item.get("geometry") or {}).get("coordinates") or []
        if len(at) >= 2:
            out.append((float(at[1]), float(at[0]), str((item.get("properties") or {}).get("title") or "")))
    return out
