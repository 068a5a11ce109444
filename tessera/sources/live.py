"""Payloads of filing services and job boards, from saved documents or over HTTP, as rows that the readers parse.

A fetch is a column of work: each task gets some (source, key) rows and asks for them one after another at a bounded rate,
so a run never exceeds `tasks` times that rate. How bytes are got is a function of a URL and headers, which tests replace.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts, first wait (doubled each time) and timeout in seconds, least time between calls to the regulator.
ATTEMPTS, WAIT, TIMEOUT, APART = 3, 2.0, 15, 0.12
#: Addresses of the services and the most years asked of one.
REGULATOR, TICKERS = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json", "https://www.sec.gov/files/company_tickers.json"
STATEMENTS, FINANCIALS = "https://financialmodelingprep.com/api/v3/{kind}/{ticker}", "https://api.polygon.io/vX/reference/financials"
YEARS = 6
#: Addresses of job boards: list of a board's postings, and one posting.
BOARDS = {
    "greenhouse": ("https://boards-api.greenhouse.io/v1/boards/{token}/jobs", "https://boards-api.greenhouse.io/v1/boards/{token}/jobs/{job}"),
    "lever": ("https://api.lever.co/v0/postings/{token}?mode=json", "https://api.lever.co/v0/postings/{token}/{job}"),
    "ashby": ("https://api.ashbyhq.com/posting-api/job-board/{token}", None),
    "smartrecruiters": ("https://api.smartrecruiters.com/v1/companies/{token}/postings", "https://api.smartrecruiters.com/v1/companies/{token}/postings/{job}"),
}

Get = Callable[[str, dict[str, str]], tuple[int, bytes]]


class Unavailable(RuntimeError):
    """A source that cannot be asked: no key, or no answer after all attempts."""


class Missing(Unavailable):
    """The server answered that there is no such thing."""


def over_http(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def fetch(url: str, headers: dict[str, str], get: Get = over_http, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> object:
    """The JSON at a URL. Busy and failing servers are asked again after growing waits; any other refusal is final."""
    status = 0
    for n in range(ATTEMPTS):
        status, body = get(url, headers)
        if status == 429 or status >= 500:
            sleep(wait * 2**n)
        elif status >= 400:
            raise (Missing if status == 404 else Unavailable)(f"{url.split('?')[0]}: status {status}")
        else:
            return json.loads(body)
    raise Unavailable(f"{url.split('?')[0]}: status {status} after {ATTEMPTS} attempts")


@dataclass
class Source:
    """One service: where its payloads come from. key: the environment variable that it needs, if any."""

    name: str
    key: str | None = None
    get: Get = over_http
    apart: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=0.0, repr=False)
    _ciks: dict[str, str] | None = field(default=None, repr=False)

    def available(self) -> bool:
        return self.key is None or bool(os.environ.get(self.key))

    def ask(self, url: str, **parameters: object) -> object:
        left = self.apart - (time.monotonic() - self._last)
        if left > 0:
            self.sleep(left)
        self._last = time.monotonic()
        full = f"{url}?{urllib.parse.urlencode(parameters)}" if parameters else url
        return fetch(full, {"User-Agent": os.environ.get("SEC_USER_AGENT", "tessera contact@example.com"), "Accept": "application/json"}, self.get, sleep=self.sleep)

    def payload(self, ticker: str) -> object:
        """What the service says of a ticker, in the shape that its reader parses."""
        if not self.available():
            raise Unavailable(f"{self.name}: {self.key} is not set")
        secret = os.environ.get(self.key, "") if self.key else ""
        if self.name == "edgar":
            if self._ciks is None:
                self._ciks = {r["ticker"].upper(): str(r["cik_str"]).zfill(10) for r in self.ask(TICKERS).values()}
            if ticker.upper() not in self._ciks:
                raise Unavailable(f"edgar: no number for {ticker}")
            return self.ask(REGULATOR.format(cik=self._ciks[ticker.upper()]))
        if self.name == "fmp":
            kinds = {"income_statement": "income-statement", "balance_sheet": "balance-sheet-statement", "cash_flow": "cash-flow-statement"}
            rows = {k: self.ask(STATEMENTS.format(kind=v, ticker=ticker.upper()), period="annual", limit=YEARS, apikey=secret) for k, v in kinds.items()}
            return {"symbol": ticker.upper(), **{k: v if isinstance(v, list) else [] for k, v in rows.items()}}
        if self.name == "polygon":
            return self.ask(FINANCIALS, ticker=ticker.upper(), timeframe="annual", limit=YEARS, apiKey=secret)
        raise ValueError(f"no source {self.name}")


def sources(get: Get = over_http) -> list[Source]:
    return [Source("edgar", None, get, APART), Source("fmp", "FMP_API_KEY", get), Source("polygon", "POLYGON_API_KEY", get)]


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, source, payload) of documents <folder>/<source>/<TICKER>.json, in the order of their names."""
    path = F.col("_metadata.file_path")
    raw = spark.read.text(f"{folder}/*/*.json", wholetext=True).select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("source"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("ticker"), F.col("value").alias("payload"))
    return raw.select("ticker", "source", "payload").orderBy("source", "ticker")


def asked(spark: SparkSession, tickers: list[str], of: list[Source], tasks: int = 1) -> tuple[DataFrame, list[str]]:
    """(ticker, source, payload) of all tickers by every source that can be asked, and notices of those that cannot."""
    ready = [x for x in of if x.available()]
    notices = [f"skipping {x.name}: {x.key} is not set" for x in of if not x.available()]
    by = {x.name: x for x in ready}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(payload=[json.dumps(by[s].payload(t)) for t, s in zip(pdf["ticker"], pdf["source"], strict=True)])

    work = spark.createDataFrame([(t, x.name) for x in ready for t in sorted(tickers)], "ticker string, source string").repartition(max(1, tasks), "source")
    return work.mapInPandas(run, "ticker string, source string, payload string"), notices


def payloads(spark: SparkSession, folder: str | None = None, tickers: list[str] | None = None, of: list[Source] | None = None) -> tuple[DataFrame, list[str]]:
    """Saved documents if a folder is given, else live ones; with the notices of skipped sources."""
    if folder is not None:
        found = saved(spark, folder)
        return (found.where(F.col("ticker").isin([t.upper() for t in tickers])) if tickers else found), []
    return asked(spark, tickers or [], sources() if of is None else of)


# --- job boards


def board(platform: str, token: str, get: Get = over_http, **how) -> object | None:
    """All postings of a board, or None if the platform says that there is none; a platform that fails raises Unavailable."""
    try:
        return fetch(BOARDS[platform][0].format(token=urllib.parse.quote(token)), {"Accept": "application/json"}, get, **how)
    except Missing:
        return None


def posting(platform: str, token: str, job: str, get: Get = over_http, **how) -> object | None:
    """One posting; a platform without such an address is asked for its list."""
    one = BOARDS[platform][1]
    if one:
        return fetch(one.format(token=urllib.parse.quote(token), job=urllib.parse.quote(job)), {"Accept": "application/json"}, get, **how)
    return next((j for j in (board(platform, token, get, **how) or {}).get("jobs", []) if j.get("id") == job), None)


def probe(slugs: list[str], get: Get = over_http, **how) -> tuple[str, str, object] | None:
    """(platform, token, payload) of the first likely name under which a platform has a board with postings."""
    for token in slugs:
        for platform in BOARDS:
            found = board(platform, token, get, **how)
            if found and (found if isinstance(found, list) else found.get("jobs") or found.get("content")):
                return platform, token, found
    return None


def probed(companies: DataFrame, get: Get = over_http, tasks: int = 1, **how) -> DataFrame:
    """(company, platform, token, payload) of each row's (company, slugs): the first board with postings; the last three are null
    without one. Companies are spread over tasks, each of which asks for one thing after another; a failing platform fails its
    task, so that no company is sent on to a wrong board. Null companies and slugs are asked for nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for company, slugs in zip(pdf["company"], pdf["slugs"], strict=True):
                hit = probe([x for x in slugs if x], get, **how) if slugs is not None else None
                rows.append((company, *(hit[:2] if hit else (None, None)), json.dumps(hit[2]) if hit else None))
            yield pd.DataFrame(rows, columns=["company", "platform", "token", "payload"])

    return companies.select("company", "slugs").repartition(max(1, tasks)).mapInPandas(run, "company string, platform string, token string, payload string")
