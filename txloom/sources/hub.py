"""HTTP: fetching subtrees and blocks from a hub, and a sink that posts callbacks.

Urls that the guard refuses are never called, and each connection checks the address that it dials, so a name that
resolves to an inner address (now, or since it was registered) is refused too.
"""

from __future__ import annotations

import functools
import http.client
import ipaddress
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txloom.functions.scalars import url_error

ATTEMPTS, LIMIT, BLOCK_LIMIT = 4, 1 << 30, 16 << 20
LOCAL = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "169.254.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "::1/128", "fe80::/10", "fc00::/7")]


class Refused(OSError):
    """The address may not be dialled."""


def check_dial(address: str, allow_private: bool = False) -> None:
    """Refused, unless address is an IP that may be dialled; what is no IP is refused as well."""
    try:
        ip = ipaddress.ip_address(address.partition("%")[0])
    except ValueError:
        raise Refused(f"{address} is no address") from None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.is_unspecified or ip.is_multicast or not allow_private and any(ip.version == n.version and ip in n for n in LOCAL):
        raise Refused(f"{address} may not be dialled")


def _dial(address: tuple[str, int], timeout: float = 30.0, source_address=None, *, allow_private: bool = False) -> socket.socket:
    problem: Exception = Refused(f"{address[0]} has no address")
    for family, kind, proto, _, at in socket.getaddrinfo(*address, 0, socket.SOCK_STREAM):
        check_dial(at[0], allow_private)
        s = socket.socket(family, kind, proto)
        try:
            s.settimeout(timeout)
            s.connect(at)
            return s
        except OSError as e:
            s.close()
            problem = e
    raise problem


def _guarded(base: type) -> Callable:
    class Connection(base):
        def __init__(self, *a, allow_private: bool, **kw):
            super().__init__(*a, **kw)
            self._create_connection = functools.partial(_dial, allow_private=allow_private)

    return Connection


def opener(allow_private: bool = False, redirects: bool = True) -> urllib.request.OpenerDirector:
    """Opens http and https urls through checked connections; no proxies."""

    class Http(urllib.request.HTTPHandler):
        def http_open(self, req):
            return self.do_open(functools.partial(_guarded(http.client.HTTPConnection), allow_private=allow_private), req)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, req):
            return self.do_open(functools.partial(_guarded(http.client.HTTPSConnection), allow_private=allow_private), req)

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a):
            return None

    return urllib.request.build_opener(urllib.request.ProxyHandler({}), Http, Https, *([] if redirects else [Stay]))


class NotFound(Exception):
    """The hub has no such object; trying again does not help."""


class Failed(OSError):
    """No attempt gave the whole body."""


def whole_body(r: http.client.HTTPResponse, limit: int) -> bytes:
    """The body of an answer; Failed if it is longer than limit or shorter than it says."""
    told = r.headers.get("Content-Length")
    if told is not None and not told.strip().isdigit():
        raise Failed(f"the length {told!r} is no number")
    if told is not None and int(told) > limit:
        raise Failed(f"it is larger than {limit} bytes")
    data = r.read(limit + 1)
    if len(data) > limit:
        raise Failed(f"it is larger than {limit} bytes")
    if told is not None and len(data) != int(told):
        raise Failed(f"it ends after {len(data)} of {told} bytes")
    return data


def fetch(url: str, limit: int = LIMIT, attempts: int = ATTEMPTS, first_wait: float = 0.5, longest_wait: float = 10.0, allow_private: bool = False, timeout: float = 30.0) -> bytes:
    """The whole body of url. NotFound for a 404 and Refused for an address that may not be dialled are final; all else
    (other answers, resets, broken protocol, bodies cut off or over the limit) is tried again with doubling waits, and then
    Failed. A body of unknown length ends where the connection does."""
    problem: Exception | None = None
    for attempt in range(attempts):
        if attempt:
            time.sleep(min(longest_wait, first_wait * 2 ** (attempt - 1)))
        try:
            with opener(allow_private).open(url, timeout=timeout) as r:
                return whole_body(r, limit)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NotFound(url) from e
            problem = e
        except Refused:
            raise
        except (OSError, http.client.HTTPException, ValueError) as e:  # an URLError and a timeout are an OSError
            if isinstance(reason := getattr(e, "reason", None), Refused):
                raise reason from e
            problem = e
    raise Failed(f"{url}: {type(problem).__name__}: {problem} ({attempts} attempts)") from problem


def attempted(url: str, **options) -> tuple[bytes | None, str | None]:
    """(data, None), or (None, what went wrong)."""
    try:
        return fetch(url, **options), None
    except NotFound:
        return None, "not found"
    except Refused as e:
        return None, f"refused: {e}"
    except (OSError, http.client.HTTPException, ValueError) as e:
        return None, f"failed: {e}"


def fetched(wanted: DataFrame, base: str = "base", key: str = "subtree_hash", kind: str = "subtree", allow_private: bool = False, **options) -> DataFrame:
    """key, data, error for each wanted object at base/kind/key: fetched by the executors, a row at a time, as rows are
    the requests. What cannot be had is a row with null data and its error (`not found`, `refused: …`, `failed: …`), so one
    bad peer never ends the stage; a base that the guard refuses is not called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, k, error in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = None
                if error is None:
                    data, error = attempted(f"{url.rstrip('/')}/{kind}/{k}", allow_private=allow_private, **options)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["key", "data", "error"])

    out = wanted.select(base, F.col(key).cast("string"), url_error(base, allow_private).alias("refused")).mapInArrow(run, "key string, data binary, error string")
    return out.withColumnRenamed("key", key)


def fetched_blocks(wanted: DataFrame, base: str = "base", key: str = "block_hash", allow_private: bool = False, **options) -> DataFrame:
    """key, height, header fields, subtrees, transaction_count, error of wanted blocks at base/block/key, none over 16 MiB."""
    from txloom.sources import readers

    got = fetched(wanted, base, key, "block", allow_private, limit=BLOCK_LIMIT, **options)
    return readers.parsed_blocks(got, key)


def posted(messages: DataFrame, timeout: float = 10.0, allow_private: bool = False) -> DataFrame:
    """messages (callback_url, token, idempotency_key, payload, …) with ok and permanent: one POST a row. Addresses that
    the url guard refuses fail for good and are never called. What is already permanent (a missing proof) is not sent."""
    before = F.coalesce(F.col("permanent"), F.lit(False)) if "permanent" in messages.columns else F.lit(False)
    guarded = messages.withColumn("permanent", before | url_error("callback_url", allow_private).isNotNull())
    names = [f.name for f in guarded.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for row in batch.select(["callback_url", "token", "idempotency_key", "payload", "permanent"]).to_pylist():
                ok.append(not row["permanent"] and post(row["callback_url"], row["payload"], row["idempotency_key"], row["token"], timeout, allow_private))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], [*names, "ok"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in guarded.schema)
    return guarded.mapInArrow(run, f"{schema}, ok boolean")


def post(url: str, body: str, key: str | None, token: str | None, timeout: float = 10.0, allow_private: bool = False) -> bool:
    """True for a 2xx answer; redirects are not followed, and refused addresses not dialled."""
    headers = {"Content-Type": "application/json"} | ({"X-Idempotency-Key": key} if key else {}) | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        with opener(allow_private, redirects=False).open(urllib.request.Request(url, body.encode(), headers, method="POST"), timeout=timeout) as r:
            return 200 <= r.status < 300
    except (urllib.error.URLError, http.client.HTTPException, OSError, ValueError):
        return False
