"""Fetching over a server that breaks off, resets, lies and floods: nothing that is cut off is taken or stored."""

import socket
import threading

import pytest

from txloom.sources import blobs, hub

ANSWERS = {
    "whole": [b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nConnection: close\r\n\r\nabc"],
    "short": [b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\nConnection: close\r\n\r\n" + bytes(64)],
    "heals": [b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\nConnection: close\r\n\r\nabc", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nConnection: close\r\n\r\nabc"],
    "reset": [b""],
    "chunks": [b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nConnection: close\r\n\r\n20\r\n" + bytes(32) + b"\r\n20\r\n" + bytes(5)],
    "garbage": [b"no protocol at all\r\n\r\n"],
    "length": [b"HTTP/1.1 200 OK\r\nContent-Length: many\r\nConnection: close\r\n\r\nabc"],
    "large": [b"HTTP/1.1 200 OK\r\nContent-Length: 5000\r\nConnection: close\r\n\r\n" + bytes(5000)],
    "endless": [b"HTTP/1.1 200 OK\r\nConnection: close\r\n\r\n" + bytes(5000)],
    "gone": [b"HTTP/1.1 404 Not Found\r\nContent-Length: 0\r\nConnection: close\r\n\r\n"],
    "down": [b"HTTP/1.1 503 Busy\r\nContent-Length: 0\r\nConnection: close\r\n\r\n"],
}


@pytest.fixture
def base():
    """A server that sends the bytes above, one entry a call, the last for ever; counts calls."""
    listener, calls = socket.create_server(("127.0.0.1", 0)), {}

    def serve():
        while True:
            try:
                s, _ = listener.accept()
            except OSError:
                return
            with s:
                name = s.recv(65536).split(b" ")[1].rsplit(b"/", 1)[1].decode()
                calls[name] = calls.get(name, 0) + 1
                s.sendall(ANSWERS[name][min(calls[name], len(ANSWERS[name])) - 1])

    threading.Thread(target=serve, daemon=True).start()
    yield f"http://127.0.0.1:{listener.getsockname()[1]}", calls
    listener.close()


def get(url, name, **more):
    return hub.fetch(f"{url}/subtree/{name}", attempts=2, first_wait=0.01, allow_private=True, **more)


@pytest.mark.parametrize("name", ["short", "reset", "chunks", "garbage", "length", "down"])
def test_broken_answers_fail_after_all_attempts(base, name):
    with pytest.raises(hub.Failed, match="2 attempts"):
        get(base[0], name)
    assert base[1][name] == 2


@pytest.mark.parametrize("name", ["large", "endless"])
def test_no_body_over_the_limit(base, name):
    with pytest.raises(hub.Failed, match="larger than 100 bytes"):
        get(base[0], name, limit=100)
    assert len(get(base[0], name)) == 5000


def test_a_later_attempt_may_be_whole(base):
    assert get(base[0], "heals") == b"abc" and base[1]["heals"] == 2
    with pytest.raises(hub.NotFound):
        get(base[0], "gone")
    assert base[1]["gone"] == 1


def test_errors_are_rows_and_nothing_broken_is_stored(spark, base, tmp_path):
    want = spark.createDataFrame([(base[0], n) for n in ANSWERS] + [("http://127.0.0.1:1", "refuses")], "base string, subtree_hash string")
    options = {"first_wait": 0.01, "attempts": 2, "allow_private": True, "limit": 1000}
    got = {r["subtree_hash"]: (r["data"], r["error"]) for r in hub.fetched(want, **options).collect()}
    assert {k for k, (d, _) in got.items() if d is not None} == {"whole", "heals"} and got["gone"] == (None, "not found")
    assert all(e.startswith("failed: ") for k, (_, e) in got.items() if k not in ("whole", "heals", "gone"))
    have = blobs.with_remote(spark, want, str(tmp_path / "s"), 0, **options)
    assert {r["subtree_hash"] for r in have.collect()} == {r["key"] for r in blobs.latest(spark, str(tmp_path / "s")).collect()} == {"whole", "heals"}
