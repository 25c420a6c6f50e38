"""Token files: the ids of the tokenizers library, the format byte by byte, wanted documents only, damage, lost tasks."""

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import zstandard
from tokenizers import Tokenizer

from txloom.llm import tokenfile, wordcodes
from txloom.llm.bpe import read_spec

SPEC = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(SPEC).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def coded(coder, texts):
    ids, at = coder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_ids_are_the_library_s(monkeypatch):
    wordcodes.check(read_spec(SPEC))
    coder = wordcodes.PieceEncoder(read_spec(SPEC))
    odd = ["", None, "  ", "a<|endoftext|>b  c", "<|startoftext|>", "<|ENDOFTEXT|> x", "\x1cA\x1fb \x85 x　y", "ΑΣ Σ À É ́x", "İstanbul 'S don't I'LL ½²", "日本 한국 \U0001F600\U0001F3FD", "a" * 700, "\v\f x\r\ny ", "\x00 \x7f"]
    rng = random.Random(5)
    signs = "aabcdeE 'st.,!?<|>\n\té́ßΣσİ½١あ\U0001F600\U00010400\x1c\xa0 ﬁ"
    fuzz = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)]
    every = [chr(k) for k in range(1, 0x40000, 5) if not 0xD800 <= k < 0xE000]
    fuzz += ["x" + "".join(every[i : i + 40]) + " " + every[i] for i in range(0, len(every), 40)]
    assert coded(coder, odd + fuzz) == library(odd + fuzz)
    monkeypatch.setattr(wordcodes, "TABLE", 3)  # tables that start anew give the same
    monkeypatch.setattr(wordcodes, "WORDS", 2)
    assert [coded(coder, [t])[0] for t in odd] == library(odd)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, file string")


def test_round_trip_and_order(spark, tmp_path):
    rows = [(k, f"word {k} été " * (k % 7), "x", "y") for k in range(500)] + [(7, "again", "", ""), (7, "again", "", ""), (None, "no id", "", ""), (900, None, "", ""), (901, "", "", "")]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs(spark, rows).repartition(5), read_spec(SPEC), path)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((k is not None, k or 0, [*i, 2]) for (k, *_), i in zip(rows, library([t for _, t, *_ in rows])))
    assert [r["doc_id"] for r in got] == sorted((k for k, *_ in rows), key=lambda k: -1 if k is None else k)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and len({r["file"] for r in got}) > 1
    want = spark.createDataFrame([(3,), (3,), (7,), (901,), (5555,), (None,)], "doc_id long")
    found = {(r["doc_id"], r["start"], tuple(r["ids"])) for r in tokenfile.lookup(spark, path, want).collect()}
    assert found == {(r["doc_id"], r["start"], tuple(r["ids"])) for r in got if r["doc_id"] in (3, 7, 901)}


def test_empty_table_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs(spark, [(1, "one", "", "")]), read_spec(SPEC), path)
    tokenfile.write_tokens(docs(spark, []), read_spec(SPEC), path)
    assert tokenfile.read(spark, path).collect() == []
    assert not glob.glob(f"{path}/*.tok")
    tokenfile.write_tokens(docs(spark, [(2, "two", "", "")]), read_spec(SPEC), path)
    ids = tokenfile.read(spark, path)
    part = ids.select("doc_id", "ids").withColumnRenamed("ids", "ids")
    raw = spark.createDataFrame([(9, np.array([5, 6], "<u2").tobytes())], "doc_id long, ids binary")
    raw.write.format("token_frames").option("width", 2).mode("append").save(path)
    assert [(r["doc_id"], r["start"], list(r["ids"])) for r in tokenfile.read(spark, path).orderBy("start").collect()][1] == (9, part.head()["ids"].__len__(), [5, 6])
    with pytest.raises(Exception, match="no committed token files"):
        tokenfile.read(spark, str(tmp_path / "none")).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.createDataFrame([(1, b"abc"), (2, b"abcd")], "doc_id long, ids binary")
    spark.dataSource.register(tokenfile.TokenFrames)
    with pytest.raises(Exception, match="whole number"):
        bad.coalesce(1).write.format("token_frames").option("width", 2).mode("append").save(path)
    assert not glob.glob(f"{path}/*.tok") and not glob.glob(f"{path}/_manifest/*")


def one_file(tmp_path, sizes, width=2):
    path = str(tmp_path / "f.tok")
    ids = np.arange(sum(sizes)).astype(f"<u{width}")
    w = tokenfile.FrameWriter(pafs.LocalFileSystem().open_output_stream(path), width)
    half = len(sizes) // 2
    cut = sum(sizes[:half])
    w.add(pa.array(range(half), pa.int64()), np.array(sizes[:half]), memoryview(ids[:cut].tobytes()))
    w.add(pa.array(range(half, len(sizes)), pa.int64()), np.array(sizes[half:]), memoryview(ids[cut:].tobytes()))
    w.close()
    return path, ids


def opened(path):
    return tokenfile.FrameReader(pafs.LocalFileSystem().open_input_file(path))


def test_frames_seek_table_and_checksums(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_IDS", 100)
    sizes = [1, 0, 250, 99, 100, 1, 37]
    path, ids = one_file(tmp_path, sizes)
    data = open(path, "rb").read()
    # plain zstandard reads the ids, frame after frame, and skips index and seek table
    plain, at = b"", 0
    frames = struct.unpack("<I", data[-9:-5])[0]
    table = np.frombuffer(data[-9 - 12 * frames : -9], "<u4").reshape(frames, 3)
    for made, size, check in table[:-1].tolist():
        got = zstandard.ZstdDecompressor().decompress(data[at : at + made])
        assert len(got) == size and tokenfile.digest(got) == check
        plain, at = plain + got, at + made
    assert plain == ids.tobytes() and [t[1] for t in table.tolist()] == [200] * 4 + [176, 0]
    r = opened(path)
    for k, n in enumerate(sizes):
        begin = sum(sizes[:k])
        before = r.frames_read
        assert r.span(begin, begin + n) == ids[begin : begin + n].tobytes()
        assert r.frames_read - before == (0 if not n else (begin + n - 1) // 100 - begin // 100 + 1)
    # a broken frame is found, and breaks no other; a cut-off file is found
    broken = bytearray(data)
    broken[int(table[0, 0]) + 12] ^= 255
    open(path, "wb").write(broken)
    assert opened(path).span(0, 50) == ids[:50].tobytes()
    with pytest.raises(tokenfile.Damaged):
        opened(path).span(90, 120)
    for cut in (0, 5, 40, len(data) // 2, len(data) - 1):
        open(path, "wb").write(data[:cut])
        with pytest.raises(tokenfile.Damaged):
            opened(path)


def test_files_are_cut_and_long_documents_span_frames(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(k, f"small {k}", "", "") for k in range(40)] + [(20, long, "", "")]
    tokenfile.write_tokens(docs(spark, rows).coalesce(1), read_spec(SPEC), path)
    got = {(r["doc_id"], r["n_tokens"]): r for r in tokenfile.read(spark, path, "bytes").collect()}
    ids = np.array([*library([long])[0], 2], "<u4")
    assert len(ids) > tokenfile.FRAME_IDS and got[20, len(ids)]["ids"] == ids.tobytes()


def test_query(spark):
    from txloom.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in registry.QUERIES["op11_token_frames"](spark, sf).collect()}
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for (k, _), found in zip(rows, library([t for _, t in rows])):
        ids = np.array([*found, 2], "<u4")
        assert tuple(got[k])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
