"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

Texts are cut at places where no token can cross (white space), so a document is a list of chunks and
most chunks repeat. The chunks that a task has not met are normalised and split into words, the distinct words
go into a trie, and a depth-first walk gives each trie node its *last token*: the one token that ends the
encoding of the path so far. A token t may end a path if the path without t ends in a token p such that the
pair (p, t) encodes to itself; exactly one t does. So the encoding of a prefix that several words share is
computed once, and a word's ids are read off by walking the last tokens back from its end.

Everything is exact and local to a task: no shuffle, no driver state, memory bounded by `TABLE` entries.

Edge cases: a null text encodes as an empty one (no ids, decoded ""); strings of special tokens inside a text
become their ids, as in the tokenizers library; repeated rows give repeated results; other columns are dropped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from txloom.llm.common import table

#: Chunks that a task remembers; beyond this the table starts anew (speed only, never results).
TABLE = 300_000
#: Remembered steps of the token automaton, and of token pairs.
STEPS = 150_000
#: Chunks longer than this are encoded but not remembered.
LONGEST = 64
#: Rows turned into one output batch.
ROWS = 1024

#: Letters and numbers lie below: the later planes are unassigned, marks or for private use.
PLANES = 0x40000

INF = float("inf")
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
GPT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


@cache
def _kind(classes: str) -> str:
    """The characters of Unicode's general categories that start with one of classes, as ranges for a pattern, by the tables
    of the tokenizers library: Python's are of another version of Unicode."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, PLANES)]))
    found = pre_tokenizers.Split(Regex("[" + "".join(rf"\p{{{c}}}" for c in classes) + "]+"), "removed").pre_tokenize_str(every)
    ends = [0, *[x for _, at in found for x in at], len(every)]
    name = lambda k: f"\\U{ord(every[k]):08x}"
    return "".join(f"{name(i)}-{name(j - 1)}" for i, j in zip(ends[::2], ends[1::2]) if i < j)


@cache
def _unknown() -> re.Pattern:
    """The characters that Python's Unicode tables do not know."""
    new = "".join(chr(k) if unicodedata.category(chr(k)) == "Cn" else " " for k in [*range(0xD800), *range(0xE000, PLANES)])
    return re.compile("[" + "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in re.finditer("[^ ]+", new)) + "]")


class TrieBpe:
    """Encoder for the words of one vocabulary; words are strings of byte characters."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.token = {i: t for t, i in vocab.items()}
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ", 1) for m in merges]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.starts = {t[:n] for t in (x.removesuffix(suffix) if suffix else x for x in vocab) for n in range(len(t) + 1)}
        self.code = {i: i.to_bytes(4, "little") for i in vocab.values()}
        self.steps: dict[str, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.halves = {t: (*p, r) for p, (r, t) in self.rank.items()}  # what a token is merged from, and when
        self.spines: tuple[dict, dict] = ({}, {})
        self.sound: dict[int, bool] = {}

    def _symbols(self, token: int) -> list[int]:
        t = self.token[token]
        if self.suffix and t.endswith(self.suffix):
            t = t.removesuffix(self.suffix)
            return [*(self.vocab[c] for c in t[:-1]), self.vocab[t[-1] + self.suffix]]
        return [self.vocab[c] for c in t]

    def merge(self, ids: list[int]) -> list[int]:
        """The textbook merge loop, lowest rank first, leftmost first; it only tells which tokens encode to themselves."""
        ids = list(ids)
        while len(ids) > 1:
            r, at = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=(0, -1))
            if at < 0:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """From the outermost base symbol of a token to the token: each part with the rank at which it grows into the next."""
        found = self.spines[side].get(token)
        if found is None:
            parts = self.halves.get(token)
            if parts is None:
                found = [(token, INF)]
            else:
                inner = self._spine(parts[side], side)
                found = [*inner[:-1], (inner[-1][0], parts[2]), (token, INF)]
            self.spines[side][token] = found
        return found

    def _alone(self, token: int) -> bool:
        """True if the token's own symbols encode to it."""
        found = self.sound.get(token)
        if found is None:
            found = self.sound[token] = self.merge(self._symbols(token)) == [token]
        return found

    def _fit(self, before: int, token: int) -> bool:
        """True if before, token encodes to itself.

        Merges go by rank, so both tokens grow along their spines at the border; the pair is broken if the two parts
        that meet there at some time can merge before either grows. Of equal ranks the left one goes first.
        """
        xs, ys, i, j = self._spine(before, 1), self._spine(token, 0), 0, 0
        while True:
            (x, grow_x), (y, grow_y) = xs[i], ys[j]
            m = self.rank.get((x, y))
            if (ok := m is None or m[0] >= grow_x or m[0] > grow_y) and not grow_x == grow_y == INF:
                if grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
                continue
            if len(self.fits) > STEPS:
                self.fits.clear()
            self.fits[before << 20 | token] = ok
            return ok

    def _step(self, seen: str) -> tuple[str, tuple, tuple]:
        """For the tail of a path: the longest tail that a token can start with, then the tokens that end here, longest
        first with their lengths, as inner tokens and as tokens at the end of a word."""
        tail = seen
        while tail not in self.starts:
            tail = tail[1:]
        made = tail, *(tuple((t, len(x)) for i in range(len(seen)) if (x := seen[i:]) and (t := self.vocab.get(x + end)) is not None and self._alone(t)) for end in ("", self.suffix))
        if len(self.steps) > STEPS:
            self.steps.clear()
        self.steps[seen] = made
        return made

    def _pick(self, found: tuple, last: list[int], depth: int) -> tuple[int, int]:
        """The one token that fits what the path without it ends in, and its length."""
        fits = self.fits
        for t, n in found:
            before = last[depth - n]
            if before < 0:
                return t, n
            ok = fits.get(before << 20 | t)
            if ok is None:
                ok = self._fit(before, t)
            if ok:
                return t, n
        raise ValueError("a character is outside the vocabulary")

    def encode(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each distinct word (little-endian unsigned 32 bits).

        The trie is the sorted list of words: words that share a prefix are neighbours, so taking them in order is the
        depth-first walk, and only the nodes below the prefix shared with the word before are new. The lists hold, by
        depth along the current path, the state of the token automaton, the last token and the ids of the whole path.
        """
        out: dict[str, bytes] = {}
        order = sorted([w for w in words if len(w) <= LONGEST])
        steps, fits, code, two = self.steps, self.fits, self.code, self.suffix != ""
        tails, last, ids = [""] * (LONGEST + 1), [-1] * (LONGEST + 1), [b""] * (LONGEST + 1)
        shared = 0
        for word, after in zip(order, [*order[1:], ""]):
            tail, end = tails[shared], len(word)
            below = 0  # the prefix shared with the next word
            for x, y in zip(word, after):
                if x != y:
                    break
                below += 1
            for depth in range(shared, end):
                key = tail + word[depth]
                depth += 1
                tail, inner, final = steps.get(key) or self._step(key)
                whole = depth == end
                if not whole or not two or below == end:
                    for t, n in inner:
                        before = last[depth - n]
                        if before < 0:
                            break
                        ok = fits.get(before << 20 | t)
                        if ok or ok is None and self._fit(before, t):
                            break
                    tails[depth] = tail
                    last[depth] = t
                    ids[depth] = ids[depth - n] + code[t]
                if whole and two:
                    for t, n in final:
                        before = last[depth - n]
                        if before < 0:
                            break
                        ok = fits.get(before << 20 | t)
                        if ok or ok is None and self._fit(before, t):
                            break
                    out[word] = ids[depth - n] + code[t]
            if not two:
                out[word] = ids[end]
            shared = below
        for w in words:
            if len(w) > LONGEST:
                out[w] = self._long(w)
        return out

    def _long(self, word: str) -> bytes:
        """A long word by itself: last tokens forwards, then ids backwards, in time proportional to its length."""
        last, size, tail = [-1], [0], ""
        for depth, c in enumerate(word, 1):
            tail, inner, final = self.steps.get(tail + c) or self._step(tail + c)
            t, n = self._pick(final if depth == len(word) else inner, last, depth)
            last.append(t)
            size.append(n)
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        return array("I", ids[::-1]).tobytes()


class Tokenizer:
    """encode and decode as the tokenizers library does for the two kinds of tokenizer file this engine uses:
    byte-level words with a leading space, and lower-cased words with an end-of-word suffix."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bpe = TrieBpe(model["vocab"], model["merges"], self.suffix)
        self.spaces = not self.suffix  # tokens may start with a space
        if self.suffix:
            pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        else:
            pattern = GPT_WORDS
        self.words = re.compile(self._named(pattern))
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.name = self.bpe.token | {i: s for s, i in self.special.items()}
        self.chars = dict(enumerate(byte_chars()))
        self.byte = {c: b for b, c in self.chars.items()}
        self.odd = re.compile("[\x1c-\x1f]")
        self.gaps = re.compile(f"[{WHITE}]+")
        self.runs = re.compile(f"[{WHITE}] [{WHITE}]")
        self.known: dict[str, bytes] = {}  # ids of words in byte characters
        self.ids: dict[str, bytes] = {}  # chunks

    @staticmethod
    def _named(pattern: str) -> str:
        """Name the characters of white space, letters and numbers, as libraries differ on them."""
        for old, new in ((r"[^\s", f"[^{WHITE}"), (r"(?!\S)", f"(?![^{WHITE}])"), (r"\s", f"[{WHITE}]"), (r"[\p{L}]", r"\p{L}"), (r"[\p{N}]", r"\p{N}"), (rf"[^{WHITE}\p{{L}}\p{{N}}]", f"[^{WHITE}{_kind('LN')}]"), (r"\p{L}", f"[{_kind('L')}]"), (r"\p{N}", f"[{_kind('N')}]")):
            pattern = pattern.replace(old, new)
        return pattern

    def chunks(self, text: str) -> list[str]:
        """Parts of a text without special tokens; no token crosses from one to the next."""
        if not self.spaces:
            return [c for c in self.gaps.split(text) if c] if self.odd.search(text) else text.split()
        if not text:
            return []
        if self.runs.search(text):  # white space around a space: only the pattern can tell where words begin
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return [x for x in (first, *[f" {r}" for r in rest]) if x]

    def _plain(self, chunks: list[str]) -> list[str]:
        """Chunks that are not ASCII, composed and lower-cased: all in one string, as nothing composes with a line end."""
        joined = "\n".join(chunks)
        if _unknown().search(joined):
            library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            return [library.normalize_str(c) if _unknown().search(c) else self._plain([c])[0] for c in chunks]
        return unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower().split("\n")  # the library has no final sigma

    def _bytes(self, words: list[str]) -> list[str]:
        """Words in byte characters: all in one string, as no word holds a line end."""
        return "\n".join(words).encode("utf-8", "replace").decode("latin-1").translate(self.chars).split(self.chars[10]) if words else []

    def _spell(self, chunks: set[str]) -> dict[str, list[str]]:
        """The words of each chunk, in byte characters."""
        find = self.words.findall
        if self.spaces:  # a word may hold line ends
            return {c: [w.encode("utf-8", "replace").decode("latin-1").translate(self.chars) for w in find(c)] for c in chunks}
        out, odd = {}, []
        for c in chunks:
            if not c.isascii():
                odd.append(c)
            elif c.isalpha():
                out[c] = [c.lower()]
            else:
                out[c] = find(c.lower())  # printable ASCII stands for itself
                if not c.isprintable():
                    out[c] = self._bytes(out[c])
        split = [find(c) for c in self._plain(odd)] if odd else []
        spelt = iter(self._bytes([w for ws in split for w in ws]))
        for c, ws in zip(odd, split):
            out[c] = [next(spelt) for _ in ws]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the table, by one trie over their distinct words."""
        spelt = self._spell(chunks)
        known, ids = self.known, self.ids
        known |= self.bpe.encode({w for ws in spelt.values() for w in ws if w not in known})
        for c, ws in spelt.items():
            ids[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): byte-level files join bytes, others join token strings by spaces."""
        if not self.spaces:
            return " ".join(map(self.name.__getitem__, ids))
        out = b"".join([s.encode() if (s := self.name[i]) in self.special else bytes(self.byte[c] for c in s) for i in ids])
        return out.decode("utf-8", "replace")

    def parts(self, text: str) -> list[tuple[str, list[str]]]:
        """(special token or "", chunks) in turn."""
        if not any(s in text for s in self.special):
            return [("", self.chunks(text))]
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [("", self.chunks(text[at : m.start()])), (m[0], [])]
            at = m.end()
        return [*out, ("", self.chunks(text[at:]))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32 bits."""
        split = [self.parts(t or "") for t in texts]
        new = set().union(*[cs for ps in split for _, cs in ps]) - self.ids.keys()
        if len(self.ids) + len(new) > TABLE:
            self.known.clear()
            self.ids.clear()
            new = set().union(*[cs for ps in split for _, cs in ps])
        self.learn(new)
        get = self.ids.__getitem__
        out = [b"".join([self.special[s].to_bytes(4, "little") if s else b"".join(map(get, cs)) for s, cs in ps]) for ps in split]
        if any(len(c) > LONGEST for c in new):
            self.ids = {c: i for c, i in self.ids.items() if len(c) <= LONGEST}
            self.known = {w: i for w, i in self.known.items() if len(w) <= LONGEST}
        return out


_LOADED: dict[str, Tokenizer] = {}


def loaded(spec: str) -> Tokenizer:
    """One tokenizer a worker process, kept between tasks."""
    key = f"{len(spec)}:{hash(spec)}"
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(spec)
    return _LOADED[key]


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (BINARY, little-endian unsigned 32-bit) and decoded (what the ids decode to) for each row.

    spec: the JSON text of a tokenizer file (a few MB, sent with the task).
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = tok.encode_batch(part.column(1).to_pylist())
                texts = [tok.decode(np.frombuffer(b, "<u4").tolist()) for b in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind.simpleString()}, ids binary, decoded string")
    return out.select(F.col("key").alias(key), "ids", "decoded")


def decode(df: DataFrame, spec: str, ids: str = "ids") -> DataFrame:
    """df with a column `decoded`: the text of the BINARY ids column; null ids give null. An input column of that name is replaced."""

    @F.pandas_udf("string")
    def text(col):
        tok = loaded(spec)
        return col.map(lambda b: None if b is None else tok.decode(np.frombuffer(b, "<u4").tolist()))

    return df.withColumn("decoded", text(F.col(ids)))


def read_spec(path: str) -> str:
    """The text of a tokenizer file, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of all documents under the word-end vocabulary."""
    import public_tokenizers

    made = encode(table(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")))
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
