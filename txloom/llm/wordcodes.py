"""Fast exact ids of lower-cased words with an end-of-word suffix.

Texts are cut at ASCII white space, which no token crosses, and each distinct chunk that a worker has not met is normalised and
split into words by the rules of `bpe.Tokenizer`. All new words of a batch are then one text of lines for tiktoken: the line
end stands for the end-of-word suffix, and its merges with each byte have the first ranks, so a word begins as the symbols
that the tokenizer file begins it with; the file's own merges follow in their order. tiktoken merges any two neighbours whose
bytes are a token, the tokenizer file only the pair that it names: both give the same if every token, spelt out, encodes to
itself. `PieceEncoder` is refused a file for which that does not hold (`check`, run once by the driver).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import normalizers

from txloom.llm import bpe

#: Chunks and words that a worker remembers; beyond this it keeps what it just met (speed only, never results).
TABLE, WORDS = 500_000, 150_000
#: Chunks longer than this are encoded but not remembered.
LONGEST = 64


def check(spec: str) -> None:
    """ValueError, unless the file has an end-of-word suffix and each of its tokens encodes to itself."""
    tok = bpe.loaded(spec)
    if not tok.suffix:
        raise ValueError("the tokenizer has no end-of-word suffix")
    if odd := [t for t, i in tok.bpe.vocab.items() if not tok.bpe._alone(i)]:
        raise ValueError(f"{len(odd)} tokens do not encode to themselves, such as {odd[0]!r}")


class PieceEncoder:
    """ids of texts as little-endian unsigned 16-bit (or, for larger vocabularies, 32-bit) bytes."""

    def __init__(self, spec: str):
        import tiktoken

        self.tok = tok = bpe.loaded(spec)
        vocab, suffix = tok.bpe.vocab, tok.suffix
        self.kind = "<u2" if max([*vocab.values(), *tok.special.values()]) < 1 << 16 else "<u4"
        single = {bytes([b]): vocab[c] for b, c in tok.chars.items()}
        ended = {bytes([b]) + b"\n": vocab[c + suffix] for b, c in tok.chars.items()}
        merged = [i for _, i in sorted(tok.bpe.rank.values())]
        spell = lambda t: bytes(tok.byte[c] for c in t.removesuffix(suffix)) + b"\n" * t.endswith(suffix)
        ranks = ended | single | {spell(tok.bpe.token[i]): i for i in merged}
        self.coder = tiktoken.Encoding("lines", pat_str=r"[^\n]+\n", mergeable_ranks={t: k for k, t in enumerate(ranks)}, special_tokens={})
        self.codes = np.array(list(ranks.values()), self.kind)
        self.ends = np.array([len(t) > 1 and t.endswith(b"\n") for t in ranks])
        self.special = {s: np.array([i], self.kind).tobytes() for s, i in tok.special.items()}
        self.pattern = re.compile(tok.words.pattern + "|\n")
        # character classes within the first plane are bitmaps, and many times faster
        self.first_plane = re.compile(re.sub(r"\\U000[1-9a-f]\w{4}-\\U000[1-9a-f]\w{4}", "", self.pattern.pattern))
        self.odd: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _plain(self, lines: str) -> str:
        """Lines of chunks as the tokenizer normalises them."""
        if lines.isascii():
            return lines.lower()
        for c in set(lines) - self.odd.keys():
            self.odd[c] = bool(bpe._unknown().match(c))
        if any(map(self.odd.__getitem__, set(lines))):
            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(lines)
        return unicodedata.normalize("NFC", lines).replace("Σ", "σ").lower()

    def _learn(self, new: list[str]) -> None:
        """Put chunks into the tables; the chunks hold no ASCII white space."""
        lines = self._plain("\n".join([*new, ""]))
        pieces = (self.first_plane if max(lines) < "\U00010000" else self.pattern).findall(lines)
        fresh = list(set(pieces) - self.words.keys() - {"\n"})
        if fresh:
            found = self.coder.encode_to_numpy("\n".join([*[w.encode("utf-8", "replace").decode() for w in fresh], ""]))
            held, size = self.codes[found].tobytes(), self.codes.itemsize
            to = ((np.flatnonzero(self.ends[found]) + 1) * size).tolist()
            self.words.update(zip(fresh, [held[a:b] for a, b in zip([0, *to], to)]))
        words, at, row = self.words, 0, []
        for p in pieces:
            if p == "\n":
                self.chunks[new[at]] = row[0] if len(row) == 1 else b"".join(row)
                at, row = at + 1, []
            else:
                row.append(words[p])

    def _known(self, own: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        chunks = self.chunks
        new = [c for c in own if c not in chunks]
        if len(chunks) + len(new) > TABLE:
            chunks = self.chunks = {c: chunks[c] for c in own if c in chunks}
        if len(self.words) > WORDS:
            self.words.clear()
        if new:
            self._learn(new)
        out = [chunks[c] for c in own]
        if long := [c for c in new if len(c) > LONGEST]:
            for c in long:
                del chunks[c]
            self.words = {w: i for w, i in self.words.items() if len(w) <= LONGEST}
        return out

    def _marked(self, text: str) -> bytes:
        """The ids of a text that holds strings of special tokens."""
        parts = [(s, [c for c in re.split("[\t-\r ]+", x) if c]) for s, x in self._cut(text)]
        own = list({c for _, cs in parts for c in cs})
        ids = dict(zip(own, self._known(own)))
        return b"".join([s + b"".join([ids[c] for c in cs]) for s, cs in parts])

    def _cut(self, text: str) -> list[tuple[bytes, str]]:
        """(ids of the special token before it, plain text) in turn."""
        out, at, before = [], 0, b""
        for m in self.tok.marks.finditer(text):
            out.append((before, text[at : m.start()]))
            at, before = m.end(), self.special[m[0]]
        return [*out, (before, text[at:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin; one place more); null texts have none, strings of special tokens
        become their ids."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", texts) if marked.any() else texts
        split = pc.ascii_split_whitespace(plain)
        held = split.flatten().dictionary_encode()
        rows = np.asarray(split.offsets, np.int64)
        at = held.indices.to_numpy()
        codes = self._known(held.dictionary.to_pylist())
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // self.codes.itemsize
        ids, begins = np.frombuffer(b"".join(codes), self.kind), np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        values = ids[np.repeat(begins[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[rows - rows[0]]
        if marked.any():
            which = np.flatnonzero(marked)
            made = [np.frombuffer(self._marked(texts[int(i)].as_py()), self.kind) for i in which]
            values = np.insert(values, np.repeat(bounds[which], list(map(len, made))), np.concatenate(made))
            more = np.zeros(len(bounds), np.int64)
            more[which + 1] = list(map(len, made))
            bounds = bounds + np.cumsum(more)
        return values, bounds


_LOADED: dict[str, PieceEncoder] = {}


def loaded(spec: str) -> PieceEncoder:
    """One encoder a worker process, kept between tasks."""
    key = f"{len(spec)}:{hash(spec)}"
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(spec)
    return _LOADED[key]
