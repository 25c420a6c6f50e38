"""Language identification by interpolated Kneser-Ney character models, one per language.

Models are learned from a bounded sample: the `per_lang` rows of each language with the smallest hash of their id
(three quarters for counts, the rest for calibration), whole texts. Each language is one group of at most that many
texts. A model keeps, for each order, sorted arrays of n-gram hashes with the interpolated log probability, and of
context hashes with the log weight of the lower order; a lookup is a binary search.

A text is the sequence of its lower-cased words (runs of letters), each between spaces; no context crosses a space,
so a word's log probabilities depend on the word alone and each distinct word of a task is looked up once. The
language is the one with the lowest cross-entropy a character. A text is rejected if it has no letter, or if its
cross-entropy lies above the calibrated bound of the language chosen: half-way from the language's own texts to evenly
drawn letters, and wider for shorter texts. So mixed languages, codes and lists stay; noise goes.

Edge cases: null, empty and letterless texts give `und`, score 0, rejected; with no labelled rows every text does;
repeated rows are scored one by one; of equal entropies the smaller language name wins; other columns are dropped.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.llm.common import held_out, small_batches, stage, table, trim, unstage

ORDER = 4
#: Bound of the training sample, rows a language.
PER_LANG = 800
#: Words that a task remembers; beyond this the table starts anew.
TABLE = 300_000
LONGEST = 64
ROWS = 1024
#: Standard deviations (of a text of its length) above the bound of its language at which a text is rejected.
REJECT = 4.0

def _letters() -> str:
    """The letters of Unicode as ranges for a pattern."""
    every = "".join(chr(k) if unicodedata.category(chr(k))[0] == "L" else " " for k in range(0x40000))
    return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in re.finditer("[^ ]+", every))


_WORDS: list = []


def words_of(text: str) -> list[str]:
    if not _WORDS:
        _WORDS.append(re.compile(f"[{_letters()}]+"))
    return _WORDS[0].findall(text.lower())


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of " word " for all words in a row; for each its place in its word; where each word begins."""
    text = "".join([f" {w} " for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position (of fewer at the very start)."""
    h = np.full(len(codes), np.uint64(n))
    for back in range(n - 1, -1, -1):
        x = np.zeros(len(codes), np.uint64)
        x[back:] = codes[: len(codes) - back] if back else codes
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def learn(words: list[str], counts: np.ndarray, order: int = ORDER) -> dict[str, np.ndarray]:
    """Sorted hash arrays of an interpolated Kneser-Ney model. counts: occurrences of each distinct word."""
    codes, place, _ = laid_out(words)
    weight = np.repeat(counts, [len(w) + 2 for w in words]).astype(np.float64)
    out: dict[str, np.ndarray] = {"order": np.array([order])}
    lower: dict[int, np.ndarray] = {}
    hashes = {n: grams(codes, n) for n in range(1, order + 1)}
    letters = len(np.unique(codes)) + 1  # and one for all that were never seen
    for n in range(1, order + 1):
        # a shorter n-gram that starts its word is used in full there; elsewhere it counts the characters before it
        here = place >= n - 1 if n > 1 else place >= 1
        own, at, inverse = np.unique(hashes[n][here], return_index=True, return_inverse=True)
        where = np.flatnonzero(here)
        if n == order:
            c = np.bincount(inverse, weight[here])
        else:
            longer = place[where] >= n
            _, pick = np.unique(hashes[n + 1][where[longer]], return_index=True)
            c = np.bincount(inverse[longer][pick], minlength=len(own)).astype(np.float64)
            first = ~longer  # begins a word: its counts are real ones
            c += np.bincount(inverse[first], weight[where[first]], minlength=len(own))
        ones, twos = (c == 1).sum(), (c == 2).sum()
        off = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
        context = hashes[n - 1][where[at] - 1] if n > 1 else np.zeros(len(own), np.uint64)
        ctx, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, c)
        rest = np.bincount(back, np.minimum(c, off)) / total
        below = lower[n - 1][where[at]] if n > 1 else np.full(len(own), 1.0 / letters)
        p = np.maximum(c - off, 0) / total[back] + rest[back] * below
        full = np.empty(len(codes))
        full[where] = p[inverse]
        if n > 1:
            full[~here] = lower[n - 1][~here]
        else:
            full[~here] = 1.0 / letters
        lower[n] = full
        suffix = hashes[n - 1][where[at]] if n > 1 else np.zeros(len(own), np.uint64)
        out |= {f"gram{n}": own, f"p{n}": np.log(p), f"of{n}": context, f"end{n}": suffix, f"ctx{n}": ctx, f"w{n}": np.log(np.maximum(rest, 1e-9))}
    out["floor"] = np.array([-np.log(letters)])
    return out


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


class Merged:
    """Several models over the union of their n-grams: one binary search serves all of them.

    values[n] holds, for each n-gram that any model knows, its full log probability under every model, backed off
    where a model lacks it; weights[n] holds each known context's log weight of the lower order.
    """

    def __init__(self, models: list[dict[str, np.ndarray]]):
        self.order, self.floor = int(models[0]["order"][0]), np.array([float(m["floor"][0]) for m in models])
        self.grams: dict[int, np.ndarray] = {}
        self.values: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        for n in range(1, self.order + 1):
            own, at = np.unique(np.concatenate([m[f"gram{n}"] for m in models]), return_index=True)
            of, end = (np.concatenate([m[f"{k}{n}"] for m in models])[at] for k in ("of", "end"))
            ctx = np.unique(np.concatenate([m[f"ctx{n}"] for m in models]))
            self.contexts[n], self.weights[n] = ctx, np.zeros((len(ctx), len(models)))
            self.grams[n], self.values[n] = own, np.empty((len(own), len(models)))
            for k, m in enumerate(models):
                there, w = look_up(m[f"ctx{n}"], m[f"w{n}"], ctx)
                self.weights[n][:, k] = np.where(there, w, 0.0)
                known, p = look_up(m[f"gram{n}"], m[f"p{n}"], own)
                there, w = look_up(m[f"ctx{n}"], m[f"w{n}"], of)
                lower = self.values[n - 1][np.searchsorted(self.grams[n - 1], end), k] if n > 1 else self.floor[k]
                self.values[n][:, k] = np.where(known, p, np.where(there, w, 0.0) + lower)

    def score(self, words: list[str]) -> np.ndarray:
        """Sum of log probabilities of each word's characters and its closing space, a column for each model."""
        if not words:
            return np.zeros((0, len(self.floor)))
        codes, place, starts = laid_out(words)
        out = np.zeros((len(codes), len(self.floor)))
        left = np.flatnonzero(place > 0)
        context = grams(codes, self.order)
        for n in range(self.order, 0, -1):
            h, context = context, grams(codes, n - 1) if n > 1 else np.zeros(len(codes), np.uint64)
            here = place[left] >= n - 1
            now, later = left[here], left[~here]
            at = np.minimum(np.searchsorted(self.grams[n], h[now]), len(self.grams[n]) - 1)
            known = self.grams[n][at] == h[now]
            out[now[known]] += self.values[n][at[known]]
            now = now[~known]
            if len(now):
                at = np.minimum(np.searchsorted(self.contexts[n], context[now - 1]), len(self.contexts[n]) - 1)
                there = self.contexts[n][at] == context[now - 1]
                out[now[there]] += self.weights[n][at[there]]
            left = np.concatenate([later, now])
        out[left] += self.floor
        return np.add.reduceat(out, starts, axis=0)


def word_scores(model: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    return Merged([model]).score(words)[:, 0]


def noise_entropy(model: dict[str, np.ndarray], words: list[str]) -> float:
    """Cross-entropy a character of words of these lengths from letters drawn evenly from those of the words."""
    letters = sorted(set("".join(words)))
    if not letters:
        return float("inf")
    drawn = np.random.default_rng(7).integers(0, len(letters), sum(map(len, words)))
    text, at, made = "".join([letters[i] for i in drawn]), 0, []
    for w in words:
        made.append(text[at : at + len(w)])
        at += len(w)
    return float(-word_scores(model, made).sum() / sum(len(w) + 1 for w in made))


def pack(model: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **model)
    return buf.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as d:
        return {k: d[k] for k in d.files}


def train(docs: DataFrame, allowed=None, per_lang: int = PER_LANG, order: int = ORDER) -> dict[str, dict[str, np.ndarray]]:
    """Models by language, with `bound`: of calibration texts the median cross-entropy, the mid-way to that of noise
    (the bound of rejection), and a character's variance.

    docs: doc_id, text, lang. Rows with null text, null lang or a false `allowed` take no part. The driver gets the
    models only: their size is bounded by per_lang texts a language.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).collect()  # a row for each language
    if not counts:
        return {}
    # about four times the sample by hash, so that ranking meets a bounded number of rows; then exactly the smallest
    spread = 1 << 40
    cuts = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(spread, 4 * per_lang * spread // max(1, r["ids"])))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    by = Window.partitionBy("lang").orderBy(place, "doc_id")
    near = rows.where(place < F.element_at(cuts, F.col("lang"))).select("doc_id", "lang").distinct()
    # staged, so that its true size decides how it is joined
    few = stage(near.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_lang))
    # one text (the least) for each id and language, however often it stands
    sample = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(few, ["doc_id", "lang"]).groupBy("doc_id", "lang", "n").agg(F.min("text").alias("text"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "text"]).sort_values(["n", "text"])
        texts = [words_of(t) for t in group["text"]]
        fitted = [t for i, t in enumerate(texts) if i % 4 or len(texts) < 8]
        checked = [t for i, t in enumerate(texts) if i % 4 == 0 or len(texts) < 8]
        counts = Counter(w for t in fitted for w in t)
        if not counts:
            return pd.DataFrame({"lang": [], "model": []})
        names = sorted(counts)
        model = learn(names, np.array([counts[w] for w in names]), order)
        means, sizes = [], []
        for t in checked:
            if t:
                size = sum(len(w) + 1 for w in t)
                means.append(-word_scores(model, t).sum() / size)
                sizes.append(size)
        means, sizes = np.array(means), np.array(sizes)
        mean = float(np.median(means)) if len(means) else float("inf")
        each = float(np.median((means - mean) ** 2 * sizes)) * 2.2 if len(means) else 0.0  # a character's variance, robustly
        noise = noise_entropy(model, [w for t in checked for w in t])
        model["bound"] = np.array([mean, (mean + max(noise, mean)) / 2, max(each, 1.0)])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "model": [pack(model)]})

    made = sample.groupBy("lang").applyInPandas(fit, "lang string, model binary").collect()
    unstage(few)
    return {r["lang"]: unpack(r["model"]) for r in sorted(made)}


class Scorer:
    """Scores of texts under all models, remembering the words of the texts before."""

    def __init__(self, models: dict[str, dict[str, np.ndarray]]):
        self.names = list(models)
        self.merged = Merged(list(models.values())) if models else None
        self.bound = np.array([m["bound"] for m in models.values()]).reshape(-1, 3)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(self.names) + 1))

    def learn(self, chunks: set[str]) -> None:
        """Rows of the table for chunks (parts of a text between white space): log probabilities, characters."""
        spelt = {c: [c.lower()] if c.isascii() and c.isalpha() else words_of(c) for c in chunks}
        words = list({w for ws in spelt.values() for w in ws})
        at = {w: i for i, w in enumerate(words)}
        each = np.zeros((len(words) + 1, len(self.names) + 1))
        each[:-1, :-1] = self.merged.score(words)
        each[:-1, -1] = [len(w) + 1 for w in words]
        rows = np.zeros((len(spelt), each.shape[1]))
        single = np.array([at[ws[0]] if len(ws) == 1 else -1 for ws in spelt.values()], np.int64)
        rows[:] = each[single]
        for i, ws in enumerate(spelt.values()):
            if len(ws) > 1:
                rows[i] = each[[at[w] for w in ws]].sum(axis=0)
        first = len(self.table)
        self.table = np.concatenate([self.table, rows])
        self.row |= {c: first + i for i, c in enumerate(spelt)}

    def sums(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").split() for t in texts]
        new = set().union(*split) - self.row.keys()
        if len(self.row) + len(new) > TABLE:
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(new)
        get = self.row.__getitem__
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, cs in enumerate(split):
            if cs:
                out[i] = self.table[np.fromiter(map(get, cs), np.int64, len(cs))].sum(axis=0)
        if any(len(c) > LONGEST for c in new):
            self.row = {c: r for c, r in self.row.items() if len(c) <= LONGEST}
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy) of each text."""
        if not self.names:
            return [("und", 0.0, True, None)] * len(texts)
        sums = self.sums(texts)
        out = []
        for row in sums:
            size = row[-1]
            if not size:
                out.append(("und", 0.0, True, None))
                continue
            best = int(np.argmax(row[:-1]))
            entropy = -row[best] / size
            _, bound, each = self.bound[best]
            gap = np.minimum(row[best] - row[:-1], 700.0)
            score = 1.0 / np.exp(-gap / np.sqrt(1 + size / 20)).sum()  # characters of one text depend on each other
            out.append((self.names[best], float(score), bool(entropy > bound + REJECT * np.sqrt(each / size)), float(entropy)))
        return out


def identify(docs: DataFrame, models: dict[str, dict[str, np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1), rejected, cross_entropy (nats a character) for each row."""
    kind = docs.schema[key].dataType.simpleString()
    blobs = {k: pack(m) for k, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer({k: unpack(b) for k, b in blobs.items()})  # a task's own: a worker keeps nothing for later stages
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = scorer.judge(part.column(1).to_pylist())
                cols = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["key", "lang_pred", "score", "rejected", "cross_entropy"])
        scorer.forget()
        trim()

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")
    return out.withColumnRenamed("key", key)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language was found, with all their columns."""
    small_batches(spark)
    models = train(docs, ~held_out())
    names = docs.columns
    found = keep_by(docs, models)
    return found.select(*names)


def keep_by(docs: DataFrame, models: dict) -> DataFrame:
    """docs without the rows that are rejected; a narrow pass over whole rows."""
    blobs = {k: pack(m) for k, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer({k: unpack(b) for k, b in blobs.items()})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = scorer.judge(part.column(part.schema.get_field_index("text")).to_pylist())
                yield part.filter(pa.array([not m[2] for m in made]))
        scorer.forget()
        trim()

    return docs.mapInArrow(run, docs.schema)
