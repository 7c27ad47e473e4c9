"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import hash_sample, held_out, kept, mix, sliced, table, texts

ORDER = 4
#: Documents of each language that the models are fitted on: the bound on the training sample.
DOCS_PER_LANGUAGE = 2000
#: Words in the scorer's memo, a bound on memory.
MEMO_WORDS = 250_000
#: Share of a language's own training documents whose cross-entropy may lie above its rejection threshold.
REJECTED = 0.001
#: One in so many sampled documents sets the temperature and thresholds, in languages with so many documents at least.
CALIBRATION, LEAST_CALIBRATED = 5, 100
UNDETERMINED = "und"

#: ASCII but letters becomes a space; all else stays.
_BETWEEN = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: str) -> list[bytes]:
    """The lower-case words: runs without ASCII other than letters."""
    return text.lower().encode("utf-8", "replace").translate(_BETWEEN).split()


def _codes(word: str) -> np.ndarray:
    """The characters with the word's boundaries, as code points; the boundary is the space."""
    return np.array([32, *map(ord, word), 32], np.uint64)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from n - 1 on."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i])
    return h


class KneserNey:
    """For each order the sorted n-gram hashes with log-probabilities in every language, and the sorted context hashes
    with log back-off weights; what a language hasn't seen is filled in from its lower order."""

    def __init__(self, words: dict[str, Counter]):
        self.key = uuid.uuid4().hex
        self.languages = sorted(words)
        grams = [[Counter() for _ in range(ORDER + 1)] for _ in self.languages]
        for own, lang in zip(grams, self.languages, strict=True):
            for w, c in words[lang].items():
                s = f" {w} "
                for n in range(2, ORDER + 1):  # the last character of each, given those before; the first space is given
                    for i in range(max(0, 2 - n), len(s) - n + 1):
                        own[n][s[i : i + n]] += c
                for i in range(1, len(s)):
                    own[1][s[i]] += c
                for n in range(2, ORDER):  # contexts cut short by the word's start count at full weight
                    own[n][s[:n]] += 0
        self.alphabet = max(2, len(set().union(*(g[1] for g in grams)))) + 1
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        models = [self._model(own) for own in grams]
        for n in range(1, ORDER + 1):
            keys = sorted(set().union(*(p[n] for p, _ in models)))
            probs = np.array([[self._prob(m, k) for m in models] for k in keys]).reshape(len(keys), len(models))
            self.tables.append(self._sorted(keys, n, np.log(probs)))
            if n > 1:
                ctx = sorted(set().union(*(b[n] for _, b in models)))
                lam = np.array([[b[n].get(k, 1.0) for _, b in models] for k in ctx]).reshape(len(ctx), len(models))
                self.backoff.append(self._sorted(ctx, n - 1, np.log(lam)))
        self.temperature, self.limits = 1.0, np.full(len(models), np.inf)

    @staticmethod
    def _sorted(keys: list[str], n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.array([[ord(c) for c in k] for k in keys], np.uint64).reshape(len(keys), n)
        h = np.full(len(keys), n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x100000001B3) + codes[:, i])
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def _discount(counts: Counter) -> float:
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    def _model(self, grams: list[Counter]) -> tuple[list[dict], list[dict]]:
        """Probability of each seen n-gram and back-off weight of each context, by order: raw counts at the top (and
        where the word's start cuts the context short), numbers of distinct left neighbours below."""
        used: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        used[ORDER] = +grams[ORDER]
        for n in range(1, ORDER):
            for g in grams[n + 1]:
                if grams[n + 1][g]:
                    used[n][g[1:]] += 1
            if n > 1:
                for g, c in grams[n].items():
                    if g[0] == " " and c:
                        used[n][g] = c
        probs: list[dict] = [{} for _ in range(ORDER + 1)]
        back: list[dict] = [{} for _ in range(ORDER + 1)]
        total = sum(used[1].values())
        flat = 1.0 / self.alphabet
        d = self._discount(used[1])
        spread = d * len(used[1]) / total if total else 1.0
        for g, c in used[1].items():
            probs[1][g] = (c - d) / total + spread * flat
        self_floor = spread * flat if total else flat
        probs[0][""] = self_floor
        for n in range(2, ORDER + 1):
            d = self._discount(used[n])
            sums, kinds = Counter(), Counter()
            for g, c in used[n].items():
                sums[g[:-1]] += c
                kinds[g[:-1]] += 1
            for ctx, t in sums.items():
                back[n][ctx] = d * kinds[ctx] / t
            for g, c in used[n].items():
                ctx = g[:-1]
                probs[n][g] = (c - d) / sums[ctx] + back[n][ctx] * self._prob((probs, back), g[1:])
        return probs, back

    @staticmethod
    def _prob(model: tuple[list[dict], list[dict]], g: str) -> float:
        probs, back = model
        p = probs[len(g)].get(g)
        if p is not None:
            return p
        if len(g) <= 1:
            return probs[0][""]
        return back[len(g)].get(g[:-1], 1.0) * KneserNey._prob(model, g[1:])

    def words(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word's characters and its end, in each language."""
        out = np.zeros((len(words), len(self.languages)), np.float64)
        sizes = [len(w) + 2 for w in words]
        flat = np.concatenate([_codes(w) for w in words]) if words else np.zeros(0, np.uint64)
        starts = np.cumsum([0, *sizes[:-1]])
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        got = np.zeros((len(flat), len(self.languages)), np.float32)
        open_ = place > 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if not len(at):
                continue
            keys, values = self.tables[n - 1]
            h = _hashes(flat, n)[at - n + 1]
            i = np.searchsorted(keys, h)
            i[i == len(keys)] = 0
            hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            got[at[hit]] += values[i[hit]]
            open_[at[hit]] = False
            if n > 1:
                at = at[~hit]
                keys, values = self.backoff[n - 2]
                h = _hashes(flat, n - 1)[at - n + 1]
                i = np.searchsorted(keys, h)
                i[i == len(keys)] = 0
                hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
                got[at[hit]] += values[i[hit]]
        got[open_] += np.float32(-np.log(self.alphabet) - 5.0)  # a character no language has
        np.add.at(out, owner, got)
        return out


class Scorer:
    """Cross-entropies of texts, with a memo of words."""

    def __init__(self, model: KneserNey):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character in each language (boundaries count), and whether a text has a letter."""
        split = [letters(t) for t in texts]
        new = list(set().union(*split).difference(self.at)) if split else []
        if len(self.at) + len(new) > MEMO_WORDS:
            self._clear()
            new = list(set().union(*split))
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            plain = [w.decode("utf-8", "replace") for w in some]
            scores = self.model.words(plain)
            has = np.array([any(c.isalpha() for c in w) for w in plain], bool)
            first = len(self.at)
            while first + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(some), :-1] = np.where(has[:, None], scores, 0.0)
            self.rows[first : first + len(some), -1] = np.where(has, [len(w) + 1 for w in plain], 0)
            self.at.update(zip(some, range(first, first + len(some)), strict=True))
        sizes = [len(s) for s in split]
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        get = self.at.__getitem__
        for k, s in enumerate(split):
            if sizes[k]:
                out[k] = self.rows[np.fromiter(map(get, s), np.int64, sizes[k])].sum(axis=0)
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n > 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for b in sliced(batches):
        for lang, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(letters(t))
        if sum(map(len, seen.values())) > 500_000:
            yield _counted(seen)
            seen = {}
    yield _counted(seen)


def _counted(seen: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(lang, w.decode("utf-8", "replace"), c) for lang, own in seen.items() for w, c in own.items()]
    rows = [r for r in rows if any(x.isalpha() for x in r[1])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> KneserNey | None:
    """Models of the languages in docs (doc_id, text, lang), from about docs_per_language documents of each by a hash
    of doc_id; rows without text or lang, and held-out ones, are left out. None where nothing is left.

    One in CALIBRATION of the documents of a language that has that many is not learnt from: the temperature of the
    scores and the rejection thresholds are set on these, or on all where no language has any.
    """
    rows = texts(docs).where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    set_by = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATION)) == 0
    enough = F.col("lang").isin(*(v for v, n in counts.items() if n >= LEAST_CALIBRATED))
    sample = hash_sample(rows.select("doc_id", "lang", "text", (set_by & enough).alias("apart")), "lang", "doc_id", docs_per_language, counts)
    some = sample.where("not apart")
    words: dict[str, Counter] = {}
    for r in some.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        words.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    if not words:
        return None
    model = KneserNey(words)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for b in sliced(batches):
            h, has = scorer.texts(b["text"].to_pylist())
            keep = np.flatnonzero(has)
            yield pa.RecordBatch.from_arrays([b["lang"].take(pa.array(keep)), pa.array(list(h[keep]), pa.list_(pa.float64()))], names=["lang", "h"])

    told = sample.where("apart").select("lang", "text").mapInArrow(entropies, "lang string, h array<double>").collect()  # of the bounded sample
    if not told:
        told = some.select("lang", "text").mapInArrow(entropies, "lang string, h array<double>").collect()
    index = {x: i for i, x in enumerate(model.languages)}
    told = [r for r in told if r["lang"] in index]
    if told:
        h, y = np.array([r["h"] for r in told]), np.array([index[r["lang"]] for r in told])
        losses = []
        grid = np.exp2(np.arange(-2, 8, 0.5))
        for t in grid:
            z = -h * t
            z -= z.max(axis=1, keepdims=True)
            losses.append(float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean()))
        model.temperature = float(grid[int(np.argmin(losses))])
        for i in range(len(index)):
            own = h[y == i, i]
            model.limits[i] = float(np.quantile(own, 1 - REJECTED)) if len(own) else np.inf
    return model


def _scorer(model: KneserNey) -> Scorer:
    """The process's own scorer of the model: its memo serves all tasks of a worker."""
    return kept(model.key, lambda: Scorer(model))


def identify(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """doc_id, lang_pred, score (the chosen language's share at the fitted temperature), cross_entropy and rejected
    (above the language's threshold). Null texts and those without a letter are `und`, score 0; so is everything
    without a model. Ties go to the first language by name. Rows that repeat and null doc_ids stay."""
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
        for b in sliced(batches):
            n = b.num_rows
            if known.value is None:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([UNDETERMINED] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)], names=names)
                continue
            s = _scorer(known.value)
            h, has = s.texts([t or "" for t in b["text"].to_pylist()])
            best = h.argmin(axis=1)
            z = -(h - h.min(axis=1, keepdims=True)) * s.model.temperature
            p = 1.0 / np.exp(z).sum(axis=1)
            own = h[np.arange(n), best]
            lang = [s.model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(lang, pa.string()), pa.array(np.where(has, p, 0.0)), pa.array(own, mask=~has), pa.array(~has | (own > s.model.limits[best]))], names=names
            )

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
