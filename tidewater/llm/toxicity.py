"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into categories: insults (words and word beginnings learnt from labelled documents,
each with its log-odds as weight), threats, targets, negations and reported speech. Three small transducers then
rewrite a clause's categories - negation and reported speech weaken what follows them, a target strengthens what is
near it - and their composition is one machine that reads a clause once. What it puts out, weighted, is summed by kind
over the document's clauses, and a logistic model fitted on the same labelled documents turns those sums into a score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop_path, grams, hash_sample, held_out, kept, sliced, table, texts, utf8, word_hash, written

#: Labelled documents of each class that lexicon and model are fitted on: the bound on the training sample.
DOCS_PER_CLASS = 4000
#: Lengths of word beginnings that the lexicon may learn.
STEMS = (4, 5, 6, 7)
#: Least log-odds of a learnt entry, and least number of documents of the toxic sample that have it.
LEAST_ODDS, LEAST_DOCS = 4.0, 4
#: Runs that the reader's memo holds, and the length of one; a longer one is looked at each time.
MEMO_WORDS, MEMO_BYTES = 250_000, 64

# Categories of words.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words of the closed categories, in the languages of the corpora.
WORDS = {
    THREAT: "kill hurt destroy burn shoot stab punish töte töten verbrennen matar quemar tuer brûler",
    TARGET: "you your youre they them their he she him her these those people du dich dir ihr euch sie tu vous toi eux tú usted ustedes ellos",
    NEGATION: "not never no isnt arent wasnt dont doesnt didnt cannot nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says say wrote quoted quote reported claimed claims alleged called sagte schrieb dit écrit dijo escribió",
}
_CLOSED = {w: c for c, ws in WORDS.items() for w in ws.split()}

# What the composed machine puts out for a word.
NOTHING, PLAIN, DENIED, TOLD, AIMED, MENACE = range(6)
KINDS = ("plain", "denied", "told", "aimed", "menace")


class Transducer:
    """A deterministic finite-state transducer: step[state, symbol in] = (state, symbol out)."""

    def __init__(self, start, step: dict):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this puts out goes into the other."""
        start = (self.start, other.start)
        step, todo = {}, [start]
        inputs = {x for _, x in self.step}
        while todo:
            a, b = s = todo.pop()
            for x in inputs:
                if (s, x) in step:
                    continue
                a2, y = self.step[a, x]
                b2, z = other.step[b, y]
                step[s, x] = (a2, b2), z
                todo.append((a2, b2))
        return Transducer(start, step)

    def numbered(self) -> tuple[list[list[int]], list[list[int]]]:
        """Next state and output by state and symbol, states as numbers from 0, the start."""
        states = {self.start: 0}
        for s, _ in self.step:
            states.setdefault(s, len(states))
        inputs = sorted({x for _, x in self.step})
        go, out = [[0] * len(inputs) for _ in states], [[0] * len(inputs) for _ in states]
        for (s, x), (t, y) in self.step.items():
            go[states[s]][x], out[states[s]][x] = states[t], y
        return go, out


def grammar(scope: int = 3, reach: int = 4) -> Transducer:
    """Negation reaches `scope` words on, reported speech to the clause's end, a target `reach` words on.

    Symbols between the machines are (category, denied, told).
    """
    words = range(6)
    negation = {}
    for left, c in product(range(scope + 1), words):
        negation[left, c] = (scope if c == NEGATION else max(0, left - 1), (c, left > 0))
    report = {}
    for on, c, denied in product((False, True), words, (False, True)):
        report[on, (c, denied)] = (on or c == REPORT, (c, denied, on))
    target = {}
    for left, c, denied, told in product(range(reach + 1), words, (False, True), (False, True)):
        after = reach if c == TARGET else max(0, left - 1)
        if c == INSULT:
            out = DENIED if denied else TOLD if told else AIMED if left else PLAIN
        elif c == THREAT:
            out = MENACE if left and not denied and not told else NOTHING
        else:
            out = NOTHING
        target[left, (c, denied, told)] = (after, out)
    return Transducer(0, negation).then(Transducer(False, report)).then(Transducer(0, target))


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")


class Grammar:
    """The lexicon and the machine."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.key = uuid.uuid4().hex
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.go, self.out = grammar().numbered()
        self.model: tuple[list[float], float] | None = None

    def look(self, word: str) -> tuple[int, float]:
        """Category and weight of a lower-case word."""
        found = self.words.get(word)
        if found is None:
            for n in self.lengths:
                if len(word) >= n and (found := self.stems.get(word[:n])) is not None:
                    break
        if found is not None:
            return INSULT, found
        return _CLOSED.get(word.replace("'", "").replace("’", ""), OTHER), 1.0

    def sums(self, text: str) -> list[float]:
        """What the clauses' matches weigh, by kind."""
        got = [0.0] * (len(KINDS) + 1)
        state = 0
        for m in _TOKEN.finditer(text.lower()):
            w = m[0]
            if not w[0].isalpha():
                state = 0
                continue
            c, weight = self.look(w)
            out = self.out[state][c]
            state = self.go[state][c]
            if out:
                got[out] += weight
        return got[1:]

    def score(self, sums: list[float]) -> float:
        if self.model is None:
            return 0.0
        z = self.model[1] + sum(w * math.log1p(x) for w, x in zip(self.model[0], sums, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


#: ASCII letters, apostrophes and all that isn't ASCII stay.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


class Reader:
    """Scores texts: words are looked up in a memo, and only texts with an insult or a threat go through the machine."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.none = grammar.score([0.0] * len(KINDS))
        self.clean: set[bytes] = set()

    def texts(self, texts: list[str]) -> list[tuple[list[float], float]]:
        out = []
        look = self.grammar.look
        for t in texts:
            words = set(t.lower().encode("utf-8", "replace").translate(_LETTERS).split())
            words -= self.clean
            hit = False
            for w in words:
                # a run that is no word by itself is split as the machine does
                v = w.decode("utf-8", "replace")
                if any(look(x)[0] in (INSULT, THREAT) for x in ([v] if v.isalpha() else _TOKEN.findall(v))):
                    hit = True
                elif len(w) <= MEMO_BYTES:
                    self.clean.add(w)
            if len(self.clean) > MEMO_WORDS:
                self.clean = set()
            if hit:
                s = self.grammar.sums(t)
                out.append((s, self.grammar.score(s)))
            else:
                out.append(([0.0] * len(KINDS), self.none))
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and how many other documents have each word, and each word beginning (with a hyphen)."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def told() -> pa.RecordBatch:
        keys = list(seen[1].keys() | seen[0].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], names=["feature", "toxic", "other"])

    for b in sliced(batches):
        for y, t in zip(b["toxic"].to_pylist(), b["text"].to_pylist(), strict=True):
            words = {w for w in _TOKEN.findall(t.lower()) if w[0].isalpha()}
            seen[y].update(words)
            seen[y].update({f"{w[:n]}-" for w in words for n in STEMS if len(w) > n})
        if len(seen[0]) + len(seen[1]) > 1_000_000:
            yield told()
            seen = (Counter(), Counter())
    yield told()


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict]:
    """toxic and text of a bounded sample of the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = hash_sample(known, "toxic", "doc_id", most, counts).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # about 2 * most rows, whatever the number of labels
    found = rows.join(F.broadcast(some), "doc_id").select("toxic", "text").mapInArrow(_keyed, "toxic int, text string, copy long")
    return found.dropDuplicates(["toxic", "copy"]).select("toxic", "text"), counts


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key that copies mostly share, the least hash of a word 3-gram: words of a much-copied text are no evidence."""
    memo = word_hash()
    for b in sliced(batches):
        keys = []
        for t in utf8(b):
            w = memo.of(t.lower().split())
            g = grams(w, min(3, len(w))) if len(w) else np.zeros(1, np.uint64)
            keys.append(int(g.min() >> np.uint64(1)))
        yield pa.RecordBatch.from_arrays([b["toxic"], b["text"], pa.array(keys, pa.int64())], names=["toxic", "text", "copy"])


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> Grammar:
    """Lexicon and model from labelled documents whose crc32(doc_id) mod 5 is not 0, docs_per_class of each class at most.

    Rows with a null label, id or text are left out. Without labels of both classes nothing is learnt and all scores are 0.
    """
    some, counts = _labelled(docs, labels, docs_per_class)
    if not (counts.get(0) and counts.get(1)):
        return Grammar({}, {})
    some, path = written(some, "labelled")
    n = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Grammar({}, {})
    sums = some.mapInArrow(_features, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("other") + 0.5) / (n[0] + 1.0))
    # of the bounded sample's words: a bounded list
    found = {r["feature"]: r["w"] for r in sums.withColumn("w", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("w") >= LEAST_ODDS)).select("feature", "w").collect()}
    stems: dict[str, float] = {}
    for s in sorted((f[:-1] for f in found if f.endswith("-")), key=len):
        if not any(s[:k] in stems for k in STEMS):
            stems[s] = float(found[s + "-"])
    words = {f: float(w) for f, w in found.items() if not f.endswith("-") and not any(f[:k] in stems for k in STEMS if len(f) > k)}
    got = Grammar(words, stems)
    known = docs.sparkSession.sparkContext.broadcast(got)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = [known.value.sums(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    told = some.mapInArrow(sums_of, "toxic int, x array<double>").collect()  # of the bounded sample
    got.model = _logistic(np.log1p(np.array([r["x"] for r in told], np.float64).reshape(len(told), len(KINDS))), np.array([r["toxic"] for r in told], np.float64), counts)
    drop_path(docs.sparkSession, path)
    return got


def _logistic(x: np.ndarray, y: np.ndarray, counts: dict, ridge: float = 1e-3, steps: int = 50) -> tuple[list[float], float] | None:
    """Ridge logistic regression by Newton's method, with the classes at the weight that all labels give them."""
    if not (y == 0).any() or not (y == 1).any():
        return None
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) / (counts[0] + counts[1])
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    b = np.zeros(a.shape[1])
    pull = ridge * np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + pull * b
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull)
        d = np.linalg.solve(h, g)
        b -= d
        if np.abs(d).max() < 1e-9:
            break
    return [float(v) for v in b[:-1]], float(b[-1])


def _reader(g: Grammar) -> Reader:
    """The process's own reader of the grammar."""
    return kept(g.key, lambda: Reader(g))


def score_rows(rows: DataFrame, model: Grammar, into: str = "tox_score") -> DataFrame:
    """All columns of rows (with text, string) and the score, under a name that rows don't have; null and empty texts
    score as texts without any match."""
    if into in rows.columns:
        raise ValueError(f"{into} is a column already")
    known = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = _reader(known.value).texts([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, into])

    return texts(rows).mapInArrow(score, f"{schema}, `{into}` double")


def score_documents(docs: DataFrame, model: Grammar) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), and what the matches weigh by kind (a map).

    Null and empty texts score as texts without any match. Repeated rows keep a row each, null doc_ids stay; other
    columns are not read.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = _reader(known.value).texts([t or "" for t in b["text"].to_pylist()])
            s = np.array([x for _, x in got], np.float64)
            kinds = pa.array([[(k, v) for k, v in zip(KINDS, x, strict=True) if v] for x, _ in got], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), kinds], names=["doc_id", "score", "predicted", "matches"])

    return rows.mapInArrow(score, "doc_id long, score double, predicted int, matches map<string, double>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a grammar learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
