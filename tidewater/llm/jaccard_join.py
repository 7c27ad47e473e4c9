"""Exact Jaccard similarity join on word 5-grams with adaptive multi-match prefixes.

A document's shingles are put in one order over the whole corpus, rare ones first by a sketch of all counts. Two sets
with Jaccard t or more share at least l shingles of their prefixes of length n - ceil(t n) + l. Each document picks l
by the estimated cost of its candidates, so that documents with frequent prefix shingles get longer prefixes and must
share more before they count as candidates. What a pair's prefixes share also bounds what its sets can share, which sorts
out nearly all pairs that share by chance: these grow with the square of the corpus and would chain it into one cluster.
Short posting lists give pairs; long ones give a star, which is linear in the list, and the sets below are compared
exactly. Every candidate cluster is then verified on whole sets, in blocks of bounded size, and each block gives a
spanning forest of its links rather than its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WordHash, bit_flag, bit_prefilter, bits_for, drop_path, grams, hot_split_join, mix, once_of_kept, release, row_key, runs, sliced, table, texts, utf8, word_hash, written
from tidewater.llm.components import connected_components

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 3, 4
#: Counters of the sketch; counts of all shingles go in, and the size does not grow.
SKETCH_BITS = 20
CHUNK = 4096
#: Posting lists up to this many documents give all their pairs, longer ones a star.
LIST_MOST = 128
#: Shingles and documents that a block of a cluster holds.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 20, 1024
#: Shingles of the prefixes that a pair has to share, and what is asked for (where a set has as many) when none is frequent.
MULTI, LEAST_MULTI = (1, 2, 4, 8), 4


def shingles(text: bytes, memo: WordHash, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of fewer words, one of the whole sequence."""
    words = memo.of(text.lower().split())
    if len(words) >= k:
        return np.unique(grams(words, k))
    return mix(grams(words, len(words)) + np.uint64(len(words))) if len(words) else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sig(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its set's size and signature), and at the end the counts of all shingles in chunks."""
    memo, counts = word_hash(), np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["doc_id", "key", "n", "sig", "chunk", "counts"]
    for b in sliced(batches):
        sets = [shingles(t, memo) for t in utf8(b)]
        counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        n = len(sets)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_sig(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    rows = [(i, c.tobytes()) for i, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
    if rows:
        nulls = [pa.nulls(len(rows), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the chunks that it gets: a row for each chunk, however many come."""
    total = np.zeros(1 << SKETCH_BITS, np.uint64).reshape(-1, CHUNK)
    for b in batches:
        for i, c in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
            total[i] += np.frombuffer(c, np.uint32 if len(c) == 4 * CHUNK else np.uint64)
    found = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([total[i].tobytes() for i in found], pa.binary())], names=["chunk", "counts"])


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Count estimates for all values of the hash's first bits, as 8 steps an octave in one byte each."""
    chunks = profiles.where("chunk is not null").select("chunk", "counts")
    parts = chunks.rdd.getNumPartitions()
    while True:
        parts = -(-parts // 32)
        chunks = chunks.repartition(parts).mapInArrow(_summed, "chunk int, counts binary") if parts > 1 else chunks.coalesce(1).mapInArrow(_summed, "chunk int, counts binary")
        if parts == 1:
            break
    total = np.zeros(1 << SKETCH_BITS, np.uint64).reshape(-1, CHUNK)
    for r in chunks.collect():  # of a fixed size
        total[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    return np.minimum(255, np.rint(8 * np.log2(total.reshape(-1) + 1.0))).astype(np.uint8)


def _prefixes(levels) -> callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, level, seen = word_hash(), levels.value, set()
        count = np.exp2(np.arange(256) / 8.0)
        floor = count[level].mean()
        excess = np.maximum(0.0, count - 1.5 * floor)  # what a token has above the sketch's mean load
        for b in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for t in utf8(b):
                s = shingles(t, memo)
                n, sig = len(s), _sig(s)
                if not n or sig in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(sig)
                q = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                need = -(-NUM * n // DEN)
                most = min(n, n - need + min(MULTI[-1], need))
                order = np.lexsort((s, q))[:most] if n < 64 else _first(q, s, most)
                cost = np.cumsum(excess[q[order]])
                ell = max(l for l in MULTI if l <= min(need, LEAST_MULTI))
                if cost[n - need + ell - 1] > 0:
                    ell = min((l for l in MULTI if ell <= l <= need), key=lambda l: cost[n - need + l - 1] * (1 + 0.05 * n / l))
                k = n - need + ell
                out[0].append(s[order[:k]])
                out[1].append(np.full(k, sig, np.int64))
                out[2].append((n << 40) + (np.arange(k, dtype=np.int64) << 8) + ell)
            if out[0]:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], names=["token", "sig", "meta"])

    return emit


def _first(q: np.ndarray, s: np.ndarray, most: int) -> np.ndarray:
    """The indexes of the first `most` by level, then hash."""
    if most >= len(q):
        return np.lexsort((s, q))
    bound = np.partition(q, most - 1)[most - 1]
    some = np.flatnonzero(q <= bound)
    return some[np.lexsort((s[some], q[some]))[:most]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and set: all pairs of short posting lists that sizes and places allow (star false, with where the
    shared token stands in either), and of long lists each document with the first (star true)."""
    names = ["a", "b", "meta_a", "meta_b", "star"]

    def made(a, b, ma, mb, star: bool) -> pa.RecordBatch:
        swap = a > b
        a, b, ma, mb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, mb, ma), np.where(swap, ma, mb)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, ma, mb, np.full(len(a), star))], names=names)

    held = [np.zeros(0, np.int64)] * 3
    lead = None  # of a long list that goes on: its token and first set
    for batch in batches:
        tok, sig, meta = (np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("token", "sig", "meta"), strict=True))
        if len(tok) > 1:
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])])
            tok, sig, meta = tok[new], sig[new], meta[new]
        if lead and len(tok):
            k = int(np.searchsorted(tok != lead[0], True)) if (tok != lead[0]).any() else len(tok)
            if k:
                rest = sig[:k] != lead[1]
                yield made(np.full(int(rest.sum()), lead[1]), sig[:k][rest], meta[:k][rest], meta[:k][rest], True)
                tok, sig, meta = tok[k:], sig[k:], meta[k:]
            if len(tok):
                lead = None
        if not len(tok):
            held = [tok, sig, meta]
            continue
        last = int(np.flatnonzero(tok != tok[-1])[-1]) + 1 if tok[0] != tok[-1] else 0
        if len(tok) - last > LIST_MOST:  # the open list is long: a star, now and as it goes on
            lead = (tok[last], sig[last])
            yield made(np.full(len(tok) - last - 1, sig[last]), sig[last + 1 :], meta[last + 1 :], meta[last + 1 :], True)
            held = [x[:0] for x in (tok, sig, meta)]
        else:
            held = [x[last:] for x in (tok, sig, meta)]
        yield from _closed(tok[:last], sig[:last], meta[:last], made)
    yield from _closed(*held, made)


def _closed(tok, sig, meta, made) -> Iterator[pa.RecordBatch]:
    if len(tok) < 2:
        return
    starts = np.concatenate([[0], np.flatnonzero(tok[1:] != tok[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(tok)]]))
    of, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    keep = of > 1
    tok, sig, meta, of, first = (x[keep] for x in (tok, sig, meta, of, np.arange(len(tok)) - first))  # first: place in its list
    if not len(tok):
        return
    star = np.flatnonzero((of > LIST_MOST) & (first > 0))
    if len(star):
        yield made(sig[star - first[star]], sig[star], meta[star], meta[star], True)
    n, pos = meta >> 40, (meta >> 8) & 0xFFFFFFFF
    left = np.flatnonzero(of <= LIST_MOST)
    for d in range(1, LIST_MOST):
        left = left[first[left] + d < of[left]]
        if not len(left):
            break
        i, j = left, left + d
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])  # before this place, and from it on
        fit = (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])) & ((NUM + DEN) * most >= NUM * (n[i] + n[j]))
        i, j = i[fit], j[fit]
        if len(i):
            yield made(sig[i], sig[j], meta[i], meta[j], False)


def _forest(k: int) -> tuple[list[int], callable]:
    parent = list(range(k))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between a left and a right set (all sets, where left is right)."""
    n = np.array([len(s) for s in sets], np.int64)
    parent, find = _forest(len(sets))
    got = []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(new) - 1
    size = np.bincount(token)
    shared = size[token] > 1
    flat, owner = token[shared], owner[shared]
    if not len(flat):
        return got
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    stop = np.concatenate([start[1:], [len(flat)]])
    place = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    by_doc = np.argsort(owner, kind="stable")
    doc_tokens = np.split(place[by_doc], np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
    is_right = np.zeros(len(sets), bool)
    is_right[right] = True
    trees = len(sets)
    for a in left:
        if trees == 1:
            break
        p = doc_tokens[a]
        if not len(p) or NUM * (n[a]) > DEN * len(p):
            continue
        lens = stop[p] - start[p]
        at = np.repeat(start[p] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        over = np.bincount(owner[at], minlength=len(sets))
        for b in np.flatnonzero(((NUM + DEN) * over >= NUM * (n + n[a])) & is_right & (over > 0)):
            x, y = find(int(a)), find(int(b))
            if x != y:
                parent[x] = y
                trees -= 1
                got.append((int(a), int(b)))
    return got


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block key: links between the documents of each block, or of its two sides."""
    memo = word_hash()
    for rows in runs(batches, "key"):
        ids, side = rows["rep"].to_numpy(), rows["side"].to_numpy()
        if len(ids) < 2:
            continue
        sets = [shingles(t or b"", memo) for t in rows["text"].cast(pa.binary()).to_pylist()]
        both = np.arange(len(ids))
        got = linked(sets, both[side <= 0], both[side >= 0])
        if got:
            u, v = ids[[a for a, _ in got]], ids[[b for _, b in got]]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _blocks(members: DataFrame) -> DataFrame:
    """Where each member (cluster, rep, n) is compared: a key and its side (0: with all others of the key).

    A cluster within the block's bounds is one block. A larger one is split by size class - linked sets are of one
    class or neighbours - and within these by hash; each pair of such blocks gets a key.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DEN / NUM)))).cast("long")
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("long")
    per = members.groupBy("cluster").agg(parts.alias("all"))
    one = members.join(per.where("all = 1"), "cluster").select(F.xxhash64("cluster").alias("key"), F.lit(0).alias("side"), "rep")
    large = members.join(per.where("all > 1").select("cluster"), "cluster").withColumn("cls", size)
    cls = large.groupBy("cluster", "cls").agg(parts.alias("m"))
    near = lambda d, as_: cls.select("cluster", (F.col("cls") + d).alias("cls"), F.col("m").alias(as_))
    x = large.join(cls, ["cluster", "cls"]).join(near(-1, "up"), ["cluster", "cls"], "left").join(near(1, "down"), ["cluster", "cls"], "left")
    x = x.withColumn("i", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("m")))
    upto = lambda c: F.when(F.col(c).isNull(), F.expr("array(-1L)")).otherwise(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = x.select("cluster", "cls", "i", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    own = own.select(F.xxhash64("cluster", "cls", "cls", F.least("i", "j"), F.greatest("i", "j")).alias("key"), F.signum(F.col("j") - F.col("i")).cast("int").alias("side"), "rep")
    up = x.select("cluster", "cls", "i", "rep", F.explode(upto("up")).alias("j")).where("j >= 0")
    up = up.select(F.xxhash64("cluster", "cls", F.col("cls") + 1, "i", "j").alias("key"), F.lit(-1).alias("side"), "rep")
    down = x.select("cluster", "cls", "i", "rep", F.explode(upto("down")).alias("j")).where("j >= 0")
    down = down.select(F.xxhash64("cluster", F.col("cls") - 1, "cls", "j", "i").alias("key"), F.lit(1).alias("side"), "rep")
    return one.unionByName(own).unionByName(up).unionByName(down)


def _may_link() -> Column:
    """Whether a pair without a long list in common can have the similarity, by what its prefixes share.

    All that the sets share lies at the first shared place or after it. And what they share of the prefix that ends first
    (in the corpus order) is in both prefixes, so beyond `shared` there is only that set's rest, n - (n - need + l).
    """
    (na, pa, la), (nb, pb, lb) = ((F.shiftright(m, 40), F.expr(f"shiftright({m}, 8) & 4294967295"), F.expr(f"{m} & 255")) for m in ("ma", "mb"))
    least = NUM * (na + nb)
    after = 1 + F.least(na - pa - 1, nb - pb - 1)
    rest = F.greatest(F.ceil(na * NUM / DEN) - la, F.ceil(nb * NUM / DEN) - lb)
    return (F.col("shared") >= F.least(la, lb)) & ((NUM + DEN) * after >= least) & ((NUM + DEN) * (F.col("shared") + rest) >= least)


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and key (a hash of doc_id and text) of every row.

    Links: Jaccard of the shingle sets >= 3/4. Null or empty texts have no shingles and link with nothing. Repeated
    rows are copies of each other and stay; null doc_ids stay and are never a component's name while another is
    there; without a doc_id, a row belongs to the rows of its own set only. Other columns are not read.
    """
    return _similar(docs)[0]


def _similar(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """What similar_documents returns, and the paths that it reads."""
    spark = docs.sparkSession
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles, profiles_path = written(rows.withColumn("key", row_key()).mapInArrow(_profiles, "doc_id long, key long, n long, sig long, chunk int, counts binary"), "profiles")
    levels = spark.sparkContext.broadcast(_sketch(profiles))
    own = profiles.where("chunk is null").select("doc_id", "key", "n", "sig")
    sigs, sigs_path = written(own.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sigs")

    total = own.count()
    first = bit_flag(rows, sigs.select(F.col("rep").alias("doc_id")), "doc_id", "__first", bits_for(sigs.count()))
    one = first.where(F.col("__first") | F.col("doc_id").isNull()).select("doc_id", "text")  # a row of each set, and few others
    tokens = one.mapInArrow(_prefixes(levels), "token long, sig long, meta long")
    lists = tokens.repartition("token").sortWithinPartitions("token", "sig")
    found = lists.mapInArrow(_candidates, "a long, b long, meta_a long, meta_b long, star boolean")
    # a set's meta differs by place only, so that its least has the first place
    per = found.groupBy("a", "b").agg(F.count_if(~F.col("star")).alias("shared"), F.bool_or("star").alias("star"), F.min("meta_a").alias("ma"), F.min("meta_b").alias("mb"))
    edges, edges_path = written(per.where(F.col("star") | _may_link()).select(F.col("a").alias("u"), F.col("b").alias("v")), "candidates")
    release(spark)  # the tokens, which are the most
    clusters = connected_components(edges)
    members, members_path = written(sigs.join(clusters.withColumnRenamed("node", "sig"), "sig").select(F.col("component").alias("cluster"), "rep", "n"), "members")

    blocks = _blocks(members)
    some = bit_prefilter(rows, members.select(F.col("rep").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "rep")
    routed = some.join(blocks.hint("shuffle_hash"), "rep").select("key", "side", "rep", "text")
    links, links_path = written(routed.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "u long, v long"), "links")
    release(spark)
    parts = connected_components(links)
    named = sigs.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "n", "copies", F.coalesce("component", "rep").alias("component_id"))
    for p in (edges_path, members_path, links_path):
        drop_path(spark, p)
    full = hot_split_join(own.where("n > 0"), named, ["sig", "n"], "copies", total)
    found = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key").unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key"))
    return found, [profiles_path, sigs_path]


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one that names it, and one row of repeated ones.

    A group without any doc_id keeps a row of each text. All columns stay. Texts are not shuffled for this, but for a few
    rows that bitmaps leave open.
    """
    spark = docs.sparkSession
    similar, paths = _similar(docs)
    found, _ = written(similar, "similar")
    for p in paths:
        drop_path(spark, p)
    release(spark)
    named = found.select(F.col("key").alias("__row_key"), F.expr("component_id is null or doc_id <=> component_id").alias("__stays"))
    kept = named.where("__stays").groupBy("__row_key").count()
    marked = named.where("not __stays").select("__row_key").unionByName(kept.where("count > 1").select("__row_key"))
    return once_of_kept(docs.withColumn("__row_key", row_key()), kept, marked, "__row_key", bits_for(found.count())).select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return similar_documents(table(spark, sf_dir, "documents")).drop("key")
