"""Filling containers of fixed capacity with texts, by lexical retrieval.

Documents are put into shards of bounded size by their most telling word, that
of the largest BM25 weight: the words stand in a fixed order, a word's documents
fill a stretch as long as their tokens, and a shard is a piece of this line, so
that documents about one thing meet in one shard. Each shard has a BM25 inverted
index over its documents, with document frequencies and mean length of the whole
corpus; a seed asks with all its words. The longest unused document seeds a container; the index
returns its unused neighbours, best first, which fill the window greedily, and
the rest of the window takes the longest unused document that fits, again and
again. Only a document longer than a container is split: into full containers
and a remainder, which is packed like a document.

Scale: the vocabulary is hashed into ``TERMS`` buckets, so the table of
document frequencies has a fixed size; it is counted over all documents with
partial sums, and so are the tokens of each telling word. A shard holds about
``shard_tokens`` tokens whatever the corpus size; the documents of a hot word, or
copies of a hot text, are spread by a hash over as many shards as they fill.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.llm.tokens import VOCABULARY, _counter

TERMS = 1 << 18
K1, BM25_B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Up to so many documents a shard's common words are a matrix (documents squared); beyond it they are lists like the others.
DENSE = 8192
_WORD = re.compile(r"\w+")
SHARD_TOKENS = 1_500_000
PACKED = "bin_class string, container string, doc_id long, piece int, start_token long, end_token long, how string"


class _Buckets(dict):
    """Hash buckets of words."""

    def __missing__(self, word: str) -> int:
        from zlib import crc32

        bucket = crc32(word.encode("utf-8", "surrogatepass")) & (TERMS - 1)
        if len(self) < 300_000:
            self[word] = bucket
        return bucket


def described_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, terms binary): token count, and packed (bucket int32, times int32) pairs of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, bucket = _counter(vocabulary), _Buckets()
        for batch in batches:
            tokens, terms = [], []
            for text in batch.column(1).to_pylist():
                tokens.append(count(text) if text else 0)
                seen = Counter(map(bucket.__getitem__, _WORD.findall(text.lower()))) if text else {}
                terms.append(np.array([*seen.keys(), *seen.values()], dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(terms, pa.binary())], names=["doc_id", "tokens", "terms"])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens long, terms binary")


def corpus_statistics(described: DataFrame) -> tuple[np.ndarray, int, float, int]:
    """Document frequencies by bucket, number of documents, mean length in words, sum of tokens; over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 3, dtype="i8")
        for batch in batches:
            for tokens, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(raw, dtype="<i4").reshape(2, -1)
                seen[pairs[0]] += 1
                seen[TERMS] += 1
                seen[TERMS + 1] += pairs[1].sum()
                seen[TERMS + 2] += tokens
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["at", "n"])

    sums = described.select("tokens", "terms").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS + 3 rows
    whole = np.zeros(TERMS + 3, dtype="i8")
    whole[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    n = int(whole[TERMS])
    return whole[:TERMS], n, float(whole[TERMS + 1]) / max(1, n), int(whole[TERMS + 2])


def _idf(df: np.ndarray, documents: int) -> np.ndarray:
    return np.maximum(np.log((documents - df + 0.5) / (df + 0.5)), LEAST_IDF)


def telling_word(raw: bytes, frequency: np.ndarray, documents: int, mean: float) -> int:
    """The bucket of the word with the largest BM25 weight that another document holds too; -1 if there is none."""
    terms, times = np.frombuffer(raw, dtype="<i4").reshape(2, -1)
    df = frequency[terms]
    weight = np.where(df > 1, _idf(df, documents), 0.0) * times * (K1 + 1) / (times + K1 * (1 - BM25_B + BM25_B * times.sum() / max(mean, 1e-9)))
    return int(terms[np.lexsort((terms, -weight))[0]]) if len(terms) and weight.max() > 0 else -1


class ShardIndex:
    """BM25 postings of one shard's documents."""

    def __init__(self, packed: list[bytes], frequency: np.ndarray, documents: int, mean: float):
        pairs = [np.frombuffer(raw, dtype="<i4").reshape(2, -1) for raw in packed]
        self.n = len(pairs)
        counts = np.array([p.shape[1] for p in pairs])
        terms = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, "i4")
        times = np.concatenate([p[1] for p in pairs]).astype("f8") if pairs else np.zeros(0)
        owner = np.repeat(np.arange(self.n), counts)
        length = np.bincount(owner, times, minlength=self.n)
        df = frequency[terms]
        idf = _idf(df, documents)
        weight = idf * times * (K1 + 1) / (times + K1 * (1 - BM25_B + BM25_B * length[owner] / max(mean, 1e-9)))
        order = np.argsort(terms, kind="stable")
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.docs, self.weights = owner[order], weight[order]
        start = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(self.terms, terms)
        # a word of one document retrieves nothing, one of most documents tells nothing
        many = self.last - self.first
        useful = (many[at] > 1) & (idf > LEAST_IDF)
        # words of many of the shard's documents are worked off for all seeds at once, as one product of matrices
        dense = np.nonzero(many * 16 >= self.n)[0] if 1 < self.n <= DENSE else np.zeros(0, "i8")
        slot = np.full(len(self.terms) + 1, -1)
        slot[dense] = np.arange(len(dense))
        here = np.nonzero(useful & (slot[at] >= 0))[0] if len(dense) else np.zeros(0, "i8")
        self.common = None
        if len(here):
            holds, tells = np.zeros((self.n, len(dense)), "f4"), np.zeros((len(dense), self.n), "f4")
            holds[owner[here], slot[at[here]]] = 1
            tells[slot[at[here]], owner[here]] = weight[here]
            self.common = holds @ tells
            useful[here] = False
        self.queries = [at[start[d] : start[d + 1]][useful[start[d] : start[d + 1]]] for d in range(self.n)]

    def neighbours(self, doc: int, free: np.ndarray) -> np.ndarray:
        """Documents that share a word with ``doc`` and have ``free`` set, by falling BM25 score, then number."""
        scores = self.common[doc].astype("f8") if self.common is not None else np.zeros(self.n)
        spans = [slice(self.first[t], self.last[t]) for t in self.queries[doc]]
        if spans:
            scores += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), minlength=self.n)
        scores[~free] = 0
        found = np.nonzero(scores)[0]
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(index: ShardIndex, sizes: np.ndarray, capacity: int) -> list[list[tuple]]:
    """Containers of (document, piece, start, end, how) for one capacity; sizes in tokens.

    ``how`` is part (of an oversized document), seed, neighbour (retrieved), fit
    (best fit of the rest) or empty.
    """
    out: list[list[tuple]] = []
    whole = sizes // capacity
    whole[(sizes % capacity == 0) & (sizes > 0)] -= 1  # the last full piece is the remainder
    for doc in np.nonzero(whole > 0)[0]:
        out += [[(int(doc), p, p * capacity, (p + 1) * capacity, "part")] for p in range(whole[doc])]
    rest = sizes - whole * capacity
    free = rest > 0
    stacks: dict[int, list[int]] = {}
    for doc in np.argsort(-np.arange(len(rest))):
        if rest[doc] > 0:
            stacks.setdefault(int(rest[doc]), []).append(int(doc))
    mask = 0
    for size in stacks:
        mask |= 1 << size

    def longest(gap: int) -> int | None:
        nonlocal mask
        while True:
            size = (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if size <= 0:
                return None
            stack = stacks[size]
            while stack and not free[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            mask &= ~(1 << size)

    def item(doc: int, how: str) -> tuple:
        free[doc] = False
        return doc, int(whole[doc]), int(whole[doc]) * capacity, int(sizes[doc]), how

    while (seed := longest(capacity)) is not None:
        window = [item(seed, "seed")]
        gap = capacity - int(rest[seed])
        if gap and (mask & ((1 << (gap + 1)) - 1)):
            near = index.neighbours(seed, free & (rest <= gap))
            while len(near):
                window.append(item(int(near[0]), "neighbour"))
                gap -= int(rest[near[0]])
                near = near[1:][rest[near[1:]] <= gap]
            while gap and (doc := longest(gap)) is not None:
                window.append(item(doc, "fit"))
                gap -= int(rest[doc])
        out.append(window)
    empty = [(int(d), 0, 0, 0, "empty") for d in np.nonzero(sizes == 0)[0]]
    if empty:
        out = out or [[]]
        out[-1] += empty
    return out


def pack_documents(documents: DataFrame, bins: DataFrame, *, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, described: DataFrame | None = None) -> DataFrame:
    """(bin_class, container, doc_id, piece, start_token, end_token, how): every document in containers of every class.

    A container never holds more tokens than its class allows; a document is
    split only if it is longer. Null and empty texts are items of 0 tokens.
    Every row is packed, repeated texts and repeated ids too. Classes with a
    null name or a capacity that is null or below 1 are left out; the largest
    capacity of a repeated class counts. Empty tables give no rows.
    """
    classes = sorted({r["bin_class"]: r["capacity_tokens"] for r in bins.where("bin_class is not null and capacity_tokens >= 1").groupBy("bin_class").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()}.items())  # a row a class, given by hand
    rows = described if described is not None else described_documents(documents, vocabulary)
    frequency, n, mean, total = corpus_statistics(rows)
    shared = documents.sparkSession.sparkContext.broadcast(frequency.astype("i4") if n < 2**31 else frequency)  # TERMS numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [telling_word(raw, shared.value, n, mean) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int32())], names=["doc_id", "tokens", "terms", "word"])

    told = rows.select("doc_id", "tokens", "terms").mapInArrow(place, "doc_id long, tokens long, terms binary, word int")
    lengths = told.groupBy("word").agg(F.sum("tokens").alias("length"))  # at most TERMS + 1 rows
    line = Window.partitionBy().orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    stretches = lengths.select("word", "length", F.coalesce(F.sum("length").over(line), F.lit(0)).alias("begins"))
    spread = F.pmod(F.xxhash64("doc_id", F.xxhash64("terms")), F.lit(1 << 30)) / float(1 << 30)
    keyed = told.join(F.broadcast(stretches), "word").select("doc_id", "tokens", "terms", F.floor((F.col("begins") + spread * F.col("length")) / shard_tokens).cast("int").alias("shard"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("tokens", "descending"), ("doc_id", "ascending")])
        ids = group.column("doc_id").to_pylist()
        sizes = group.column("tokens").to_numpy().copy()
        shard = group.column("shard")[0].as_py()
        index = ShardIndex(group.column("terms").to_pylist(), shared.value, n, mean)
        out: list[list] = [[] for _ in range(7)]
        for name, capacity in classes:
            for number, window in enumerate(pack_shard(index, sizes, capacity)):
                label = f"{shard}-{number}"
                docs, *rest = zip(*window) if window else [[]] * 5
                for column, values in zip(out, ([name] * len(window), [label] * len(window), [ids[d] for d in docs], *rest)):
                    column += values
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=["bin_class", "container", "doc_id", "piece", "start_token", "end_token", "how"])

    return keyed.groupBy("shard").applyInArrow(run, PACKED)


def container_fill(packed: DataFrame, bins: DataFrame) -> DataFrame:
    """A row for each class: containers, tokens, the share of the capacity that is used, and which shares retrieval and best fit filled.

    ``retrieved`` is the share of the tokens beside seeds and parts that are neighbours of their seed.
    """
    size = F.col("end_token") - F.col("start_token")
    used = packed.groupBy("bin_class", "container").agg(F.sum(size).alias("used"), F.sum(F.when(F.col("how") == "neighbour", size).otherwise(0)).alias("near"), F.sum(F.when(F.col("how").isin("neighbour", "fit"), size).otherwise(0)).alias("filled"))
    sums = used.groupBy("bin_class").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("near").alias("near"), F.sum("filled").alias("filled"))
    sizes = bins.where("bin_class is not null").groupBy("bin_class").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    full = sums.join(F.broadcast(sizes), "bin_class").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    return full.withColumn("retrieved", F.round(F.col("near") / F.greatest(F.col("filled"), F.lit(1)), 6)).drop("near", "filled")
