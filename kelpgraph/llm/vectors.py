"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Every vector is normalised and sent to the cell of its nearest centroid; it is
also sent, as a candidate only, to those neighbouring cells whose border is so
close that a vector of at least ``min_score`` cosine may live beyond it. In a
cell each member is coded relative to the centroid: one sign bit for each
coordinate of the randomly rotated residual, packed, plus two scalars (length
of the residual, inner product of the residual with its code). The inner
product of a query with a coded vector is estimated from the packed bits: the
rotated query is rounded to ``PLANES`` bits a coordinate, and each of its bit
planes meets the codes by AND and population count of 64-bit words. The
estimate plus its error bound decides which vectors are reranked exactly.

Scale: the vectors are shuffled once for the latest version and once by cell.
A cell larger than ``block_rows`` is split into blocks of queries. Groups of
equal vectors that hold more than ``1 / HOT_SHARE`` of all rows (at most
``HOT_SHARE`` groups, hence broadcast with a proven bound) leave the cells but
for a few and are linked in id order, in ranges of ids with the heads of the
ranges that follow: the same pairs that the search gives to equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 10_000
HOT_LEAST = 64
#: Bits of a query's coordinate, and how many deviations of the estimate its error bound spans.
PLANES, SURENESS = 4, 3.0
PACKED = "model string, node_id long, cell int, block int, home boolean, vec binary"


@dataclass(frozen=True)
class CellIndex:
    """Centroids of one model, fitted on a bounded sample; ``blocks`` gives the query blocks of each cell."""

    dim: int
    centroids: np.ndarray
    blocks: np.ndarray


def latest_vectors(embeddings: DataFrame) -> DataFrame:
    """(model, node_id, dim, embedding) of the row with the latest ``embedded_at`` of each (node_id, model).

    Equal times are decided by the larger ``id``. Rows with a null node or model
    have no key and are left out. Other columns, whatever their names, are ignored.
    """
    picked = embeddings.select("id", "node_id", "model", "dim", "embedding", "embedded_at")
    rows = picked.where(F.col("node_id").isNotNull() & F.col("model").isNotNull())
    last = F.max_by(F.struct("dim", "embedding"), F.struct("embedded_at", "id")).alias("last")
    return rows.groupBy("model", "node_id").agg(last).select("model", "node_id", "last.dim", "last.embedding")


def raw_hashes() -> dict:
    """Two independent hashes of a stored vector, 96 bits in all."""
    return {"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")}


def _unit_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row numbers of the usable vectors grouped by dim: (row, dim, offset) and their float32 unit vectors."""
    lists = batch.column(batch.schema.get_field_index("embedding"))
    dims = np.nan_to_num(batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False).astype("f8"), nan=-1).astype("i8")
    offsets = lists.offsets.to_numpy()
    values = lists.values
    holes = np.zeros(len(values), dtype=bool) if values.null_count == 0 else np.asarray(values.is_null())
    flat = values.to_numpy(zero_copy_only=False).astype("f4")
    flat = np.where(holes, np.nan, flat) if holes.any() else flat
    lengths = offsets[1:] - offsets[:-1]
    present = np.asarray(lists.is_valid()) & (lengths == dims) & (dims > 0)
    out_rows, out_dims, out_vecs = [], [], []
    for dim in np.unique(dims[present]):
        rows = np.nonzero(present & (dims == dim))[0]
        matrix = flat[offsets[rows][:, None] + np.arange(dim)[None, :]].astype("f8")
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(norms) & (norms > 0)
        out_rows.append(rows[good])
        out_dims.append(np.full(good.sum(), dim))
        out_vecs.append((matrix[good] / norms[good, None]).astype("f4"))
    return np.concatenate(out_rows) if out_rows else np.zeros(0, "i8"), np.concatenate(out_dims) if out_dims else np.zeros(0, "i8"), lengths, out_vecs


def pack_unit(current: DataFrame) -> DataFrame:
    """(model, node_id, vec, h1, h2): the usable vectors as unit length float32 bytes.

    A vector is usable if its length equals ``dim``, it has no NaN, infinity or
    null, and is not all zero; the rest have no similar node and leave here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _, _, groups = _unit_rows(batch)
            if not len(rows):
                continue
            vecs = [v.tobytes() for group in groups for v in group]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(vecs, pa.binary()), batch.column(4).take(take), batch.column(5).take(take)], names=["model", "node_id", "vec", "h1", "h2"])

    hashed = current.withColumns(raw_hashes())
    return hashed.select("model", "node_id", "dim", "embedding", "h1", "h2").mapInArrow(run, "model string, node_id long, vec binary, h1 long, h2 int")


def _kmeans(sample: np.ndarray, cells: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(home, kind="stable")
        counts = np.bincount(home, minlength=cells)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home[order], sample[order])
        filled = counts > 0
        centroids[filled] = sums[filled]
        centroids[~filled] = sample[rng.choice(len(sample), (~filled).sum())]
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids.astype("f4")


def fit_cells(embeddings: DataFrame, *, cell_rows: int = 1024, block_rows: int = 8192, sample_per_cell: int = 24, max_sample: int = 262_144, rounds: int = 5, seed: int = 7) -> dict[tuple[str, int], CellIndex]:
    """Centroids for each (model, dim), fitted on at most ``max_sample`` rows of it.

    The sample is drawn by a hash of the row id; every row is indexed later.
    The driver holds the sample and the centroids, both bounded by ``max_sample``.
    """
    usable = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dim")) & (F.col("dim") > 0) & F.col("model").isNotNull())
    out: dict[tuple[str, int], CellIndex] = {}
    for found in usable.groupBy("model", "dim").count().collect():  # one row per model
        n = found["count"]
        cells = max(1, min(-(-n // cell_rows), max_sample // sample_per_cell))
        want = min(max_sample, cells * sample_per_cell)
        share = min(1.0, 1.3 * want / n)
        rows = usable.where((F.col("model") == found["model"]) & (F.col("dim") == found["dim"])).where(F.pmod(F.xxhash64("node_id", "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        table = rows.select("model", "node_id", "dim", "embedding").limit(max_sample).toArrow()
        vecs = [g for batch in table.combine_chunks().to_batches() for g in _unit_rows(batch)[3]]
        if not vecs:
            continue
        sample = np.concatenate(vecs)
        cells = min(cells, len(sample))
        centroids = _kmeans(sample, cells, rounds, np.random.default_rng(seed))
        home = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        share_of = np.bincount(home, minlength=cells) / len(sample)
        out[(found["model"], found["dim"])] = CellIndex(found["dim"], centroids, np.maximum(1, np.ceil(share_of * n / block_rows)).astype("i4"))
    return out


def assign_cells(packed: DataFrame, index: dict[tuple[str, int], CellIndex], *, min_score: float, spread: float = 1.0) -> DataFrame:
    """Rows for (model, cell, block): members of the cell, and candidates from across its borders.

    A candidate copy goes to each cell c for which the gap between the vector's inner
    products with its own centroid h and with c is at most
    ``spread * tan(angle) * |c - h| / sqrt(dim)``, the gap a neighbour at the
    threshold angle typically crosses; either side's copy finds the pair.
    Vectors of a (model, dim) that the index has not seen form one cell.
    """
    shared = packed.sparkSession.sparkContext.broadcast(index)  # bounded by fit_cells(max_sample)
    tangent = float(np.sqrt(max(0.0, 1 - min_score**2)) / max(min_score, 0.05))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of = shared.value
        for batch in batches:
            models = np.asarray(batch.column(0).to_pylist(), dtype=object)
            ids = batch.column(1).to_numpy()
            vecs = np.asarray(batch.column(2).to_pylist(), dtype=object)
            sizes = np.fromiter((len(v) for v in vecs), dtype="i8", count=len(vecs))
            out: list[list] = [[], [], [], [], [], []]
            for model, size in {*zip(models, sizes)}:
                pick = np.nonzero((models == model) & (sizes == size))[0]
                dim = int(size) // 4
                matrix = np.frombuffer(b"".join(vecs[pick]), dtype="f4").reshape(-1, dim)
                known = cells_of.get((model, dim))
                centroids = known.centroids if known else np.zeros((1, dim), "f4")
                blocks = known.blocks if known else np.ones(1, "i4")
                dots = matrix @ centroids.T
                home = dots.argmax(axis=1)
                pairs = [(np.arange(len(pick)), home, np.ones(len(pick), bool))]
                if len(centroids) > 1:
                    copies = []
                    for h in np.unique(home):
                        at = np.nonzero(home == h)[0]
                        gap = dots[at, h][:, None] - dots[at]
                        reach = np.linalg.norm(centroids - centroids[h], axis=1) * (spread * tangent / np.sqrt(dim))
                        reach[h] = -9
                        row, cell = np.nonzero(gap <= reach)
                        copies.append((at[row], cell))
                    row, cell = (np.concatenate(x) for x in zip(*copies))
                    pairs.append((row, cell, np.zeros(len(row), bool)))
                for row, cell, is_home in pairs:
                    count = blocks[cell]
                    block = ids[pick][row] % count if is_home.all() else np.zeros(len(row), "i8")
                    wide = np.nonzero(count > 1)[0]
                    extra = [(np.full(1, r), np.array([b])) for r in wide for b in range(count[r]) if not (is_home[r] and b == block[r]) and not (not is_home[r] and b == 0)]
                    more = np.concatenate([e[0] for e in extra]) if extra else np.zeros(0, "i8")
                    more_block = np.concatenate([e[1] for e in extra]) if extra else np.zeros(0, "i8")
                    all_rows = np.concatenate([np.arange(len(row)), more]).astype("i8")
                    out[0] += [model] * len(all_rows)
                    out[1].append(ids[pick][row][all_rows])
                    out[2].append(cell[all_rows])
                    out[3].append(np.concatenate([block, more_block]))
                    out[4].append(np.concatenate([is_home, np.zeros(len(more), bool)]))
                    out[5].append(vecs[pick][row][all_rows])
            if out[0]:
                flat = [out[0], *(np.concatenate(x) for x in out[1:])]
                types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(flat, types)], names=["model", "node_id", "cell", "block", "home", "vec"])

    return packed.mapInArrow(run, PACKED)


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype("f4")


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits of the rotated residuals, packed into 64-bit words, residual lengths, and inner products of residual and code."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = (rest / np.maximum(length, 1e-12)[:, None]) @ turn
    fit = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return _words(unit > 0), length, np.maximum(fit, 1e-6)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words; missing bits are 0."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("u8")


def estimate(packed: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, sureness: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of each query (row) with each coded vector (column), estimated, and the width of the error bound.

    With b the bits of a code and x a query rounded to lo + step * u, the inner
    product with the signs is 2 * (lo * |b| + step * sum of 2^j * |b and u_j|) - sum of x,
    where u_j are the bit planes of u: only packed bits are read.
    """
    dim = queries.shape[1]
    rest = queries - centre
    q_len = np.linalg.norm(rest, axis=1)
    unit = (rest / np.maximum(q_len, 1e-12)[:, None]) @ turn
    low = unit.min(axis=1, keepdims=True)
    step = np.maximum((unit.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
    rounded = np.round((unit - low) / step).astype("u1")
    hits = np.zeros((len(queries), len(packed)), dtype="i4")
    for j in range(PLANES):
        plane = _words((rounded >> j) & 1)
        for w in range(packed.shape[1]):
            hits += np.bitwise_count(plane[:, w, None] & packed[None, :, w]).astype("i4") << j
    ones = np.bitwise_count(packed).sum(axis=1, dtype="i4")
    total = (low * dim + step * rounded.sum(axis=1, dtype="i4")[:, None]).astype("f4")
    signed = 2 * (low.astype("f4") * ones[None, :] + step.astype("f4") * hits) - total
    inner = signed / (np.sqrt(dim) * fit.astype("f4"))[None, :]
    spread = np.sqrt(np.maximum(0, 1 - fit**2)[None, :] / max(1, dim - 1) + step**2 / 12) / fit[None, :]
    scale = q_len[:, None] * length[None, :]
    cosine = 1 - (q_len[:, None] ** 2 + length[None, :] ** 2 - 2 * scale * inner) / 2
    return cosine, scale * (sureness * spread)


def nearest_in_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, min_score: float, sureness: float = SURENESS, cells: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, other id, score) of the k best per query with at least ``min_score``; ties at the k-th place all stay.

    With ``sureness`` infinite every vector is reranked, which is the exact search.
    """
    turn = rotation(queries.shape[1])
    centre = vectors.mean(axis=0)
    packed, length, fit = encode(vectors, centre, turn)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = max(8, cells // max(1, len(ids)))  # queries at a time: memory does not grow with the block
    for at in range(0, len(queries), rows):
        part, part_ids = queries[at : at + rows], q_ids[at : at + rows]
        guess, width = estimate(packed, length, fit, part, centre, turn, sureness) if np.isfinite(sureness) else (np.zeros((len(part), len(ids)), "f4"), np.float32(2))
        same = part_ids[:, None] == ids[None, :]
        low = np.where(same, -9, guess - width)
        floor = np.full(len(part), min_score - 1e-6)
        if len(ids) > k:  # nothing below the k-th best lower bound can be among the k best
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((guess + width >= floor[:, None]) & ~same)
        score = np.round(np.einsum("ij,ij->i", part[row].astype("f8"), vectors[col].astype("f8")), 6)
        keep = score >= min_score
        row, col, score = row[keep], col[keep], score[keep]
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, np.arange(len(part)))
        last = np.searchsorted(row, np.arange(len(part)), side="right")
        kth = np.full(len(part), -9.0)
        full = last - first >= k
        kth[full] = score[first[full] + k - 1]
        keep = score >= kth[row]
        found.append((part_ids[row[keep]], ids[col[keep]], score[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))


def _search_group(k: int, min_score: float, both: bool, sureness: float):
    """Groups of (model, cell, block) to (model, node_id, other_id, score) rows; ``both`` also returns the way back."""
    names = ["model", "node_id", "other_id", "score"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        home = group.column("home").to_numpy()
        ids = group.column("node_id").to_numpy()
        raw = group.column("vec").to_pylist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.fromiter(map(len, raw), "i8", len(raw))
        for size in np.unique(sizes):
            pick = np.nonzero(sizes == size)[0]
            matrix = np.frombuffer(b"".join(raw[i] for i in pick), dtype="f4").reshape(len(pick), -1)
            at_home = home[pick]
            if not at_home.any():
                continue
            own, visitors = ids[pick], ids[pick][~at_home]
            out.append(nearest_in_block(own[at_home], matrix[at_home], own, matrix, k, min_score, sureness))
            if both and len(visitors):
                out.append(nearest_in_block(visitors, matrix[~at_home], own[at_home], matrix[at_home], k, min_score, sureness))
        flat = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        model = [group.column("model")[0].as_py()] * len(flat[0])
        return pa.Table.from_arrays([pa.array(x, type=t) for x, t in zip([model, *flat], kinds)], names=names)

    return run


FOUND = "model string, node_id long, other_id long, score double"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each node. Equal scores go to the next larger ids, then round to the smallest."""
    order = Window.partitionBy("model", "node_id").orderBy(F.desc("score"), (F.col("other_id") < F.col("node_id")).cast("int"), "other_id")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hot_groups(embeddings: DataFrame, rows: int) -> list:
    """Groups of equal stored vectors of more than ``max(HOT_LEAST, rows / HOT_SHARE)`` rows: at most HOT_SHARE of them."""
    keys = embeddings.where(F.col("embedding").isNotNull()).groupBy("model", *[c.alias(n) for n, c in raw_hashes().items()]).agg(F.count("*").alias("members"))
    return keys.where(F.col("members") > max(HOT_LEAST, rows // HOT_SHARE)).collect()


def similar_vectors(embeddings: DataFrame, *, k: int = 5, min_score: float = 0.90, spread: float = 1.0, cell_rows: int = 1024, block_rows: int = 8192, max_sample: int = 262_144, sureness: float = SURENESS) -> DataFrame:
    """(model, node_id, other_id, score, place): for every node its k most similar nodes of the same model.

    Only neighbours of at least ``min_score`` are returned; the score is the
    cosine rounded to 6 places. Unusable vectors (see ``pack_unit``) and empty
    tables give no rows; repeated rows count once; equal vectors are similar
    with score 1 and ties go round by id, so up to 2k + 1 equal vectors are all
    paired with each other. A pair across cells is found if either copy crosses
    the border within ``spread``; ``sureness`` (infinite: exact inside cells) and
    a single cell (``cell_rows`` of at least the table's rows) give the exact
    answer, at quadratic cost.
    """
    index = fit_cells(embeddings, cell_rows=cell_rows, block_rows=block_rows, max_sample=max_sample)
    packed = pack_unit(latest_vectors(embeddings))
    rows = embeddings.count()
    linked = None
    hot = hot_groups(embeddings, rows)
    if hot:
        small = F.broadcast(embeddings.sparkSession.createDataFrame([tuple(r) for r in hot], "model string, h1 long, h2 int, members long"))
        keyed = packed.join(small, ["model", "h1", "h2"], "left")
        packed = keyed.where(F.col("members").isNull()).select("model", "node_id", "vec")
        group = ["model", "h1", "h2"]
        members = keyed.where(F.col("members").isNotNull())
        spans = F.broadcast(members.groupBy(*group).agg(F.min("node_id").alias("least"), F.max("node_id").alias("most")))  # at most HOT_SHARE groups
        ranges = F.greatest(F.lit(1), (F.col("members") / 2000).cast("long"))
        part = F.least(ranges - 1, F.floor((F.col("node_id") - F.col("least")) / (F.col("most") - F.col("least") + 1) * ranges).cast("long"))
        placed = members.join(spans, group).withColumn("part", part)
        ring = Window.partitionBy(*group, "part").orderBy("node_id")
        ringed = placed.withColumns({"n": F.row_number().over(ring), **{f"next{i}": F.lead("node_id", i).over(ring) for i in range(1, k + 1)}})
        heads = ringed.where(F.col("n") <= k + 1).groupBy(*group, "part").agg(F.array_sort(F.collect_list("node_id")).alias("heads"))
        after = Window.partitionBy(*group).orderBy("part")
        following = heads.withColumns({"later": F.flatten(F.collect_list("heads").over(after.rowsBetween(1, k))), "at": F.row_number().over(after)})
        firsts = heads.withColumn("at", F.row_number().over(after)).where(F.col("at") <= k + 1).groupBy(*group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("heads"))), 1, k + 1).alias("first"))
        kept = ringed.join(F.broadcast(firsts), group).where(F.array_contains("first", F.col("node_id"))).select("model", "node_id", "vec")
        known = ringed.join(following.select(*group, "part", "later"), [*group, "part"]).join(F.broadcast(firsts), group)
        others = F.slice(F.filter(F.array_distinct(F.concat(F.array_compact(F.array(*[f"next{i}" for i in range(1, k + 1)])), "later", "first")), lambda x: x != F.col("node_id")), 1, k)
        linked = known.select("model", "node_id", F.explode(others).alias("other_id"), F.lit(1.0).alias("score"))
        packed = packed.unionByName(kept)
    placed = assign_cells(packed.select("model", "node_id", "vec"), index, min_score=min_score, spread=spread)
    found = placed.groupBy("model", "cell", "block").applyInArrow(_search_group(k, min_score, True, sureness), FOUND)
    return best_of(found.unionByName(linked) if linked is not None else found, k)


def search_vectors(embeddings: DataFrame, is_query, *, k: int = 10, block_rows: int = 16_384, sureness: float = SURENESS) -> DataFrame:
    """(model, node_id, other_id, score, place): the k most similar of all nodes for the nodes that ``is_query`` selects.

    Every row is scanned, in blocks of about ``block_rows`` rows of one model, by
    its code and reranked within the error bound, so the recall is that of the
    bound; an infinite ``sureness`` scans exactly. Queries are copied to each
    block. Same rules for bad rows as ``similar_vectors``.
    """
    packed = pack_unit(latest_vectors(embeddings))
    blocks = max(1, -(-embeddings.count() // block_rows))
    members = packed.select("model", "node_id", F.lit(0).alias("cell"), F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("home"), "vec")
    asked = packed.where(is_query).select("model", "node_id", F.lit(0).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("home"), "vec")
    names = ["model", "node_id", "other_id", "score"]

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        home = group.column("home").to_numpy()
        ids = group.column("node_id").to_numpy()
        raw = group.column("vec").to_pylist()
        sizes = np.fromiter(map(len, raw), "i8", len(raw))
        out = []
        for size in np.unique(sizes):
            pick = np.nonzero(sizes == size)[0]
            matrix = np.frombuffer(b"".join(raw[i] for i in pick), dtype="f4").reshape(len(pick), -1)
            asks = home[pick]
            if asks.any() and not asks.all():
                out.append(nearest_in_block(ids[pick][asks], matrix[asks], ids[pick][~asks], matrix[~asks], k, -1.0, sureness))
        flat = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        model = [group.column("model")[0].as_py()] * len(flat[0])
        return pa.Table.from_arrays([pa.array(x, type=t) for x, t in zip([model, *flat], [pa.string(), pa.int64(), pa.int64(), pa.float64()])], names=names)

    found = members.unionByName(asked).groupBy("model", "cell", "block").applyInArrow(run, FOUND)
    return best_of(found, k)


def similar_pairs(embeddings: DataFrame, **options) -> DataFrame:
    """(model, node_a, node_b) with node_a < node_b: one is among the k most similar of the other."""
    rows = similar_vectors(embeddings, **options)
    return rows.select("model", F.least("node_id", "other_id").alias("node_a"), F.greatest("node_id", "other_id").alias("node_b")).distinct()


def search_recall(embeddings: DataFrame, is_query, *, k: int = 10) -> DataFrame:
    """(model, exact, found, recall): how many of the exact k best of the queries the search by codes finds."""
    exact = search_vectors(embeddings, is_query, k=k, sureness=float("inf")).select("model", "node_id", "other_id")
    got = search_vectors(embeddings, is_query, k=k).select("model", "node_id", "other_id", F.lit(1).alias("hit"))
    both = exact.join(got, ["model", "node_id", "other_id"], "left").groupBy("model").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.round(F.col("found") / F.col("exact"), 4))


def pair_recall(embeddings: DataFrame, is_query, *, k: int = 5, min_score: float = 0.90) -> DataFrame:
    """(model, exact, found, recall): of the exact k best of at least ``min_score`` of the queries, how many ``similar_vectors`` finds."""
    exact = search_vectors(embeddings, is_query, k=k, sureness=float("inf")).where(F.col("score") >= min_score).select("model", "node_id", "other_id")
    got = similar_vectors(embeddings, k=k, min_score=min_score).where(is_query).select("model", "node_id", "other_id", F.lit(1).alias("hit"))
    both = exact.join(got, ["model", "node_id", "other_id"], "left").groupBy("model").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.round(F.col("found") / F.col("exact"), 4))
