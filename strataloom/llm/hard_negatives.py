"""Hard negatives by anchor-clustered shared lists, in the manner of MAXIMUS (Abuzaid et al., 2019).

Anchors are clustered by direction. For a cluster with centroid c whose members lie within the angle t of it, a vector v
at the angle s from c has an inner product of |u| |v| cos(max(0, s - t)) at most with any member u. Candidates are sorted
by this bound once for the cluster, and each member walks the list, until what it has found or what it asks for is above
everything that the rest can reach. So results are exact, whatever the centroids, which come from a bounded sample.

At scale a cluster's list is dealt out to blocks, and clusters of very many members to slices; a task walks one block for
one slice and sends on the best few of each member. Candidates whose bound is below what any member of a slice asks for are
not sent there: members know from a bounded sample of rows, or from their positives, what they need at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import written

#: Rows by which centroids and first thresholds are found, at most.
SAMPLE_ANCHORS, SAMPLE_ROWS = 4096, 8192
#: Clusters of anchors at most, and anchors for each below that.
CLUSTERS, ANCHORS_EACH = 64, 128
#: Members of a slice and candidates of a block, at most.
SLICE, BLOCK = 1024, 1 << 15
#: Components are held to what keeps sums in 63 bits; below 2 ** 53 sums are exact as doubles.
LIMIT = 1 << 27
#: A request that asks for all scores.
NONE = int(np.iinfo(np.int64).min)


@dataclass(frozen=True)
class Rule:
    """positives of each anchor, negatives of each positive, and low * positive <= 100 * negative <= 100 * positive."""

    positives: int = 5
    negatives: int = 5
    low: int = 80


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double, in whole numbers; null where a component is null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * scale).cast("double"))).cast("int")
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector, whole))


def _packed(df: DataFrame) -> DataFrame:
    """q as the bytes of its numbers, four each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            flat, ends = q.flatten().to_numpy().astype("<i4"), q.offsets.to_numpy()
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("q"), "q", packed)

    return df.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'q' else t}" for n, t in df.dtypes))


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers, shorter vectors filled up with zeros."""
    data = b"".join(x if len(x) == 4 * width else x + bytes(4 * width - len(x)) for x in vectors)
    return np.frombuffer(data, "<i4").reshape(len(vectors), width).astype(np.int64)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def _products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not len(u) or not len(v) or _norms(u).max() * _norms(v).max() < 2**52:
        return (u.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return u @ v.T


def _angles(m: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """To a centre of length one; 0 for zero vectors."""
    return np.arccos(np.clip(m @ centre / np.where(norms > 0, norms, 1), -1, 1)) * (norms > 0)


def _bounds(norms: np.ndarray, angles: np.ndarray, within: float) -> np.ndarray:
    """What a member of length one within that angle of the centre can reach with each vector, with room for rounding."""
    return norms * np.minimum(1, np.cos(np.maximum(0, angles - within)) + 1e-6)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions at most by spherical k-means, first ones spread out."""
    unit = sample[_norms(sample) > 0].astype(np.float64)
    if not len(unit):
        return np.eye(1, max(1, sample.shape[1]))
    unit /= _norms(unit)[:, None]
    chosen, nearest = [unit[0]], unit @ unit[0]
    for _ in range(min(k, len(unit)) - 1):
        chosen.append(unit[int(nearest.argmin())])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(10):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = _norms(sums)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def best_under(
    members: np.ndarray, within: float, angles: np.ndarray, candidates: np.ndarray, names: np.ndarray, owner: np.ndarray,
    low: np.ndarray, high: np.ndarray, most: int, barred: np.ndarray,
) -> list[np.ndarray]:
    """(request, name, score) of the best `most` candidates of each request, by score and then by smaller name.

    A request r belongs to the member owner[r] and asks for scores from low[r] to high[r]; candidates named barred[r] are
    left out. angles: of the candidates to the centre that all members lie within an angle of.
    """
    norms, lengths = _norms(candidates), _norms(members)
    reach = _bounds(norms, angles, within)
    order = np.argsort(-reach, kind="stable")
    reach, candidates, names = reach[order], candidates[order], names[order]
    found = [np.empty(0, np.int64)] * 3
    least = low.copy()  # what a request still asks for
    at, step, active = 0, 32, np.arange(len(owner))
    while at < len(order):
        active = active[lengths[owner[active]] * reach[at] + 0.5 >= least[active]]  # else the rest cannot reach it
        if not len(active):
            break
        stop = min(len(order), at + step)
        own, which = np.unique(owner[active], return_inverse=True)
        scores = _products(members[own], candidates[at:stop])[which]
        r, c = np.nonzero((scores >= least[active][:, None]) & (scores <= high[active][:, None]) & (names[None, at:stop] != barred[active][:, None]))
        if len(r):
            new = active[r], names[at:stop][c], scores[r, c]
            request, name, score = (np.concatenate(x) for x in zip(found, new, strict=True))
            by = np.lexsort((name, -score, request))
            request, name, score = request[by], name[by], score[by]
            first = np.flatnonzero(np.concatenate(([True], request[1:] != request[:-1])))
            rank = np.arange(len(request)) - np.repeat(first, np.diff(np.append(first, len(request))))
            keep = rank < most
            found = [request[keep], name[keep], score[keep]]
            last = rank == most - 1
            least[request[last]] = np.maximum(low[request[last]], score[last])
        at, step = stop, min(2 * step, 512)
    return found


class _Lists:
    """The anchors' clusters and the walk along their lists."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, width: int):
        self.rows, self.width, spark = rows, width, rows.sparkSession
        self.n_rows, n_anchors = rows.count(), anchors.count()
        by_hash = lambda df, n: [r.q for r in df.orderBy(F.xxhash64("vec_id")).limit(n).select("q").collect()]
        self.centres = centroids(_matrix(by_hash(anchors, SAMPLE_ANCHORS), width), min(CLUSTERS, -(-n_anchors // ANCHORS_EACH)))
        self.parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(self, requests: DataFrame, same_label: bool, most: int) -> DataFrame:
        """(anchor, high, name, score): each block's best of each request (anchor, label, q, low, high)."""
        width, centres = self.width, self.centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                m = _matrix(df.q.tolist(), width)
                norms = _norms(m)
                cluster = (m @ centres.T).argmax(axis=1) if len(m) else np.empty(0, int)
                angle = [float(_angles(m[k : k + 1], norms[k : k + 1], centres[c])[0]) for k, c in enumerate(cluster)]
                yield df.assign(cluster=2 * cluster + (df.low.to_numpy() == NONE), angle=angle, norm=norms)

        schema = "anchor long, label long, q binary, low long, high long, cluster int, angle double, norm double"
        placed = written(requests.select("anchor", "label", "q", "low", "high").mapInPandas(place, schema), "requests")
        about = placed.groupBy("cluster").agg(
            F.ceil(F.count_distinct("anchor") / SLICE).alias("slices"), F.max("angle").alias("within"), F.max("norm").alias("norm"), F.min("low").alias("low"),
        ).collect()  # two rows for each of CLUSTERS at most
        n_slices = max(1, sum(r.slices for r in about))
        n_blocks = max(1, -(-self.n_rows // BLOCK), -(-self.parallel // n_slices))

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                m = _matrix(df.q.tolist(), width)
                norms = _norms(m)
                for r in about:
                    reach = r.norm * _bounds(norms, _angles(m, norms, centres[r.cluster // 2]), r.within) + 0.5
                    own = df[reach >= r.low]
                    for s in range(r.slices):
                        yield own.assign(cluster=np.int32(r.cluster), slice=np.int32(s))

        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
        lists = self.rows.select("vec_id", "label", "q", block).mapInPandas(send, "vec_id long, label long, q binary, block int, cluster int, slice int")
        slices = F.create_map(*(F.lit(x) for r in about for x in (r.cluster, r.slices))) if about else F.create_map(F.lit(0), F.lit(1))
        slice_ = F.pmod(F.xxhash64("anchor"), slices[F.col("cluster")]).cast("int").alias("slice")
        members = placed.select("*", slice_, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        keys = ["cluster", "slice", "block"]

        def run(key: tuple, who: pd.DataFrame, what: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(who) and len(what):
                first = ~who.anchor.duplicated().to_numpy()
                m, v = _matrix(who.q[first].tolist(), width), _matrix(what.q.tolist(), width)
                owner = np.searchsorted(np.sort(who.anchor[first]), who.anchor)
                m = m[np.argsort(who.anchor[first].to_numpy())]
                angles, within = _angles(v, _norms(v), centres[key[0] // 2]), float(who.angle.max())
                low = who.low.to_numpy(np.int64)
                high, anchor = who.high.to_numpy(np.int64), who.anchor.to_numpy(np.int64)
                own, labels, names = who.label.to_numpy(), what.label.to_numpy(), what.vec_id.to_numpy(np.int64)
                for label in np.unique(own):
                    r, c = np.flatnonzero(own == label), np.flatnonzero((labels == label) == same_label)
                    request, name, score = best_under(m, within, angles[c], v[c], names[c], owner[r], low[r], high[r], most, anchor[r])
                    out.append(pd.DataFrame({"anchor": anchor[r][request], "high": high[r][request], "name": name, "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"anchor": [], "high": [], "name": [], "score": []}, dtype="int64")

        return members.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(run, "anchor long, high long, name long, score long")

    def needs(self, anchors: DataFrame, most: int) -> DataFrame:
        """(anchor, label, q, low): the score of the last of `most` rows of the same label in a sample; NONE if it has fewer."""
        width = self.width
        sample = self.rows.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(SAMPLE_ROWS).select("vec_id", "label", "q").toPandas()
        names, labels, v = sample.vec_id.to_numpy(np.int64), sample.label.to_numpy(), _matrix(sample.q.tolist(), width)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                low = [np.empty(0, np.int64)]
                for at in range(0, len(df), 500):
                    part = df.iloc[at : at + 500]
                    scores = _products(_matrix(part.q.tolist(), width), v) if len(v) else np.zeros((len(part), 0), np.int64)
                    other = (part.label.to_numpy()[:, None] != labels[None, :]) | (part.anchor.to_numpy()[:, None] == names[None, :])
                    scores[other] = NONE
                    n = scores.shape[1]
                    low.append(np.partition(scores, n - most, axis=1)[:, n - most] if n >= most else np.full(len(part), NONE))
                yield df.assign(low=np.concatenate(low))

        return anchors.mapInPandas(run, "anchor long, label long, q binary, low long")


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256, rule: Rule = Rule()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first rows of the same label; for each of them the first rows of other labels are
    returned of which the score is within the rule's bounds. A score is the inner product of vectors of whole numbers,
    floor(scale * x); higher scores come first, of equal ones the smaller id. is_anchor is told by the columns of df.

    Rows with a null label, a null vector or a component that is null or not finite take no part; nor do rows with a
    null id, as nothing could name them. Rows that share an id count as one, that of the least label and then of the
    least vector. Shorter vectors are filled up with zeros, an empty one being zero throughout. Components beyond
    2 ** 27 after scaling are held there, so that scores of up to 500 components fit a long. Anchors without positives,
    and positives without negatives in the bounds, give no rows, nor does an empty table. Other columns do no harm.
    """
    picked = df.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        quantised(F.col(vector_col), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = written(picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL"), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.max(F.size("q")).alias("width")).first()
    if size.n != size.ids:
        least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q", "is_anchor")).alias("r"))
        rows = least.select("vec_id", "r.*")
    rows = written(_packed(rows), "packed")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.where("is_anchor").select(F.col("vec_id").alias("anchor"), "label", "q")
    if anchors.isEmpty():
        return df.sparkSession.createDataFrame([], out)
    lists = _Lists(rows, anchors, max(1, size.width))
    first = lambda by, name: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), name))
    asked = lists.needs(anchors, rule.positives).withColumn("high", F.lit(2**63 - 1))
    met = lists.walk(asked, True, rule.positives).withColumn("n", first(["anchor"], "name")).where(F.col("n") <= rule.positives)
    pairs = written(met.select("anchor", F.col("name").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # no score is both below a negative positive's and above a part of it
    caps = pairs.where("positive_score >= 0").select("anchor", F.col("positive_score").alias("high")).distinct()
    caps = caps.withColumn("low", F.expr(f"({rule.low} * CAST(high AS DECIMAL(20, 0)) + 99) DIV 100"))
    below = lists.walk(caps.join(anchors, "anchor"), False, rule.negatives)
    below = below.withColumn("rank", first(["anchor", "high"], "name")).where(F.col("rank") <= rule.negatives)
    named = pairs.join(below.withColumnRenamed("high", "positive_score"), ["anchor", "positive_score"])
    return named.select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("name").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
