"""Near-duplicate documents by MinHash with tensored banding.

Instead of k fresh hashes for each of L tables, two small collections of `side` groups of `rows` hashes are made, and
each pair of a group of the one and a group of the other is a table key: side * side tables of 2 * rows hashes from
2 * side * rows in all, about the square root. At a similarity of 0.8 and the default 9 by 9 tables of 2 + 2 hashes,
a pair shares a key with a probability of (1 - (1 - 0.8 ** 2) ** 9) ** 2 = 0.9998.

Documents with equal sets are one class from the start. In each bucket, classes are tested against the bucket's first.
Where a bucket still holds several components between which a link is likely, these become a family, and all members
of a family are compared on their full sets, in blocks within tasks. So every link is confirmed on the full sets, and
no step makes a row for each pair of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import BitFilter, written
from strataloom.llm.components import connected
from strataloom.llm.shingles import C1, C3, digest, mix, shingle_sets, similar

SIDE, ROWS = 9, 2
#: Standard deviations below the expected agreement of signatures at which a pair is left out: 1 of 50,000 links.
SIGMAS = 4.2
#: Classes of a bucket that are compared in one block by signature.
BLOCK = 1500
#: Classes of a family that make a block, compared on full sets, and bytes of their texts.
FAMILY_LEAST, FAMILY_MOST, FAMILY_BYTES = 200, 2000, 8_000_000
#: Shingles of a family that are counted in one matrix product.
COLUMNS = 4096


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, side: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): the size of each set, 128 bits that tell sets apart, and the minhashes."""
    n = 2 * side * rows
    seeds = (np.arange(1, n + 1, dtype=np.uint64) * C3)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                sets = shingle_sets(texts, width)
                marks = [digest(s) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                sig = np.zeros((len(sets), n), np.uint32)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[k] for k in full])
                    begin = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for j in range(n):
                        sig[full, j] = (np.minimum.reduceat(mix(flat ^ seeds[j]), begin) >> np.uint64(16)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def table_keys(classes: DataFrame, side: int, rows: int) -> DataFrame:
    """(key, id): side * side rows for each class, one for each pair of groups from the two collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, 2, side, rows).astype(np.uint64)
                group = np.zeros(sig.shape[:3], np.uint64)
                for k in range(rows):
                    group = mix(group * C1 + sig[:, :, :, k] + C3)
                table = (np.arange(side * side, dtype=np.uint64).reshape(1, side, side) + np.uint64(1)) * C3
                keys = mix(mix(group[:, 0, :, None] * C1 + group[:, 1, None, :]) ^ table)
                ids = np.repeat(part.column(0).to_numpy(), side * side)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _least_agreement(percent: int, n: int, sigmas: float | None) -> int:
    if sigmas is None:
        return 0
    p = percent / 100
    return int(np.floor(n * p - sigmas * np.sqrt(n * p * (1 - p))))


def _promising(pairs: DataFrame, classes: DataFrame, percent: int, n: int, sigmas: float | None) -> DataFrame:
    """(a, b, agree) of the pairs whose sizes allow the similarity and whose signatures make it likely enough."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(z), np.uint32).reshape(-1, n) for z in (x, y))
        return pd.Series((u == v).sum(axis=1).astype(np.int32))

    return both.withColumn("agree", agree("sig_a", "sig_b")).where(F.col("agree") >= _least_agreement(percent, n, sigmas)).select("a", "b", "agree")


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")


def _texts(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids, thinned by a filter of fixed size before anything is shuffled."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    return BitFilter.of(ids, "id", ids.count()).where(rows, "id").join(ids, "id", "left_semi")


def _confirmed(df: DataFrame, id_col: str, text_col: str, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "id")
    texts = written(_texts(df, id_col, text_col, ids), "candidate-texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                u, v = (shingle_sets([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(k)], width) for k in (2, 3))
                ok = pa.array([similar(x, y, percent) for x, y in zip(u, v, strict=True)], pa.bool_())
                yield part.select(["a", "b"]).filter(ok)

    return both.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Deals each key's rows out to blocks of about `size` and repeats them for each pair (p, q) of blocks."""
    per_key = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("nb"))
    dealt = rows.join(per_key, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("other", "nb")
    # so many partitions, however few bytes they hold: the work on a pair of blocks is large against its bytes
    return pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "p", "q")


def _likely_across(unresolved: DataFrame, percent: int, n: int, sigmas: float | None) -> DataFrame:
    """(a, b): edges that join components which share a bucket and hold classes there that are likely to be linked.

    What is joined through others gets no edge of its own: families are all that is asked for.
    """
    least = _least_agreement(percent, n, sigmas)

    def run(group: pa.Table) -> pa.Table:
        comp, size = (group.column(c).to_numpy() for c in ("comp", "n"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(-1, n)
        root = {int(c): int(c) for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for k in range(1, len(comp)):
            ok = (comp[:k] != comp[k]) & (100 * np.minimum(size[:k], size[k]) >= percent * np.maximum(size[:k], size[k]))
            at = np.flatnonzero(ok)
            if len(at):
                at = at[(sig[at] == sig[k]).sum(axis=1) >= least]
                for c in np.unique(comp[at]).tolist():
                    x, y = top(c), top(int(comp[k]))
                    root[max(x, y)] = min(x, y)
        found = [(top(c), c) for c in root if top(c) != c]  # a row for each component at most, however many pairs
        a, b = (pa.array([x[c] for x in found], pa.int64()) for c in (0, 1))
        return pa.Table.from_arrays([a, b], ["a", "b"])

    return _blocks(unresolved, "key", BLOCK).groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _family_blocks(members: DataFrame) -> DataFrame:
    """(p, q, right) beside members (family, comp, id, text): each member once for each pair of blocks it is compared in.

    A block holds a sixteenth of its family, within FAMILY_LEAST and FAMILY_MOST members and FAMILY_BYTES of text, so a
    member is sent some sixteen times, or in families of very many members once for each FAMILY_MOST of them. Components
    that fill a block have blocks of their own, which never meet each other: their members are joined already. right
    tells the members of block q where p and q differ.
    """
    per_comp = members.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    size = F.least(F.lit(FAMILY_MOST), F.greatest(F.lit(FAMILY_LEAST), F.ceil(F.sum("n") / 16)))
    per_comp = per_comp.join(per_comp.groupBy("family").agg(size.alias("size")), "family")
    large = F.col("n") >= F.col("size")
    per_comp = per_comp.withColumn("g", F.struct(large.alias("large"), F.when(large, F.col("comp")).otherwise(0).alias("comp")))
    count = F.greatest(F.ceil(F.sum("n") / F.first("size")), F.ceil(F.sum("bytes") / FAMILY_BYTES), F.lit(1)).cast("int")
    groups = per_comp.groupBy("family", "g").agg(count.alias("nb"))
    numbered = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct("g", k.alias("k")))
    blocks = groups.groupBy("family").agg(F.flatten(F.collect_list(numbered)).alias("blocks"))
    dealt = members.join(per_comp.join(groups, ["family", "g"]).select("family", "comp", "g", "nb"), ["family", "comp"]).join(blocks, "family")
    dealt = dealt.withColumn("own", F.struct("g", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("k")))
    dealt = dealt.withColumn("other", F.explode(F.filter("blocks", lambda x: ~x["g"]["large"] | (x["g"] != F.col("g")))))
    pairs = dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).withColumn("right", (F.col("p") != F.col("q")) & (F.col("own") == F.col("q")))
    pairs = pairs.select("family", F.struct("p", "q").alias("pq"), "right", "comp", "id", "text")
    # so many partitions, however few bytes they hold: the work on a pair of blocks is large against its bytes
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family", "pq")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set on the left with each on the right, by products of 0/1 matrices."""
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets), owner))
    shared = np.intersect1d(sides[0][0], sides[1][0])  # others are in no intersection
    found = []
    for flat, owner in sides:
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        keep = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[keep], kind="stable")
        found.append((at[keep][order], owner[keep][order]))
    both = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(shared), COLUMNS):
        parts = []
        for (column, owner), sets in zip(found, (left, right), strict=True):
            a, b = np.searchsorted(column, (begin, begin + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, len(shared) - begin)), np.float32)
            part[owner[a:b], column[a:b] - begin] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both


def _joining(linked: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of links that join all components u[i], v[j] which the links join: fewer than there are components."""
    names, number = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = number[: len(u)], number[len(u) :]
    label, out = np.arange(len(names)), []
    for i in np.flatnonzero(linked.any(axis=1)):
        at = np.flatnonzero(linked[i])
        reached, first = np.unique(label[v[at]], return_index=True)
        new = reached != label[u[i]]
        if new.any():
            out += [(int(i), int(at[k])) for k in first[new]]
            label[np.isin(label, reached[new])] = label[u[i]]
    return out


def _links_within(members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join all components of a family that are linked, all pairs across being compared on full sets.

    Members (family, comp, id, text) are compared block by block within tasks. A pair costs no row: fewer rows than a
    pair of blocks has components leave a task.
    """

    def run(group: pa.Table) -> pa.Table:
        comp, ids, right = (group.column(c).to_numpy() for c in ("comp", "id", "right"))
        sets = shingle_sets([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in group.column("text")], width)
        sizes = np.array([len(x) for x in sets], np.int64)
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(j) or not len(i):  # a block with itself, or the other one is empty
            pq = group.column("pq")[0].as_py()
            i = j = np.arange(len(sets)) if pq["p"] == pq["q"] else i[:0]
        found = []
        if len(i):
            both = _intersections([sets[k] for k in i], [sets[k] for k in j])
            linked = (100 * both >= percent * (sizes[i][:, None] + sizes[j][None, :] - both)) & (comp[i][:, None] != comp[j][None, :])
            found = [(int(ids[i[x]]), int(ids[j[y]])) for x, y in _joining(linked, comp[i], comp[j])]
        a, b = (pa.array([x[c] for x in found], pa.int64()) for c in (0, 1))
        return pa.Table.from_arrays([a, b], ["a", "b"])

    return _family_blocks(members).groupBy("family", "pq").applyInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, side: int = SIDE, rows: int = ROWS,
    sigmas: float | None = SIGMAS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: documents linked, in one step or more, share a component.

    A document's set holds the distinct `width`-word shingles of its text, A-Z lower-cased, words being the runs of
    `[^\\x20\\x09-\\x0D]+`; with fewer words the whole sequence is its one shingle; null and blank texts have an empty
    set and no links. Documents are linked if 100 * intersection >= percent * union. component_id is the smallest id
    reached, kept tells whether that is the row's own. Repeated rows share their result. Rows of one id but different
    texts go each by its own text; a link to one of those texts may then count for the id's others.
    Rows with a null id have no links: their component_id is null and they are kept. An empty table gives no rows. Very
    long texts are one set like others; other columns, whatever their names, are not read.

    Candidates whose signatures agree less than is to be expected, by so many standard deviations as `sigmas` says, are
    not compared; with None every candidate is.
    """
    n_sig = 2 * side * rows
    with_id = df.where(F.col(id_col).isNotNull())
    shingled = written(signatures(with_id, id_col, text_col, width, side, rows), "signatures")
    full = shingled.where("n_shingles > 0")
    firsts = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sig")).alias("f"))
    classes = written(firsts.select("d1", "d2", F.col("f.doc_id").alias("id"), "f.n", "f.sig"), "classes")
    keys = table_keys(classes, side, rows)
    heads = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").drop("z")
    buckets = written(keys.join(heads, "key").withColumnRenamed("id", "b"), "buckets")  # only those of two or more
    stars = buckets.where("a <> b").select("a", "b").distinct()
    nearest = written(_best(_promising(stars, classes, percent, n_sig, sigmas)), "nearest")
    links = written(_confirmed(df, id_col, text_col, nearest, width, percent), "links")
    labels = connected(links)
    named = buckets.select("key", F.col("b").alias("id")).join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = named.join(several, "key").join(classes.select("id", "n", "sig"), "id")
    families = connected(_likely_across(rest, percent, n_sig, sigmas)).select(F.col("id").alias("comp"), F.col("comp").alias("family"))
    members = written(classes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")).join(families, "comp"), "members")
    if not members.isEmpty():
        texts = _texts(df, id_col, text_col, members.select("id"))
        labels = connected(links.unionByName(written(_links_within(members.join(texts, "id"), width, percent), "links")))
    placed = shingled.join(classes.where("n > 0").select("d1", "d2", F.col("id").alias("first")), ["d1", "d2"], "left")
    placed = placed.withColumn("first", F.when(F.col("n_shingles") > 0, F.col("first")))
    named = placed.join(labels.withColumnsRenamed({"id": "first"}), "first", "left")
    component = F.coalesce("comp", "first", "doc_id")
    out = named.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    null_ids = signatures(df.where(F.col(id_col).isNull()), id_col, text_col, width, side, rows)
    return out.unionByName(null_ids.select(F.col("doc_id").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
