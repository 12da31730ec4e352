"""Hard-negative mining by dual-tree search.

Vectors become integers, so that scores are exact. Equal candidates are one class, and the
classes are dealt to tasks in the order of a tree that is fitted on a bounded sample: near
vectors stand together. A task builds ball trees over its candidates, batch by batch, and
over the queries. The inner products of a node of queries with a node of candidates lie in
an interval around that of their centres; where it misses what every query of the node
still asks for, both nodes are pruned at once. Pairs of leaves that remain are scored
exactly, the most promising leaves of each group of queries first, since they raise what the
others have to reach. The search runs twice: for positives the queries are the anchors, for
negatives they are the bands of scores around the positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import cut, stored, table

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
SCALE = 256
SAMPLE = 8192  # vectors that the tree of the order is fitted on, at most
DEPTH = 7
BATCH = 8192  # candidates in one tree
LEAF, GROUP = 64, 32  # candidates and queries in a leaf
BLOCK = 1 << 22  # components of queries that are broadcast at once (32 MB)
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """A balanced ball tree: `order` of the rows, and for each level the edges of its nodes,
    their centres and radii."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        x, n = x.astype(np.float64), len(x)
        height = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        self.order, self.levels = np.arange(n), []
        for h in range(height + 1):
            edges = (np.arange(2**h + 1) * n) >> h
            for s, e in zip(edges[:-1], edges[1:], strict=True) if h < height else ():
                self.order[s:e] = self.order[s:e][halved(x[self.order[s:e]])]
        y = x[self.order]
        for h in range(height + 1):
            edges = (np.arange(2**h + 1) * n) >> h
            size = np.maximum(1, np.diff(edges))
            at = np.repeat(np.arange(2**h), np.diff(edges))
            centre = np.stack([np.bincount(at, c, 2**h) for c in y.T], 1) / size[:, None] if y.shape[1] else np.zeros((2**h, 0))
            far = np.zeros(2**h)
            np.maximum.at(far, at, np.sqrt(((y - centre[at]) ** 2).sum(1)))
            self.levels.append((edges, centre, far))


def halved(x: np.ndarray) -> np.ndarray:
    """An order of the rows whose two halves lie apart: along the line to the farthest row."""
    if len(x) < 2:
        return np.arange(len(x))
    a = ((x - x.mean(0)) ** 2).sum(1).argmax()
    b = ((x - x[a]) ** 2).sum(1).argmax()
    return np.argpartition(x @ (x[b] - x[a]), len(x) >> 1)


def interval(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all pairs of nodes of two levels."""
    (_, ca, ra), (_, cb, rb) = a, b
    na, nb = np.sqrt((ca * ca).sum(1)), np.sqrt((cb * cb).sum(1))
    mid = ca @ cb.T
    slack = na[:, None] * rb + ra[:, None] * nb + ra[:, None] * rb
    slack += 1e-9 * (na[:, None] + ra[:, None]) * (nb + rb) + 1e-9  # rounding
    return mid - slack, mid + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers. Scores beyond 64 bits raise an error."""
    d = max(1, a.shape[1])
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * d < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Asked:
    """Queries of one length (and label), with the k best found so far: score, id, and
    whether the candidate is the query's own class."""

    def __init__(self, qid: np.ndarray, x: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.tree = Tree(x, GROUP)
        o = self.tree.order
        self.qid, self.x, self.label, self.low, self.high, self.k = qid[o], x[o], label[o], low[o], high[o], k
        self.score, self.id, self.own = np.full((len(o), k), LEAST), np.full((len(o), k), MOST), np.zeros((len(o), k), bool)

    def need(self) -> np.ndarray:
        """The least score that can still enter each query's list."""
        return np.maximum(self.low, self.score[:, -1])

    def visit(self, x: np.ndarray, label: np.ndarray, ids: list[np.ndarray], same: bool) -> None:
        """Search one batch of candidates. With `same` all have the queries' label; otherwise
        candidates of the query's label do not count."""
        tree = Tree(x, LEAF)
        x, label, ids = x[tree.order], label[tree.order], [ids[i] for i in tree.order]
        alive = np.ones((1, 1), bool)
        mine, theirs = self.tree.levels, tree.levels
        need, high = self.need().astype(np.float64), self.high.astype(np.float64)
        for h in range(max(len(mine), len(theirs))):
            a, b = mine[min(h, len(mine) - 1)], theirs[min(h, len(theirs) - 1)]
            if h:
                alive = np.repeat(alive, 2, 0) if h < len(mine) else alive
                alive = np.repeat(alive, 2, 1) if h < len(theirs) else alive
            least, most = interval(a, b)
            begin = a[0][:-1]
            alive &= (most >= np.minimum.reduceat(need, begin)[:, None]) & (least <= np.maximum.reduceat(high, begin)[:, None])
        edges = theirs[-1][0]
        for g in np.flatnonzero(alive.any(1)):
            rows = np.arange(mine[-1][0][g], mine[-1][0][g + 1])
            leaves = np.flatnonzero(alive[g])
            leaves = leaves[np.argsort(-most[g][leaves], kind="stable")]
            done, width = 0, 1
            while done < len(leaves):
                some = leaves[done : done + width]
                some = some[most[g][some] >= self.need()[rows].min()]
                if not len(some):  # the bounds of all others are lower
                    break
                self.score_leaves(rows, edges, some, x, label, ids, same)
                done, width = done + width, 2 * width

    def score_leaves(self, rows, edges, leaves, x, label, ids, same) -> None:
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in leaves])
        score = products(self.x[rows], x[at])
        fine = (score >= self.need()[rows][:, None]) & (score <= self.high[rows][:, None])
        if not same:
            fine &= self.label[rows][:, None] != label[at]
        score = np.where(fine, score, LEAST)
        if len(at) > self.k:  # a class has one id at least
            fine &= score >= np.partition(score, len(at) - self.k, 1)[:, -self.k][:, None]
        row, col = np.nonzero(fine)
        if not len(row):
            return
        held = [ids[i] for i in at[col]]
        n = [len(i) for i in held]
        own = (self.x[rows[row]] == x[at[col]]).all(1) & (self.label[rows[row]] == label[at[col]])
        owner = np.concatenate([np.repeat(rows[row], n), np.repeat(rows, self.k)])
        score = np.concatenate([np.repeat(score[row, col], n), self.score[rows].ravel()])
        name = np.concatenate([*held, self.id[rows].ravel()])
        own = np.concatenate([np.repeat(own, n), self.own[rows].ravel()])
        order = np.lexsort((name, -score, owner))  # -LEAST is LEAST: places that are free
        order = order[np.argsort(score[order] == LEAST, kind="stable")]
        order = order[np.argsort(owner[order], kind="stable")]
        begin = np.searchsorted(owner[order], rows)
        top = order[(begin[:, None] + np.arange(self.k)).ravel()]
        for mine, new in ((self.score, score), (self.id, name), (self.own, own)):
            mine[rows] = new[top].reshape(len(rows), self.k)

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.qid[row]), pa.array(self.id[row, place]), pa.array(self.score[row, place]), pa.array(self.own[row, place])], ["qid", "id", "score", "own"])


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), -1) if vectors and len(vectors[0]) else np.zeros((len(vectors), 0), np.int64)


def _by(keys: list) -> dict:
    out: dict = {}
    for i, k in enumerate(keys):
        out.setdefault(k, []).append(i)
    return out


def _names(labels: list) -> np.ndarray:
    out = np.empty(len(labels), object)
    out[:] = labels
    return out


def _blocks(queries: DataFrame, bound: int) -> Iterator[list[tuple]]:
    """The stored queries in blocks of about `bound` components, one at a time."""
    total = queries.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // bound))
    for b in range(count):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == b).select("qid", "v", "label", "low", "high").collect()
        if rows:
            yield [tuple(r) for r in rows]


def dual_tree(queries: DataFrame, classes: DataFrame, k: int, same: bool, bound: int = BLOCK) -> DataFrame:
    """(qid, id, score, own): the k best candidates of each query.

    queries: qid, v, label, low, high; classes: v, label, ids (sorted). Scores lie in low..high;
    candidates have the query's label (same) or another one; ties go to the smaller id. Each
    task keeps its k best of each query; the k best of all are chosen by query.
    """
    spark, parts = classes.sparkSession, []
    for block in _blocks(queries, bound):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            q = sent.value
            key = lambda v, label: (len(v), label) if same else len(v)
            asked = {}
            for name, at in _by([key(r[1], r[2]) for r in q]).items():
                part = [q[i] for i in at]
                asked[name] = Asked(*(np.array([r[0] for r in part]), _matrix([r[1] for r in part]), _names([r[2] for r in part])), *(np.array([r[i] for r in part], np.int64) for i in (3, 4)), k)
            for batch in batches:
                for begin in range(0, batch.num_rows, BATCH):
                    v, label, ids = (c.to_pylist() for c in batch.slice(begin, BATCH).columns)
                    for name, at in _by(list(map(key, v, label))).items():
                        if name in asked:
                            asked[name].visit(_matrix([v[i] for i in at]), _names([label[i] for i in at]), [np.array(ids[i], np.int64) for i in at], same)
            for a in asked.values():
                yield a.found()

        parts.append(cut(classes.select("v", "label", "ids").mapInArrow(run, "qid long, id long, score long, own boolean"), "found"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "qid long, id long, score long, own boolean, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id", "own")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def arranged(classes: DataFrame) -> DataFrame:
    """classes in an order in which near vectors stand together: by the leaf of a tree of
    halving planes that is fitted on at most SAMPLE vectors. Equal leaves are split freely."""
    rows = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    planes: dict[int, list] = {}
    for d, at in _by([len(r.v) for r in rows]).items():
        x = _matrix([rows[i].v for i in at]).astype(np.float64)
        groups, planes[d] = [np.arange(len(x))], []
        for _ in range(DEPTH):
            level, after = [], []
            for g in groups:
                y = x[g]
                if len(g) > 1:
                    a = ((y - y.mean(0)) ** 2).sum(1).argmax()
                    line = y[((y - y[a]) ** 2).sum(1).argmax()] - y[a]
                else:
                    line = np.zeros(d)
                middle = float(np.median(y @ line)) if len(g) else 0.0
                level.append((line, middle))
                after += [g[y @ line <= middle], g[y @ line > middle]]
            planes[d].append((np.array([p for p, _ in level]), np.array([m for _, m in level])))
            groups = after

    def run(batches):
        for batch in batches:
            v = batch.column(0).to_pylist()
            leaf = np.zeros(len(v), np.int64)
            for d, at in _by([len(x) for x in v]).items():
                x, node = _matrix([v[i] for i in at]).astype(np.float64), np.zeros(len(at), np.int64)
                for line, middle in planes.get(d, ()):
                    node = 2 * node + ((x * line[node]).sum(1) > middle[node])
                leaf[at] = node
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["v", "label", "ids", "leaf"])

    schema = f"v array<long>, label {classes.schema['label'].dataType.simpleString()}, ids array<long>, leaf long"
    dealt = classes.select("v", "label", "ids").mapInArrow(run, schema)
    return dealt.repartitionByRange(F.size("v"), "leaf", F.xxhash64("v")).sortWithinPartitions(F.size("v"), "leaf").drop("leaf")


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or
    not finite."""
    wide = lambda x: x.cast("double") * scale
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    big = F.exists(vector, lambda x: F.abs(wide(x)) >= 2.0**62)
    whole = F.transform(vector, lambda x: F.floor(wide(x)).cast("long"))
    return F.when(F.coalesce(fine, F.lit(False)), F.when(big, F.raise_error(F.lit("a component is too large for a 64-bit integer")).cast("array<long>")).otherwise(whole))


@stored
def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, bound: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows are anchors where `anchor` holds. Components become floor(scale * x); a score is the
    integer inner product. An anchor's positives are its first `positives` other rows of its
    label; for each, the first `negatives` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score are returned, by score, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part;
    only vectors of the anchor's length have a score with it. Repeated rows of one id, vector
    and label are one row; rows of one id that differ are rows of their own. An anchor without
    positives or negatives, and an empty table, have no result. Scores or components that do
    not fit 64 bits raise an error. Other columns are ignored.

    Scale: a class of equal vectors and labels counts once, with its few smallest ids, as
    candidate and as anchor. Candidates are shuffled into their order once; they are read
    once for each block of queries (BLOCK components, which the driver holds one at a time).
    A task holds one batch of candidates, one block of queries and their k best. The work is
    queries x candidates less what the intervals prune: where vectors hardly cluster, little.
    """
    clean = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), F.col(label).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    clean = clean.where("id is not null and v is not null and label is not null").groupBy("id", "v", "label").agg(F.max("anchor").alias("anchor"))
    clean = cut(clean, "clean")
    k = max(positives + 1, negatives)
    w = Window.partitionBy("v", "label").orderBy("id")
    few = clean.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    classes = few.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(arranged(cut(classes, "classes")), "arranged")

    anchors = clean.where("anchor").select("id", "v", "label")
    every = lambda x: F.lit(x).cast("long")
    asked = anchors.select("v", "label").distinct().select(F.monotonically_increasing_id().alias("qid"), "v", "label", every(int(LEAST) + 1).alias("low"), every(int(MOST)).alias("high"))
    asked = cut(asked, "anchors")
    near = dual_tree(asked, classes, positives + 1, True, bound)
    named = anchors.join(asked.select("qid", "v", "label"), ["v", "label"]).select(F.col("id").alias("anchor_id"), "qid")
    others = named.join(near, "qid").where(~(F.col("own") & (F.col("id") == F.col("anchor_id"))))
    place = F.row_number().over(Window.partitionBy("anchor_id", "qid").orderBy("rank"))
    chosen = others.withColumn("place", place).where(F.col("place") <= positives)
    chosen = cut(chosen.select("anchor_id", "qid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 100 * n in low * p .. high * p, in whole numbers that don't overflow a decimal.
    wide = F.col("positive_score").cast("decimal(38,0)")
    hundredth = lambda c: F.floor(c / 100).cast("long")
    band = chosen.select("qid", "positive_score").distinct().select("qid", "positive_score", (-hundredth(-wide * low)).alias("low"), hundredth(wide * high).alias("high")).where("low <= high")
    bands = cut(band.join(asked.select("qid", "v", "label"), "qid").select(F.monotonically_increasing_id().alias("band"), "qid", "positive_score", "v", "label", "low", "high"), "bands")
    hard = dual_tree(bands.select(F.col("band").alias("qid"), "v", "label", "low", "high"), classes, negatives, False, bound)
    hard = hard.select(F.col("qid").alias("band"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(bands.select("band", "qid", "positive_score"), ["qid", "positive_score"]).join(hard, "band")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100, against all rows; where vec_id is
    divisible by 7 the label first becomes (label + 1) % 10. See hard_negatives() for nulls."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
