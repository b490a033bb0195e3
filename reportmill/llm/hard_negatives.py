"""Hard negatives by branch and bound over ball trees, one tree for each part of the vectors.

Rows are dealt to parts of bounded size by the hash of their id.  A part's tree
has one subtree for each label; a node is a ball around the mean of its rows,
which bounds their inner products with an anchor from above and from below.  A
node is left out where the bound above lies strictly beneath the least score
still wanted (the window's lower end, or the current k-th) or the bound below
lies over the window's upper end; what is left is verified by exact products.

Parts are searched in rounds that grow by FAN, each with the k-th scores of the
rounds before, so what the parts send stays in proportion to the anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .topk import _products
from .workspace import bound_batches, materialize

#: Rows of a part, rows of a leaf, parts of the first round and growth of the later ones, anchors that one task meets with a part.
PART, LEAF, FAN, GROUP = 4096, 64, 16, 1 << 15
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and a vector of finite components, these as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.when(F.abs(x * F.lit(float(scale))) < F.lit(2.0**63), F.floor(x * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), fine.alias("fine"))
    return rows.where("vec_id is not null and label is not null and v is not null and fine").select("vec_id", "label", F.transform("v", fits).alias("v"))


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes: rows [start, end), children (-1: a leaf), label, ball."""

    ids: np.ndarray
    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    roots: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halve each label's rows along the line between two far rows until a ball holds ``leaf`` rows or a single point."""
        order = np.lexsort((ids, labels))
        points = x.astype(np.float64)
        nodes: list[list] = []
        roots = []
        cuts = np.flatnonzero(np.r_[True, np.diff(labels[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            roots.append(len(nodes))
            open_nodes = [(int(a), int(b), -1, 0)]
            while open_nodes:
                s, e, parent, side = open_nodes.pop()
                own = points[order[s:e]]
                center = own.mean(axis=0)
                away = np.sqrt(((own - center) ** 2).sum(axis=1))
                at = len(nodes)
                nodes.append([s, e, -1, -1, int(labels[order[s]]), center, float(away.max())])
                if parent >= 0:
                    nodes[parent][2 + side] = at
                if e - s > leaf and away.max() > 0:
                    one = own[int(away.argmax())]
                    two = own[int(((own - one) ** 2).sum(axis=1).argmax())]
                    half = (e - s) // 2
                    order[s:e] = order[s:e][np.argpartition(own @ (two - one), half)]
                    open_nodes += [(s, s + half, at, 0), (s + half, e, at, 1)]
        column = lambda i, kind: np.array([n[i] for n in nodes], kind)
        return cls(ids[order], x[order], *[column(i, np.int64) for i in range(5)], np.array([n[5] for n in nodes]).reshape(len(nodes), x.shape[1]), column(6, np.float64), np.array(roots, np.int64))

    def packed(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.__dataclass_fields__]

    @classmethod
    def unpacked(cls, parts: list[bytes], width: int) -> Tree:
        kinds = {"center": np.float64, "radius": np.float64}
        arrays = {f: np.frombuffer(p, kinds.get(f, np.int64)) for f, p in zip(cls.__dataclass_fields__, parts, strict=True)}
        return cls(**arrays | {f: arrays[f].reshape(-1, width) for f in ("x", "center")})


@dataclass
class Asked:
    """Anchors, and their windows [low, high] with the k best rows so far (score LEAST: none)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.scores = np.full((len(self.of), self.k), LEAST, np.int64)
        self.found = np.full((len(self.of), self.k), MOST, np.int64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.visited = 0

    def search(self, tree: Tree, same: bool) -> None:
        """Meet every row of the tree of the anchor's own label (``same``) or of the other ones."""
        own, wide = self.x.astype(np.float64), tree.center.shape[1]
        if wide > own.shape[1]:
            own = np.pad(own, ((0, 0), (0, wide - own.shape[1])))
        far = np.sqrt((tree.center**2).sum(axis=1)) + tree.radius
        bounds = own[:, :wide] @ tree.center.T
        todo = [(int(r), np.flatnonzero((self.labels[self.of] == tree.label[r]) == same)) for r in tree.roots]
        todo.sort(key=lambda t: bounds[:, t[0]].sum())
        while todo:
            node, windows = todo.pop()
            anchor = self.of[windows]
            spread, slack = self.norm[anchor] * tree.radius[node], 1 + 1e-9 * self.norm[anchor] * far[node]
            mid = bounds[anchor, node]
            live = (mid + spread + slack >= self.low[windows]) & (mid - spread - slack <= self.high[windows])
            windows = windows[live]
            if not len(windows):
                continue
            a, b = int(tree.left[node]), int(tree.right[node])
            if a < 0:
                self._meet(tree, node, windows)
            else:  # the ball with the greater products is opened first
                first, last = (a, b) if bounds[self.of[windows], a].sum() >= bounds[self.of[windows], b].sum() else (b, a)
                todo += [(last, windows), (first, windows)]

    def _meet(self, tree: Tree, node: int, windows: np.ndarray) -> None:
        self.visited += 1
        s, e = int(tree.start[node]), int(tree.end[node])
        anchors, place = np.unique(self.of[windows], return_inverse=True)
        q, p = self.x[anchors], tree.x[s:e]
        wide = max(q.shape[1], p.shape[1])
        q, p = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, p))
        scores = _products(q, p)
        if scores.dtype == object:
            if any(not LEAST <= v <= MOST for row in scores for v in row):
                raise OverflowError("an inner product is beyond a long")
            scores = scores.astype(np.int64)
        scores = scores[place]
        fits = (scores >= self.low[windows][:, None]) & (scores <= self.high[windows][:, None]) & (tree.ids[s:e][None, :] != self.ids[self.of[windows]][:, None])
        w, at = np.nonzero(fits)
        if not len(w):
            return
        changed = np.unique(w)
        mine = windows[changed]
        rows = np.concatenate([windows[w], np.repeat(mine, self.k)])
        score = np.concatenate([scores[w, at], self.scores[mine].ravel()])
        ids = np.concatenate([tree.ids[s:e][at], self.found[mine].ravel()])
        order = np.lexsort((ids, ~score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, np.diff(rows) != 0])
        take = first[:, None] + np.arange(self.k)
        self.scores[mine], self.found[mine] = score[take], ids[take]
        kth = self.scores[mine, -1]
        self.low[mine] = np.maximum(self.low[mine], kth)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter lists ending in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


TREE = [f"t_{f}" for f in Tree.__dataclass_fields__]


def _build(key: tuple, table: pa.Table) -> pa.Table:
    """A part's rows to its tree; of rows with one id that of the smallest label and vector stays."""
    table = table.combine_chunks()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    x = _matrix(table.column("v").combine_chunks())
    order = np.lexsort((*x.T[::-1], labels, ids))
    order = order[np.r_[True, np.diff(ids[order]) != 0]]
    tree = Tree.build(ids[order], labels[order], x[order])
    return pa.table({"part": [key[0].as_py()], "width": pa.array([x.shape[1]], pa.int32())} | {f: pa.array([p], pa.binary()) for f, p in zip(TREE, tree.packed(), strict=True)})


def _search(k: int, same: bool):
    """Rows sorted by part and group, a tree before its anchors, to the anchors' best rows in that tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, None
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            at = 0
            while at < len(kinds):
                if kinds[at] == 0:
                    row = batch.slice(at, 1)
                    held = tuple(row.column(c)[0].as_py() for c in ("part", "grp"))
                    tree = Tree.unpacked([row.column(f)[0].as_py() for f in TREE], row.column("width")[0].as_py())
                    at += 1
                    continue
                to = next((i for i in range(at, len(kinds)) if kinds[i] == 0), len(kinds))
                rows = batch.slice(at, to - at)
                at = to
                if held != tuple(rows.column(c)[0].as_py() for c in ("part", "grp")):
                    continue  # a part without rows has no tree
                windows = rows.column("windows")
                flat = windows.flatten()
                number, low, high = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("no", "low", "high"))
                asked = Asked(
                    rows.column("anchor_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v")),
                    np.repeat(np.arange(len(rows)), windows.value_lengths().to_numpy(zero_copy_only=False)), low.copy(), high.copy(), k,
                )
                asked.search(tree, same)
                w, place = np.nonzero(asked.found != MOST)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (asked.ids[asked.of[w]], number[w], asked.found[w, place], asked.scores[w, place])], names=["anchor_id", "no", "vec_id", "score"])

    return run


def search(index: DataFrame, parts: int, asked: DataFrame, n_asked: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, no, rank, vec_id, score): the first k rows of each window by score, ties to the smaller id.

    ``asked`` has (anchor_id, label, v, windows), windows an array of (no, low,
    high).  Each tree meets the anchors in groups of about GROUP.
    """
    spark = index.sparkSession
    groups = -(-n_asked // GROUP)
    schema = "anchor_id long, no int, vec_id long, score long"
    order = Window.partitionBy("anchor_id", "no").orderBy(F.col("score").desc(), "vec_id")
    best, at, to = None, 0, FAN
    while at < parts and groups:
        to = min(to, parts)
        now = asked
        if best is not None:  # from here on nothing beneath the k-th is wanted
            kth = best.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("kth"))
            risen = F.transform("windows", lambda w: F.struct(w["no"].alias("no"), F.greatest(w["low"], F.coalesce(F.col("kth")[w["no"]], w["low"])).alias("low"), w["high"].alias("high")))
            now = asked.join(kth, "anchor_id", "left").withColumn("windows", F.when(F.col("kth").isNull(), F.col("windows")).otherwise(risen)).drop("kth")
        each = F.explode(F.sequence(F.lit(at).cast("long"), F.lit(to - 1).cast("long")))
        sent = now.select(each.alias("part"), F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("kind"), "anchor_id", "label", "v", "windows")
        trees = index.where(F.col("part").between(at, to - 1)).withColumns({"kind": F.lit(0), "grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
        rows = trees.unionByName(sent, allowMissingColumns=True)
        met = rows.repartition(max(1, min((to - at) * groups, 20_000)), "part", "grp").sortWithinPartitions("part", "grp", "kind").mapInArrow(_search(k, same), schema)
        met = met if best is None else met.union(best.drop("rank"))
        best = materialize(met.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k), "best")
        at, to = to, to * FAN
    return best if best is not None else spark.createDataFrame([], "anchor_id long, no int, vec_id long, score long, rank int")


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), part: int = PART,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of its label by
    integer inner product of the components floor(scale * x); a positive's
    negatives the first ``negatives`` rows of other labels whose score lies
    within ``window`` hundredths of the positive's.  Ids and labels are whole numbers.

    Defined cases: rows with a null id or label, a null vector or a null or
    non-finite component take no part; of rows with one id that of the smallest
    label, then vector, counts; shorter vectors count as ending in zeros; a
    positive of negative score has no negatives; ties go to the smaller id; a
    component or product beyond a long is an error; an empty table, one label or
    no anchor give an empty result; other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    label = F.col("label") if label is None else label
    rows = whole_vectors(vectors, id_col, vector_col, label, scale)
    marked = whole_vectors(vectors.where(is_anchor), id_col, vector_col, label, scale).select("vec_id")
    n = rows.count()
    parts = max(1, -(-n // part))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long"))
    index = dealt.groupBy("part").applyInArrow(_build, "part long, width int, " + ", ".join(f"{f} binary" for f in TREE))
    index = materialize(index, "trees")
    once = rows.join(marked.distinct(), "vec_id", "left_semi").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("r"))
    anchors = materialize(once.select("anchor_id", "r.label", "r.v"), "anchors")
    n_anchors = anchors.count()
    whole = F.array(F.struct(F.lit(0).alias("no"), F.lit(LEAST + 1).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")))
    near = search(index, parts, anchors.withColumn("windows", whole), n_anchors, positives, True)
    low, high = (F.expr(f"{w} * (score div 100) + ({w} * (score % 100) + {up}) div 100") for w, up in zip(window, (99, 0), strict=True))  # no step leaves a long
    pairs = near.select("anchor_id", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")).where("positive_score >= 0")
    pairs = materialize(pairs, "pairs")
    windows = pairs.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("no", "low", "high"))).alias("windows"))  # ``positives`` of an anchor at most
    found = search(index, parts, anchors.join(windows, "anchor_id"), n_anchors, negatives, False)
    return found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor_id", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = p.label AS same, p.vec_id, list_sum(list_transform(list_zip(a.e, p.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v p ON a.vec_id <> p.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
