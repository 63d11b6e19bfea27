"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Texts with equal word sequences form a class, of which one member, its representative, is joined. Each
representative has a signature of TREES strings of DEPTH min-hashes, one for each tree of the forest. A tree is
the sorted table of its strings, so that runs of a common prefix are the nodes of its trie, and two texts meet
where their strings part. Matched prefixes are shortened from full depth until the target recall: a text stops at
the longest prefix that a partner shares in some tree with that chance, given the least similarity that a partner
of a text of its number of shingles can have (short texts stop early). A pair meets at the longer of its two stops.

A pair belongs to the first tree where it meets, so it is looked at once. Within a node, members compare whole
signatures; those with a likely partner there send their texts, and likely pairs alone are verified on their shingle
sets. Nodes of many members are cut into blocks, and each pair of blocks is a task's work: pairs never leave it.
What does is a count of links for each text, and a spanning forest of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, slices, small, strings, table, trimmed, tuned
from .graph import components
from .words import mix, shingles, word_hashes

TREES, DEPTH, BLOCK_ROWS, BLOCK_CHARS, GROWTH, TILE = 12, 6, 512, 8_000_000, 16, 512
_A = np.random.default_rng(29).integers(1, 2**64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(31).integers(0, 2**64, TREES * DEPTH, dtype=np.uint64)


def prefix_depth(similarity: float, target: float) -> int:
    """The longest prefix at which a pair of that similarity shares a node in some tree with chance `target`."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < target:
        depth -= 1
    return depth


def least_similarity(n: int, bound: float) -> float:
    """The least Jaccard similarity, of at least `bound`, that a set of n elements can have with any set."""
    found = 1.0
    for common in range(max(1, math.ceil(bound * n - 1e-9)), n + 1):
        union = int(common / bound + 1e-9)  # the largest that keeps the bound
        if union >= n:
            found = min(found, common / union)
    return found


def stops(similarity: float, target: float) -> np.ndarray:
    """The prefix at which a text of 0, 1, 2, ... shingles stops; the last entry is of all longer texts."""
    return np.array([DEPTH, *[prefix_depth(least_similarity(n, similarity), target) for n in range(1, 65)], prefix_depth(similarity, target)], np.uint8)


def signatures(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hashes of each text's shingles [texts, TREES * DEPTH], and numbers of shingles."""
    sets, offsets = shingles(column, width)
    n = np.diff(offsets)
    out = np.zeros((len(n), len(_A)), np.uint32)
    some = n > 0
    if some.any():
        starts = offsets[:-1][some]
        for k, (a, b) in enumerate(zip(_A, _B)):
            out[some, k] = np.minimum.reduceat(((sets * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out, n


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of many texts, a slice of them at a time."""
    parts = [shingles(strings(b.column("text")), width) for b in slices(pa.record_batch({"text": texts}))]
    ends = np.cumsum([0] + [len(s) for s, _ in parts])
    return np.concatenate([s for s, _ in parts]), np.concatenate([[0], *[at[1:] + e for (_, at), e in zip(parts, ends)]])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components under links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups of a stream that is sorted by key: what a batch ends with waits for the next."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        columns = [now.column(c).to_numpy() for c in key]
        last = np.ones(now.num_rows, bool)
        for c in columns:
            last &= c == c[-1]
        cut = now.num_rows - int(last[::-1].argmin() if not last.all() else now.num_rows)
        rest = now.slice(cut)
        if cut:
            yield now.slice(0, cut)
    if rest is not None:
        yield rest


def _blocked(df: DataFrame, key: list[str], blocks: F.Column, order: F.Column) -> DataFrame:
    """Cuts each group of `key` into blocks by a hash of node and gives each row to all pairs of blocks that
    hold its own: (key, i, j) with i <= j then sees at most two blocks of rows, and every pair of rows once
    at least. own: the row's block. Rows of a pair of blocks are sorted by `order`."""
    df = df.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")))
    df = df.withColumn("o", other).withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("o", "m")
    return df.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", order)


def _meet(x: np.ndarray, y: np.ndarray, need: np.ndarray, tree: np.ndarray, loose: float) -> np.ndarray:
    """Of pairs of signatures, those that are likely similar and whose first common node, `need` hashes deep, is in
    `tree`. x and y broadcast to [..., TREES * DEPTH]; need and tree to [...]."""
    first, same = np.full(need.shape, TREES, np.uint8), np.zeros(need.shape, np.uint8)
    for t in range(TREES - 1, -1, -1):
        run, depth = None, np.zeros(need.shape, np.uint8)
        for k in range(DEPTH):
            equal = x[..., t * DEPTH + k] == y[..., t * DEPTH + k]
            same += equal
            run = equal if run is None else run & equal
            depth += run
        first[depth >= need] = t
    return (first == tree) & (same >= loose * TREES * DEPTH)


def _pairs(group: np.ndarray, own: np.ndarray, sign: np.ndarray, stop: np.ndarray, loose: float, partner_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs (places) of rows of equal group (rows: tree, key, i, j), all groups at once. Between blocks i < j
    only pairs of both. partner_only: pairs of two rows that have one already are passed over."""
    n, shift, at = len(own), 1, np.arange(len(own))
    has = np.zeros(n, bool)
    while True:
        at = at[at < n - shift]
        at = at[(group[:, at] == group[:, at + shift]).all(0)]
        if not len(at):
            return
        go = at[(group[2, at] == group[3, at]) | (own[at] != own[at + shift])]
        if partner_only:
            go = go[~(has[go] & has[go + shift])]
        for some in np.array_split(go, max(1, len(go) // 20_000)):
            x, y = some, some + shift
            fine = _meet(sign[x], sign[y], np.maximum(stop[x], stop[y]), group[0, x], loose)
            has[x[fine]] = has[y[fine]] = True
            yield x[fine], y[fine]
        shift += 1


def _common(sets: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[k] and y[k]."""
    size = np.diff(offsets)
    out = np.zeros(len(x), np.int64)
    step = np.cumsum(size[x] + size[y]) // 2_000_000
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(step)) + 1):
        rows = np.concatenate([x[part], y[part]])
        n = size[rows]
        values = sets[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)]
        pair = np.repeat(np.tile(np.arange(len(part)), 2), n)
        order = np.lexsort((values, pair))
        values, pair = values[order], pair[order]
        both = (values[1:] == values[:-1]) & (pair[1:] == pair[:-1])
        out[part] = np.bincount(pair[1:][both], minlength=len(part))
    return out


def _products(sets: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of sets a with each of sets b, as products of rows over the elements that
    both sides have."""

    def laid(rows):
        n = np.diff(offsets)[rows]
        return sets[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)], np.repeat(np.arange(len(rows)), n)

    (va, ra), (vb, rb) = laid(a), laid(b)
    shared = np.intersect1d(np.unique(va), np.unique(vb), assume_unique=True)
    out, wide = np.zeros((len(a), len(b)), np.float32), max(1, 8_000_000 // max(len(a), len(b), 1))
    for k in range(0, len(shared), wide):
        some = shared[k : k + wide]
        x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for m, v, r in ((x, va, ra), (y, vb, rb)):
            at = np.minimum(np.searchsorted(some, v), len(some) - 1)
            held = some[at] == v
            m[r[held], at[held]] = 1
        out += x @ y.T
    return out


def _verified(group: np.ndarray, own: np.ndarray, sign: np.ndarray, stop: np.ndarray, sets: np.ndarray, offsets: np.ndarray, bound: float, loose: float):
    """Places (x, y) of all pairs of equal group that meet there and have that similarity, exactly, a part at a time.

    Small groups' likely pairs are verified one by one, all groups together; of large ones, a tile of rows by a tile
    of rows at a time, by products.
    """
    size = np.diff(offsets)
    near = lambda both, x, y: (both >= bound * (size[x] + size[y] - both) - 1e-6) & (both > 0)
    cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), len(own)]
    few = np.repeat(np.diff(cuts) <= 32, np.diff(cuts)) if len(own) else np.zeros(0, bool)
    place = np.flatnonzero(few)
    for x, y in _pairs(group[:, place], own[place], sign[place], stop[place], loose):
        x, y = place[x], place[y]
        fine = near(_common(sets, offsets, x, y), x, y)
        yield x[fine], y[fine]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 32:
            one = group[2, a] == group[3, a]
            order = a + np.argsort(own[a:b], kind="stable")
            middle = int(np.count_nonzero(own[a:b] == group[2, a]))
            left, right = (order, order) if one else (order[:middle], order[middle:])
            for p in range(0, len(left), TILE):
                for q in range(p if one else 0, len(right), TILE):
                    x, y = left[p : p + TILE], right[q : q + TILE]
                    likely = _meet(sign[x][:, None], sign[y][None], np.maximum(stop[x][:, None], stop[y][None]), group[0, a], loose)
                    if one and p == q:
                        likely = np.triu(likely, 1)
                    # only rows with a likely partner in the tile are laid out
                    r, c = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
                    if len(r):
                        both = np.zeros(likely.shape, np.float32)
                        both[np.ix_(r, c)] = _products(sets, offsets, x[r], y[c])
                        u, v = np.nonzero(likely & near(both, x[:, None], y[None]))
                        yield x[u], y[v]


_KEY = ["d1", "d2", "n_words"]


def digests(column: pa.Array) -> dict[str, pa.Array]:
    """n_words, d1 and d2 of each text: equal for texts of equal words, and else different (128 bits)."""
    words, offsets = word_hashes(column)
    n = np.diff(offsets)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], n)
    sums = []
    for salt in (1, 2):
        h = mix(words + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt)))
        at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        sums.append((at[offsets[1:]] - at[offsets[:-1]]).view(np.int64))
    return {"n_words": pa.array(n, pa.int64()), "d1": pa.array(sums[0]), "d2": pa.array(sums[1])}


def digested(docs: DataFrame) -> DataFrame:
    """docs with n_words, d1 and d2 (columns of those names are replaced)."""
    docs = docs.drop(*_KEY)
    schema = docs.select("*").schema  # a copy, which add() may change
    for c in ("n_words", "d1", "d2"):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch({c: part.column(c) for c in docs_columns} | digests(part.column("text")))

    docs_columns = docs.columns
    return docs.mapInArrow(trimmed(run), schema)


def _least(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df's rows of the least id of their class (null ids, if it has no other), with the columns of classes."""
    own = classes.withColumnsRenamed({c: f"__{c}" for c in _KEY})
    same = [df[c] == own[f"__{c}"] for c in _KEY] + [df["doc_id"].eqNullSafe(own["first"])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(own, on).drop(*[f"__{c}" for c in _KEY])


def join(docs: DataFrame, similarity: float = 0.8, width: int = 5, target: float = 0.999) -> DataFrame:
    """doc_id, rep_id, class_id, n_links, n_class, n_words for each row of docs (doc_id, text).

    Shingles are `width` successive words (ASCII white space parts words; case is ignored); a shorter text has
    all its words as its one shingle. rep_id: least id of the rows with the same words. class_id: least id of
    the texts that links of similarity or more connect with it. n_links: number of other rows at that similarity,
    copies counted. n_class: rows of the class. Texts without words (null, empty, blank) are linked with nothing:
    rep_id and class_id are their own ids and n_links 0. Rows that repeat an id, or have none, are copies or links
    of others as their texts say; null ids come last, so rep_id and class_id are null only where all rows of the
    class have null ids. An empty table gives no rows; other columns of docs are left out.

    A pair at exactly the bound is found with chance `target` or more, others with more; all found are exact.
    """

    return _joined(docs, similarity, width, target)[0]


def _joined(docs: DataFrame, similarity: float = 0.8, width: int = 5, target: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """join()'s rows; and each distinct text's digest, least id (first) and component."""
    docs = docs.select("doc_id", "text")
    rows_ = keep(digested(docs).drop("text"))
    classes = rows_.where("n_words > 0").groupBy(*_KEY).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # written, so that a text's node stays what it is
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))
    stop_at = stops(similarity, target)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                sign, n = signatures(strings(part.column("text")), width)
                some = n > 0
                signs = pa.array([r.tobytes() for r in sign[some]], pa.binary())
                chars = np.array([len(x) for x in strings(part.column("text")).to_pylist()], np.int64)[some]
                key = {c: x.filter(pa.array(some)) for c, x in digests(part.column("text")).items()}
                stop = pa.array(stop_at[np.minimum(n[some], len(stop_at) - 1)].astype(np.int32))
                yield pa.record_batch({"doc_id": part.column("doc_id").filter(pa.array(some)), **key, "chars": pa.array(chars), "stop": stop, "signature": signs})

    # every row is signed, where it lies, and only then joined with the representatives: no text is shuffled
    every = docs.mapInArrow(trimmed(signed), "doc_id long, n_words long, d1 long, d2 long, chars long, stop int, signature binary")
    nodes = keep(_least(every, classes).select("node", "chars", "stop", "signature").dropDuplicates(["node"]))
    loose = max(0.0, similarity - 5.3 * (similarity * (1 - similarity) / (TREES * DEPTH)) ** 0.5)
    # a row a tree, under the shortest prefix that any text stops at; nodes further down are told apart within it
    roots = F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, xxhash64(substring(signature, t * {4 * DEPTH} + 1, {4 * int(stop_at.min())})) AS key))")
    strings_ = nodes.select("node", "chars", F.explode(roots).alias("r")).select("node", "chars", "r.*")
    sizes = strings_.groupBy("tree", "key").agg(F.count("*").alias("n"), F.sum("chars").alias("c")).where("n > 1")
    # blocks of a large node grow with the square root of its members: so do copies of a row and pairs of blocks
    rows = F.greatest(F.lit(BLOCK_ROWS), F.sqrt("n") * GROWTH)
    sizes = sizes.select("tree", "key", F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("c") / BLOCK_CHARS)).alias("blocks"))
    shared = keep(strings_.drop("chars").join(sizes, ["tree", "key"]))
    # most texts share no node; the signatures of the others alone are shuffled
    asked = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "stop", "signature")
    key = ["tree", "key", "i", "j"]
    string = F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    placed = _blocked(shared.join(asked, "node"), ["tree", "key"], F.col("blocks"), string)

    def held(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node, own, stop = (t.column(c).to_numpy() for c in ("node", "own", "stop"))
        sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(len(node), -1)
        return node, np.stack([t.column(c).to_numpy().astype(np.int64) for c in key]), own, sign, stop.astype(np.uint8)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, key):
            t = t.combine_chunks()
            node, group, own, sign, stop = held(t)
            some = np.zeros(len(node), bool)
            for x, y in _pairs(group, own, sign, stop, loose, partner_only=True):
                some[x] = some[y] = True
            if some.any():
                yield from t.select([*key, "own", "node", "stop", "signature"]).filter(pa.array(some)).to_batches()

    columns = "tree int, key long, i int, j int, own int, node long, stop int, signature binary"
    wanted = keep(placed.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(trimmed(likely), columns))
    members = small(keep(classes.join(wanted.select("node").distinct(), "node").select(*_KEY, "first", "copies", "node")))
    full = _least(digested(docs), members).select("node", "copies", "text").dropDuplicates(["node"])
    verifying = wanted.join(full, "node").repartition(*key).sortWithinPartitions(*key)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, key):
            t = t.combine_chunks()
            node, group, own, sign, stop = held(t)
            copies = t.column("copies").to_numpy()
            sets, offsets = _sets(strings(t.column("text")), width)
            links, left, right = np.zeros(len(node), np.int64), [], []
            for x, y in _verified(group, own, sign, stop, sets, offsets, similarity, loose):
                links += np.bincount(x, copies[y], len(node)).astype(np.int64) + np.bincount(y, copies[x], len(node)).astype(np.int64)
                if len(x):  # a forest of what was found so far stands for it
                    left.append(x)
                    right.append(y)
                if sum(map(len, left)) > 4 * len(node) + 1_000_000:
                    root = _roots(len(node), np.concatenate(left), np.concatenate(right))
                    left, right = [np.arange(len(node))], [root]
            some = links > 0
            if some.any():
                root = _roots(len(node), np.concatenate(left), np.concatenate(right))
                yield pa.record_batch({"node": pa.array(node[some]), "links": pa.array(links[some]), "root": pa.array(node[root[some]])})

    verified = keep(verifying.select(*key, "own", "node", "stop", "signature", "copies", "text").mapInArrow(trimmed(verify), "node long, links long, root long"))
    linked = components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "node", "left").join(linked, "node", "left")
    classes = classes.select(*_KEY, "node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    total = classes.groupBy("component").agg(F.sum("copies").alias("n_class"), F.min("first").alias("class_id"))
    of = classes.join(total, "component")
    out = rows_.join(of, _KEY, "left").withColumn("known", F.col("node").isNotNull())
    out = out.select(
        "doc_id", F.when(F.col("known"), F.col("first")).otherwise(F.col("doc_id")).alias("rep_id"),
        F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"), "n_words",
    )
    return out, classes.select(*_KEY, "first", "component")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts, the document of least id stays (null ids last; of texts that share it, the
    one of least digest); its rows of that text, if there are several, are brought down to one. Texts without
    words are linked with nothing: each stays, but rows of one id are brought down to one."""
    tuned(spark)
    classes = _joined(docs)[1]
    order = F.struct(F.col("first").isNull(), "first", *_KEY)
    kept = classes.groupBy("component").agg(F.min_by(F.struct("first", *_KEY), order).alias("x")).select("x.*")
    every = digested(docs)
    columns = [c for c in docs.columns if c not in _KEY]
    # most texts stay, so this table grows with them; its join shuffles at any size
    rows = _least(every, keep(kept).hint("merge")).drop("first").union(every.where("n_words = 0"))
    # blank texts without an id have nothing that could repeat
    own = F.when((F.col("n_words") == 0) & F.col("doc_id").isNull(), F.monotonically_increasing_id())
    one = Window.partitionBy("doc_id", *_KEY, "__own").orderBy(F.xxhash64(*columns))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    out = rows.withColumn("__own", own).withColumn("__n", F.row_number().over(one)).where("__n = 1") if repeated else rows
    return out.select(*columns)
