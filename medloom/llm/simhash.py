"""SimHash near-duplicate detection by a self-join of binary tries.

Fingerprints are made per document, then only distinct fingerprints take part in the join, so a
group of copies costs one row however large it is.  The 64 bits are cut into budget + 1 blocks: two
fingerprints within the Hamming budget agree on at least one whole block.  For every block the
fingerprints are rotated so that this block leads; each run of equal leading blocks is the root of a
binary trie over the other bits.  A root is joined with itself: pairs of nodes descend together,
every pair carries the number of bits in which its two prefixes differ, and a pair is dropped as soon
as that number exceeds the budget.  Links are folded into a union-find at once, so a task emits at
most one edge per fingerprint; pairs of subtrees that already form one component are not descended.
Edges of all tasks meet in a distributed contraction (minimum neighbour, pointer jumping).

Nothing is collected on the driver.  Null or blank texts have the fingerprint zero and are linked
like any other.  Repeated rows keep one output row each.  Rows are told apart by fingerprint, so a
null doc_id is allowed; it never becomes a component id unless a whole component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import map_batches, texts_of, written

SEED = 42
BITS = 64
#: Node pairs that are descended at once; bounds a task's memory.
FRONTIER = 1 << 18
#: Rows of whole blocks that a task searches at once, rows that a task gets on average, and rows from
#: which on a run of sixteen blocks is cut again.
AT_ONCE, PER_TASK, DENSE = 1 << 16, 250_000, 100_000
#: Row numbers that are broadcast to pick rows (16 bytes each, about); beyond, rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles that a sampled fingerprint is made of.
SAMPLE = 4
#: Texts of a candidate group that are compared in one place; a larger group is cut into chunks of about
#: so many, from ``CHUNKS`` chunks on of up to ``MOST``, and every pair of chunks is compared in a place of
#: its own.  So a place stays bounded; the number of places grows with the square of a group's different texts.
GROUP, CHUNKS, MOST = 300, 32, 4000


def fingerprint(text: str | None, shingle: int = 3) -> bytes:
    """The 8 bytes (most significant first) of a text's SimHash over word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    shift = shingle - 1
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)])
    n = len(words) - shift
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(n, BITS)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 255):  # sums of at most 255 ones stay within a byte
        ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", to: str = "fp") -> DataFrame:
    """docs with a long column ``to``: the fingerprint's 64 bits."""
    fields = [f.simpleString().split(":", 1) for f in docs.schema]
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in fields) + f", `{to}` long"

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = [b"".join(fingerprint(t, shingle) for t in part) for part in texts_of(batch, text)]
            fp = np.frombuffer(b"".join(out), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, to])

        return work

    return map_batches(docs, make, schema)


def sampled_fingerprints(text: str | None, count: int, width: int = 5) -> np.ndarray:
    """``count`` SimHash fingerprints, each over ``SAMPLE`` of a text's distinct word shingles (zeros if it has no word).

    The shingles of the k-th are those with the least k-th hash, so two texts choose alike as far as
    they are alike: at a Jaccard similarity of J a fingerprint is the same with probability J ** SAMPLE,
    wherever the texts differ.  A SimHash over all shingles would be over 3 bits apart for most near copies.
    """
    found = shingles(text, width)
    if not len(found):
        return np.zeros(count, np.int64)
    keys = _mix(found[None, :] ^ _mix(np.arange(1, count + 1, dtype=np.uint64))[:, None])
    chosen = np.argpartition(keys, SAMPLE - 1, axis=1)[:, :SAMPLE] if len(found) > SAMPLE else np.broadcast_to(np.arange(len(found)), (count, len(found)))
    features = _mix(found[chosen] + np.arange(1, count + 1, dtype=np.uint64)[:, None])
    bits = np.unpackbits(features[..., None].view(np.uint8), axis=2)
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > features.shape[1], axis=1).view(np.int64)[:, 0].copy()


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal_digest(text: str | None) -> bytes:
    """The same for texts that are equal up to ASCII case and white space."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles (fewer words: the whole sequence)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    found = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :] or ends[-1:], strict=False)])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def similar_components(sets: list[np.ndarray], similarity: float = 0.8) -> np.ndarray:
    """The smallest index of each set's component, where sets are linked if their Jaccard similarity
    reaches ``similarity``.

    Breadth first, so only sets that no component has reached yet are compared.  Two such sets share
    one of their rarest elements (prefix filter), so only sets found there are compared, exactly.
    """
    n = len(sets)
    root = np.full(n, -1)
    lengths = np.array([len(x) for x in sets], np.int64)
    if not n or not lengths.any():
        return np.zeros(n, np.int64)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum(lengths)
    tokens = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
    prefix = np.where(lengths > 0, lengths - np.ceil(similarity * lengths - 1e-9).astype(np.int64) + 1, 0)
    rare = np.concatenate([t[:k] for t, k in zip(tokens, prefix, strict=True)])
    by = np.argsort(rare, kind="stable")
    holder = np.repeat(np.arange(n), prefix)[by]
    first = np.searchsorted(rare[by], np.arange(len(counts) + 1))
    mark, open_ = np.zeros(len(counts), bool), np.ones(n, bool)
    for start in range(n):
        if not open_[start]:
            continue
        open_[start], root[start], queue = False, start, [start]
        while queue and open_.any():
            x = queue.pop()
            found = [holder[first[t] : first[t + 1]] for t in tokens[x][: prefix[x]]]
            if not found:  # sets without elements equal each other
                near = np.flatnonzero(open_ & (lengths == 0))
            else:
                near = np.unique(np.concatenate(found))
                near = near[open_[near] & (lengths[near] >= similarity * lengths[x] - 1e-9) & (similarity * lengths[near] - 1e-9 <= lengths[x])]
                if len(near):
                    mark[tokens[x]] = True
                    shared = np.array([np.count_nonzero(mark[tokens[y]]) for y in near])
                    mark[tokens[x]] = False
                    near = near[shared >= similarity * (lengths[x] + lengths[near] - shared) - 1e-9]
            open_[near], root[near] = False, start
            queue.extend(near.tolist())
    return root


def _with_sampled_fingerprints(rows: DataFrame, text: str, count: int) -> DataFrame:
    schema = ", ".join(f.simpleString().replace(":", " ", 1) for f in rows.schema) + ", fps array<long>, same binary"

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found, same = [], []
            for part in texts_of(batch, text):
                found += [sampled_fingerprints(t, count) for t in part]
                same += [normal_digest(t) for t in part]
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * count, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, fps, pa.array(same, pa.binary())], [*batch.schema.names, "fps", "same"])

        return work

    return map_batches(rows, make, schema)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    up = parent[x]
    while (up != x).any():
        x, up = up, parent[up]
    return x


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _split(keys: np.ndarray, lo: np.ndarray, depth: int) -> np.ndarray:
    """Where the keys below the node at lo begin to have the bit at this depth."""
    low = np.uint64(BITS - depth)
    prefix = (keys[lo] >> low) << low if depth else np.zeros(len(lo), np.uint64)
    return np.searchsorted(keys, prefix | np.uint64(1 << (BITS - 1 - depth)))


def trie_self_join(keys: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """For sorted distinct 64-bit keys: the smallest index of each key's component, where keys are
    linked if they share the first ``depth`` bits and differ in at most ``budget`` others."""
    n = len(keys)
    parent = np.arange(n)
    if n < 2:
        return parent
    cut = np.flatnonzero(np.diff(keys >> np.uint64(BITS - depth))) + 1 if depth else np.empty(0, np.int64)
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(depth, x, y, x, y, np.zeros(len(x), np.int8)) for x, y in _pieces(lo, hi)]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        # leaves: compare whole keys
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            _unite(parent, i[near], j[near])
            alo, ahi, blo, bhi, err = (v[~leaf] for v in (alo, ahi, blo, bhi, err))
        if len(alo) * 8 > n:  # the check costs a pass over the keys
            root = _find(parent, np.arange(n))
            parent[:] = root
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            same = (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]) & (root[alo] == root[blo])
            alo, ahi, blo, bhi, err = (v[~same] for v in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if d == BITS:  # equal keys only: distinct keys never get here as one node
            continue
        am, bm = _split(keys, alo, d), _split(keys, blo, d)
        own = alo == blo
        cross, other = err + 1, ~own
        parts = [
            (alo, am, bm, bhi, cross, np.ones(len(alo), bool)),
            (am, ahi, blo, bm, cross, other),
            (alo, am, blo, bm, err, np.ones(len(alo), bool)),
            (am, ahi, bm, bhi, err, np.ones(len(alo), bool)),
        ]
        x0, x1, y0, y1, e, use = (np.concatenate(column) for column in zip(*parts, strict=True))
        ok = use & (x1 > x0) & (y1 > y0) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
        # one frontier again; where it is cut, the last piece (nodes with themselves) is descended first
        nodes = [v[ok] for v in (x0, x1, y0, y1, e)]
        for at in range(0, len(nodes[0]), FRONTIER):
            stack.append((d + 1, *(v[at : at + FRONTIER] for v in nodes)))
    return _find(parent, np.arange(n))


def _pieces(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(lo), FRONTIER):
        yield lo[at : at + FRONTIER], hi[at : at + FRONTIER]


def rotate(keys: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return keys
    return (keys << np.uint64(by)) | (keys >> np.uint64(BITS - by))


def near_edges(marks: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (u, v) between nodes with fingerprints of the same number ``k`` within the budget.

    ``marks`` is a written table of (node, k, fp).  A star connects each component found in one place.
    """
    blocks = budget + 1
    at = [BITS * k // blocks for k in range(blocks + 1)]
    width = min(b - a for a, b in zip(at, at[1:], strict=False))
    inner = (BITS - width) // blocks
    turned = marks.select("node", "k", "fp", F.explode(F.array(*[F.lit(r) for r in range(blocks)])).alias("rot"))
    rotated = F.expr("CASE rot " + " ".join(f"WHEN {r} THEN {_rotl('fp', at[r])}" for r in range(blocks)) + " END")
    turned = turned.withColumn("key", rotated).withColumn("block", F.expr(f"key >>> {BITS - width}"))
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = marks.count() * blocks
    # runs of sixteen blocks with too many rows; there are at most blocks * 2 ** (width - 4) runs for each k
    run_of = F.expr("block >>> 4").alias("run")
    dense = turned.groupBy("k", "rot", run_of).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select("k", "rot", "run", F.lit(True).alias("dense"))
    if total > DENSE:
        turned = turned.withColumn("run", run_of).join(F.broadcast(dense), ["k", "rot", "run"], "left")
        subs = F.expr(f"IF(dense, sequence(0, {blocks - 1}), array(-1))")
    else:
        subs = F.array(F.lit(-1))
    dealt = turned.select("node", (F.col("k") * blocks + F.col("rot")).cast("int").alias("turn"), "fp", "key", "block", F.explode(subs).alias("sub"))
    lead = F.expr(f"IF(sub < 0, block, (block << {inner}) | ((key << ({width} + {inner} * sub)) >>> {BITS - inner}))").alias("lead")
    rows = dealt.select("turn", "sub", lead, "fp", "node").repartition(max(n, -(-total // PER_TASK)), "turn", "sub", "lead").sortWithinPartitions("turn", "sub", "lead")

    def solve(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Edges of whole blocks."""
        turn, sub, _, key, node = part
        starts = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (sub[1:] != sub[:-1])]))
        for a, b in zip(starts, [*starts[1:], len(turn)], strict=True):
            whole = rotate(key[a:b].view(np.uint64), at[turn[a] % blocks])
            if sub[a] >= 0:  # the shared bits of the second cut come next
                whole = _turn_tail(whole, width, inner * int(sub[a]))
            keys, first, back = np.unique(whole, return_index=True, return_inverse=True)
            own = node[a:b]
            root = own[first][trie_self_join(keys, width + (inner if sub[a] >= 0 else 0), budget)][back]
            u, v = own[own != root], root[own != root]
            for s in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (u, v)], ["u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, AT_ONCE
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= limit:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                ends = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]) | (whole[2][1:] != whole[2][:-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0
                if cut:
                    yield from solve([c[:cut] for c in whole])
                held, size = [[c[cut:] for c in whole]], size - cut
                limit = max(AT_ONCE, 2 * size)  # one block so far
        if size:
            yield from solve([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.mapInArrow(search, "u long, v long")


def _turn_tail(keys: np.ndarray, width: int, by: int) -> np.ndarray:
    """Rotate all but the first ``width`` bits."""
    if not by:
        return keys
    tail = keys << np.uint64(width)
    turned = (tail << np.uint64(by)) | ((tail >> np.uint64(BITS - by)) << np.uint64(width))
    head = keys >> np.uint64(BITS - width) << np.uint64(BITS - width)
    return head | (turned >> np.uint64(width))


def _rotl(column: str, by: int) -> str:
    return f"(`{column}` << {by}) | (`{column}` >>> {BITS - by})" if by else f"`{column}`"


def picked(rows: DataFrame, by: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with the written table ``by``: broadcast while it is small, so that rows stay where they are."""
    if by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by = F.broadcast(by)
    return rows.join(by, key, how)


def verified_roots(candidates: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(node, root) for nodes whose text's five-word shingles agree to ``similarity`` with those of another node.

    ``candidates`` is a written table of (node, guess, rid), ``texts`` holds (rid, text).  Only nodes of
    one guess are compared, all of them with each other.
    """
    sizes = candidates.groupBy("guess").agg(F.greatest(F.least(F.lit(CHUNKS), F.ceil(F.count(F.lit(1)) / GROUP)), F.ceil(F.count(F.lit(1)) / MOST)).cast("int").alias("chunks"))
    sized = written(candidates.join(sizes, "guess").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")), "sized")
    places = F.expr("IF(chunks = 1, array(named_struct('lo', 0, 'hi', 0)), transform(filter(sequence(0, chunks - 1), j -> j <> chunk), j -> named_struct('lo', least(j, chunk), 'hi', greatest(j, chunk))))")
    # the texts join before they are dealt, so each is fetched once
    dealt = picked(texts, sized, "rid", "inner").select("guess", "node", "text", F.explode(places).alias("place")).select("guess", "place.lo", "place.hi", "node", "text")
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.repartition(n, "guess", "lo", "hi").sortWithinPartitions("guess", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        u, v, whole = [], [], []

        def search() -> None:
            root = similar_components(sets, similarity)
            for k in np.flatnonzero(root != np.arange(len(root))).tolist():
                u.append(nodes[k])
                v.append(nodes[root[k]])
                whole.append(at[2] == 0)

        def drain() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(whole, pa.bool_())], ["u", "v", "whole"])
            for x in (u, v, whole):
                x.clear()
            return out

        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                for *place, node, text in zip(*(c.to_pylist() for c in batch.slice(begin, 64).columns), strict=True):
                    if place != at:
                        if len(nodes) > 1:
                            search()
                        at, nodes, sets = place, [], []
                        if len(u) >= 10_000:
                            yield drain()
                    nodes.append(node)
                    sets.append(shingles(text))
        if len(nodes) > 1:
            search()
        yield drain()

    edges = written(rows.mapInArrow(run, "u long, v long, whole boolean"), "verified")
    done = edges.where("whole").select(F.col("u").alias("node"), F.col("v").alias("root"))
    # a star's centre has no edge of its own here; its root is itself wherever no row says otherwise
    return done.unionByName(components(edges.where("NOT whole")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge.

    Each round every node takes the least of itself and its neighbours as parent, pointers are
    doubled until they rest, and the edges between different roots go on.  Every node that isn't
    least among its neighbours is merged, so the edges fade within a logarithmic number of rounds.
    """
    edges = written(edges.where("u != v").select("u", "v").union(edges.where("u != v").select("v", "u")).distinct(), "edges")
    mapping = None
    while edges.limit(1).count():
        parent = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parent")
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = written(parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parent")
            if not parent.where("moved").limit(1).count():
                break
            parent = parent.drop("moved")
        parent = parent.select("u", "p")
        left = edges.join(parent, "u").select(F.col("p").alias("a"), F.col("v").alias("u")).join(parent, "u").select("a", F.col("p").alias("b"))
        edges = written(left.where("a != b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
        up = parent.select(F.col("u").alias("root"), "p")
        mapping = parent.select(F.col("u").alias("node"), F.col("p").alias("root")) if mapping is None else written(mapping.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "mapping")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if mapping is None else mapping


def component_ids(marked: DataFrame, budget: int = 3, fp: str = "fp", doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for a written table of rows with ``fp``: the least doc_id within reach."""
    distinct = written(marked.groupBy(fp).agg(F.min(doc_id).alias("least")), "distinct")
    marks = distinct.select(F.col(fp).alias("node"), F.lit(0).alias("k"), F.col(fp).alias("fp"))
    roots = components(near_edges(marks, budget)).withColumnRenamed("node", fp)
    linked = written(distinct.join(roots, fp), "linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = linked.join(least, "root").select(F.col(fp).alias("_k"), "component_id")
    both = distinct.join(found, F.col(fp) == F.col("_k"), "left")
    return written(both.select(fp, F.coalesce("component_id", "least").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (hex), component_id."""
    marked = written(fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "marked")
    ids = component_ids(marked, budget)
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, budget: int = 3, fingerprints: int = 8, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least doc_id (ids before nulls, then the first row).

    Texts that are connected by sampled fingerprints of at most ``budget`` different bits are candidates;
    of these, texts are linked if their sets of five-word shingles have a Jaccard similarity of
    ``similarity`` or more, and groups are what links connect.  Texts without words form a group.  All
    columns stay as they are; names made here do not clash with them.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)], F.monotonically_increasing_id().alias("rid"))
    text, doc_id = (f"c{names.index(x)}" for x in ("text", "doc_id"))
    marked = written(_with_sampled_fingerprints(inner, text, fingerprints), "marked")
    best = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), "rid")).alias("best")
    # copies fall together before anything else moves
    nodes = written(marked.groupBy("fps", "same").agg(best).withColumn("node", F.xxhash64("same")), "nodes")
    marks = written(nodes.select("node", F.posexplode("fps").alias("k", "fp")), "marks")
    guess = components(near_edges(marks, budget)).withColumnRenamed("root", "guess")
    candidates = written(nodes.select("node", F.col("best.rid").alias("rid")).join(guess, "node"), "candidates")
    roots = verified_roots(candidates, marked.select("rid", F.col(text).alias("text")), similarity)
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    # only numbers of rows move: those of the copies, which are few, and then pick the rows where these are
    gone = written(marked.select("rid").join(grouped.select(F.col("best.rid").alias("rid")), "rid", "left_anti"), "gone")
    return picked(marked, gone, "rid", "left_anti").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
