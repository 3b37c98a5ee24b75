"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least 3/4 are linked.

1. Documents go in batches by a hash of id and text; the document frequency of each batch's distinct n-grams comes by
   request and reply in two hops (see exchange.py). The global order is by frequency class (powers of 2**(1/2)),
   rarest first, then by hash.
2. A set's prefix is its first n - ceil(3n/4) + 1 n-grams; linked sets share one of them. N-grams of one document
   are shared with none, so most documents end here, without a link.
3. Equal sets become one class, named by a number of its own; a batch sends the set of its copies once.
4. Each n-gram of a prefix names a pivot, the least class that has it there. Two classes that share a prefix
   n-gram share its pivot, so the sets of a pivot hold all their links; a class goes to few pivots, as near copies
   mostly have the same. Each pivot's sets are joined by a prefix tree (see trie.py).
5. A pivot of more than CHUNK n-grams is dealt into chunks by size band (linked sets are in the same band or in
   neighbours) and hash, each with the pivot's own set. Members that are not in the pivot's group then query the
   other chunks of their band and its neighbours in a second pass, slice by slice, so no link is lost and no task
   holds more than a chunk and a slice.
6. Components of the links give each class the smallest (doc_id, row) that links reach.

Null, empty and blank texts have empty sets and link with nothing; fewer than n words are one n-gram. Rows with a
null doc_id are left out of the join and returned as their own component (null). Rows that repeat a doc_id are
documents of their own, told apart by `row`, a hash of the text; equal rows are one. A text longer than a batch lies in one
batch and is hashed piece by piece. An empty table gives an empty result. N-grams are compared by 58 bits of a 64-bit
hash. Columns of docs other than doc_id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, deal, groups, lean, mix, settle, size_of, spread, trimmed, unpack, windows
from .exchange import Counted, Routes, count, low_bits
from .graph import components
from .trie import Trie, join

N = 5
#: top * |A and B| >= low * (|A| + |B|) is a Jaccard similarity of low / (top - low) = 3/4 at least.
BOUND = (7, 3)
BATCH_BYTES = 4_000_000
BUCKET_BYTES = 6_000_000
#: N-grams of a pivot's chunk, and of the pivots that one call joins; a set counts for SET_COST more than it has.
CHUNK = 400_000
CELL = 800_000
SET_COST = 50
#: Sizes of linked sets are 4/3 apart at most; bands are a little wider.
BAND = 1.34

SETS = "doc_id long, row long, n long, sig binary, grams binary"


def gram_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct n-gram of each text, by text, then hash."""
    w = Words(texts, lower=True)
    count = np.diff(w.bounds)
    doc = np.repeat(np.arange(len(texts)), count)
    grams = windows(w.hash, n)
    inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.empty(0, bool)
    of, h = [doc[: len(grams)][inside]], [grams[inside]]
    for size in range(1, n):  # texts of fewer words are one gram
        short = np.flatnonzero(count == size)
        at = w.bounds[short]
        whole = np.full(len(short), size, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                whole = mix(whole + w.hash[at + j]) * np.uint64(3)
        of.append(short)
        h.append(whole)
    of, h = np.concatenate(of), np.concatenate(h)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[first], h[first]


def _levels(counted: list[Counted]) -> tuple[list[np.ndarray], list[int]]:
    """The frequency class of each n-gram: 0 for one document, then rising by half powers of two to 62."""
    total = counted[0][1]
    return [np.minimum(62, np.floor(2 * np.log2(np.maximum(total, 1)) + 1e-9)).astype(np.int64)], []


def _ordered(table: pa.Table, replies: pa.Table, routes: Routes, n: int) -> pa.Table:
    """Each document's size and, if it may have links, its signature; with the first of equal sets the ordered set."""
    import xxhash

    of, h = gram_sets(unpack(table), n)
    drop = np.uint64(routes.drop[0])
    token = (routes.read(replies)[0][0][count(h >> drop << drop)[2]] << np.uint64(58)) | (h >> np.uint64(6))
    order = np.lexsort((token, of))
    token = token[order]
    ends = np.cumsum(np.bincount(of, minlength=table.num_rows))
    size, sig, packed, seen = [], [], [], set()
    for i, doc in enumerate(table.column("doc_id").to_pylist()):
        mine = token[ends[i - 1] if i else 0 : ends[i]]
        size.append(len(mine))
        raw = mine.tobytes() if doc is not None and len(_prefix(mine)) else b""
        sig.append(xxhash.xxh3_128_digest(raw) if raw else None)
        packed.append(raw if raw and sig[-1] not in seen else None)
        seen.add(sig[-1])
    columns = [table.column("doc_id"), table.column("row"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(packed, pa.binary())]
    return pa.table(columns, names=[x.split()[0] for x in SETS.split(", ")])


def _prefix(tokens: np.ndarray) -> np.ndarray:
    """Of an ordered set's prefix, the n-grams that other documents have too."""
    head = tokens[: len(tokens) - (3 * len(tokens) + 3) // 4 + 1] if len(tokens) else tokens
    return head[head >= np.uint64(1 << 58)]


def _posts(batches):
    """id and gram of each shared n-gram of the prefix of ordered sets (id, grams)."""
    for batch in batches:
        heads = [_prefix(np.frombuffer(g, np.uint64)) for g in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), list(map(len, heads)))
        grams = np.concatenate([np.empty(0, np.uint64), *heads]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.int64())], names=["id", "gram"])


LINKS = "pivot long, chunk long, chunks long, id long, root long, open boolean"


def _pivots(table: pa.Table, by: tuple[str, ...] = ("pivot", "chunk")):
    """Key, chunks, classes and sets of each pivot's chunk in a cell."""
    ids, grams, chunks = table.column("id").to_numpy(), table.column("grams"), table.column("chunks").to_numpy()
    keys = [table.column(c).to_numpy() for c in by]
    order = np.lexsort((ids, *reversed(keys)))
    if not len(order):
        return
    turn = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in keys], axis=0)) + 1
    for part in np.split(order, turn):
        yield tuple(int(k[part[0]]) for k in keys), int(chunks[part[0]]), ids[part], [np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in part]


def _join(table: pa.Table) -> pa.Table:
    """The links of each pivot's chunk as a star from the least class of each group; open: not in the pivot's group, of several chunks."""
    out: list[list] = [[] for _ in range(6)]
    for (pivot, chunk), chunks, ids, sets in _pivots(table):
        group = join(sets, BOUND)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids)
        root = least[group]
        away = (root != root[ids == pivot][0]) if chunks > 1 else np.zeros(len(ids), bool)
        keep = np.flatnonzero((root != ids) | away)
        for column, x in zip(out, (pivot, chunk, chunks, ids[keep], root[keep], away[keep]), strict=True):
            column.append(np.broadcast_to(x, len(keep)))
    kinds = [*[pa.int64()] * 5, pa.bool_()]
    return pa.table([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in LINKS.split(", ")])


def _probe(table: pa.Table, asked: pa.Table) -> pa.Table:
    """Links of open sets to the sets of other chunks of their pivot."""
    by = ("pivot", "chunk", "slice")
    queries = {key: (ids, sets) for key, _, ids, sets in _pivots(asked, by)}
    a, b = [], []
    for key, _, ids, sets in _pivots(table, by):
        if key in queries:
            tree, live = Trie(sets), np.ones(len(sets), bool)
            vocabulary = np.unique(np.concatenate(sets))
            for one, q in zip(*queries[key], strict=True):
                at = np.searchsorted(vocabulary, q)
                known = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == q)]
                # tokens that no set here has stand beyond all ids: they count for the query's size only
                tokens = np.concatenate([known, np.arange(tree.n_ids, tree.n_ids + len(q) - len(known))])
                for j in tree.linked(tokens, live, BOUND):
                    a.append(int(one))
                    b.append(int(ids[tree.order[j]]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _placed(pairs: DataFrame, chunk: int) -> DataFrame:
    """pivot, id, n, band, chunk (its band and a number), chunks (how many the pivot has) and others (the chunks that an open set asks) of each pair."""
    rows = pairs.withColumn("band", F.floor(F.log(BAND, F.col("n").cast("double"))))
    sizes = settle(rows.groupBy("pivot", "band").agg(F.sum(F.col("n") + SET_COST).alias("total")))
    large = sizes.groupBy("pivot").agg(F.sum("total").alias("total")).filter(F.col("total") > chunk).select("pivot")
    bands = settle(sizes.join(large, "pivot", "left_semi").select("pivot", "band", F.ceil(F.col("total") / chunk).alias("parts")))
    if bands.isEmpty():
        return rows.withColumns({"chunk": F.lit(0).cast("long"), "chunks": F.lit(1).cast("long"), "others": F.array().cast("array<long>")})
    number = lambda b, k: F.shiftleft(b, 32) + k
    every = bands.withColumn("chunk", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: number(F.col("band"), k))))
    every = every.groupBy("pivot").agg(F.sort_array(F.collect_list("chunk")).alias("all"))  # one entry for CHUNK n-grams
    at = rows.join(bands, ["pivot", "band"], "left").join(every, "pivot", "left")
    home = F.coalesce(number(F.col("band"), F.pmod(F.xxhash64("id", "pivot"), F.col("parts"))), F.lit(0).cast("long"))
    own = (F.col("pivot") == F.col("id")) & F.col("all").isNotNull()
    at = at.withColumn("chunk", F.explode(F.when(own, F.col("all")).otherwise(F.array(home))))
    near = F.filter("all", lambda c: (F.abs(F.shiftright(c, 32) - F.col("band")) <= 1) & (c != F.col("chunk")))
    none = F.array().cast("array<long>")
    return at.select("pivot", "id", "n", "band", "chunk", F.coalesce(F.size("all").cast("long"), F.lit(1)).alias("chunks"), F.when(own | F.col("all").isNull(), none).otherwise(near).alias("others"))


def _second_pass(links: DataFrame, placed: DataFrame, grams: DataFrame, chunk: int, cell: int) -> DataFrame:
    """a and b of the links between open sets and other chunks; each meets a chunk in the slice that its hash names."""
    left = links.filter("open").select("pivot", "chunk", "id").join(placed.select("pivot", "chunk", "id", "n", "others"), ["pivot", "chunk", "id"])
    left = settle(left.filter(F.size("others") > 0))
    slices = left.groupBy("pivot").agg(F.ceil(F.sum(F.col("n") + SET_COST) / chunk).alias("slices"))
    asked = left.join(slices, "pivot").withColumn("slice", F.pmod(F.xxhash64("id", F.lit("slice")), F.col("slices"))).withColumn("chunk", F.explode("others"))
    again = placed.join(slices, "pivot").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    total = sum(x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (asked, again))
    cells = groups(total, cell)
    cut = F.pmod(F.xxhash64("pivot", "chunk", "slice"), F.lit(cells)).alias("cell")
    shipped = [
        # columns of its own for each side, since both come from the same sets
        spread(x.join(grams, "id").select(*[F.col(c).alias(c) for c in ("pivot", "chunk", "slice", "id", "grams")], F.lit(1).cast("long").alias("chunks"), cut), cells, "cell", 2).groupBy("cell")
        for x in (again, asked)
    ]
    return shipped[0].cogroup(shipped[1]).applyInArrow(lean(lambda t, q: _probe(t, q)), "a long, b long")


def jaccard_components(docs: DataFrame, text: str = "text", n: int = N, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id, row (hash of the text) and component_row of each row of docs.

    component_id and component_row are the smallest pair (doc_id, row) of a row that links reach.
    """
    size = size_of(docs, text)
    routes = Routes(groups(size, batch_bytes), groups(size, bucket_bytes), (low_bits(size),))
    dealt = deal(docs, text, routes.batches, row=F.xxhash64(text))

    def ask(table: pa.Table) -> pa.Table:
        drop = np.uint64(routes.drop[0])
        return routes.ask(table.column("batch")[0].as_py(), [count(gram_sets(unpack(table), n)[1] >> drop << drop)[:2]])

    both = dealt.groupBy("batch").cogroup(routes.run(dealt, ask, _levels).groupBy("batch"))
    sets = settle(both.applyInArrow(lean(lambda t, r: _ordered(t, r, routes, n)), SETS))

    named = sets.filter("sig IS NOT NULL")
    seed = 0
    while True:  # a class's number is a hash of its set's; another seed if two of them should meet
        number = F.xxhash64("sig", F.lit(seed)).alias("id")
        classes = settle(named.groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("n").alias("n")).select("sig", "least", "n", number))
        total, distinct = classes.agg(F.count("*"), F.count_distinct("id")).first()
        if total == distinct:
            break
        seed += 1
    kept = named.filter("grams IS NOT NULL").select(number, "grams")
    posts = kept.mapInArrow(trimmed(_posts), "id long, gram long")
    shared = posts.groupBy("gram").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").drop("last")
    pairs = settle(posts.join(shared, "gram").select("pivot", "id").distinct().join(classes.select("id", "n"), "id").select("pivot", "id", "n"))
    placed = _placed(pairs, chunk)
    grams = kept.groupBy("id").agg(F.first("grams").alias("grams"))  # a batch has sent a set once, so a few rows a class
    cells = groups(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], cell)
    shipped = placed.select("pivot", "chunk", "chunks", "id").join(grams, "id").withColumn("cell", F.pmod(F.xxhash64("pivot", "chunk"), F.lit(cells)))
    links = settle(spread(shipped, cells, "cell", 2).groupBy("cell").applyInArrow(lean(_join), LINKS))

    found = links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    if not links.filter("open").isEmpty():
        found = found.union(_second_pass(links, placed, grams, chunk, cell))
    roots = components(found)
    rooted = classes.select("sig", "id", "least").join(roots, classes["id"] == roots["node"], "left").select("sig", "least", F.coalesce("root", "id").alias("root"))
    # written, so that the join deals both sides for itself and a large component can be split
    rooted = settle(rooted)
    least = settle(rooted.groupBy("root").agg(F.min("least").alias("first")))
    answer = settle(rooted.join(least, "root").select("sig", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row")))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "row", "sig")
    alone = rows.filter("sig IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.col("row").alias("component_row"))
    return alone.union(rows.filter("sig IS NOT NULL").join(answer, "sig").select("doc_id", "n_shingles", "component_id", "row", "component_row"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS u(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node AS doc_id, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
