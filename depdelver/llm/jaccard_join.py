"""N-gram Jaccard join by T-occurrence search with DivideSkip."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depdelver.llm.components import connected_components
from depdelver.llm.ngram_counts import KEPT, Block, with_totals
from depdelver.llm.rows import unpacked, whole
from depdelver.llm.textops import SPACES, U, grams, mix, window_hash, word_blocks
from depdelver.session import cut, settle

SHINGLE = 5
#: Two documents link from this similarity on, in hundredths.
PERCENT = 75
#: Documents and shingles that a search holds, about; larger groups are cut.
DOCS, TOKENS = 1024, 1_000_000
#: Weight of the length of the longest list in choosing how many lists are long.
MU = 0.0085


def shingles(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a block and the document of each; one for a text of fewer words."""
    lens = np.diff(offs)
    doc = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    g = grams(h, n)
    whole = doc[: len(g)] == doc[n - 1 :] if len(g) else np.empty(0, bool)
    out, docs = [g[whole]], [doc[: len(g)][whole]]
    for k in range(1, n):
        short = np.flatnonzero(lens == k)
        if len(short):
            out.append(window_hash(h, offs[short], k))
            docs.append(short.astype(np.uint64))
    return np.concatenate(out), np.concatenate(docs)


def shingle_sets(n: int):
    """The shingles of every document, each once, by hash."""

    def run(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        found, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, _, h, offs in word_blocks(texts, SPACES):
            t, d = shingles(h, offs, n)
            found.append(t >> U(64 - KEPT))
            docs.append(d.astype(np.int64) + first)
        t, d = np.concatenate(found), np.concatenate(docs)
        order = np.lexsort((t, d))
        t, d = t[order], d[order]
        new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))[: len(t)]
        return t[new], d[new]

    return run


DOCUMENT = "rid long, doc_id long, n long, h1 long, h2 long, tokens binary"
_DOCUMENT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary())])


def _assemble(percent: int):
    """The documents of a block; those that can link have their repeated shingles, rarest first."""

    def run(block: Block) -> pa.Table:
        size = len(block.ids)
        level = np.log2(np.maximum(block.total, 1)).astype(np.uint64)  # the class of the number of documents
        keys = (level << U(KEPT)) | block.gram
        order = np.lexsort((keys, block.doc))
        keys, doc, repeated = keys[order], block.doc[order], (block.total > 1)[order]
        sizes = np.bincount(doc, minlength=size)
        h1, h2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        full = sizes > 0
        if len(keys):
            at = (np.cumsum(sizes) - sizes)[full]
            h1[full], h2[full] = np.add.reduceat(mix(keys), at), np.add.reduceat(mix(keys ^ U(0x5851F42D4C957F2D)), at)
        keys, doc = keys[repeated], doc[repeated]
        cuts = np.searchsorted(doc, np.arange(size + 1))
        tokens: list = [None] * size
        for i in np.flatnonzero((100 * np.diff(cuts) >= percent * sizes) & full).tolist():
            tokens[i] = keys[cuts[i] : cuts[i + 1]].tobytes()
        columns = (block.first + np.arange(size), block.ids, sizes, h1.view(np.int64), h2.view(np.int64), tokens)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _DOCUMENT, strict=True)], schema=_DOCUMENT)

    return run


def _prefixes(percent: int):
    """The first shingles of each document, of which two that link have one in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, n, blobs = (batch.column(c).to_pylist() for c in ("rid", "n", "tokens"))
            own = [np.frombuffer(b, np.int64) for b in blobs]
            own = [t[: len(t) - -(-percent * k // 100) + 1] for t, k in zip(own, n, strict=True)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(rid, [len(t) for t in own]), pa.int64())], ["key", "rid"])

    return run


def links(tokens: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """A component number for each of a few thousand documents.

    In order of size, each document looks among those before it for the ones that share at least
    T shingles: the lists of its rarer shingles are merged and counted, its longest lists are
    only probed, by binary search, for documents that can still reach T. Documents that already
    are in its component are left out.
    """
    m = len(tokens)
    label = np.arange(m)
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    own = [tokens[i] for i in order.tolist()]
    lens = np.array([len(t) for t in own])
    values, ids = np.unique(np.concatenate(own), return_inverse=True)
    doc = np.repeat(np.arange(m), lens)
    by = np.lexsort((doc, ids))
    postings, keys = doc[by], ids[by].astype(np.int64) * m + doc[by]
    total = np.bincount(ids, minlength=len(values))
    start = np.cumsum(total) - total
    filled = np.zeros(len(values), np.int64)  # of each list, how many documents come before this one
    at = np.append(0, np.cumsum(lens))
    for i in range(m):
        x = ids[at[i] : at[i + 1]]
        x_len = filled[x]
        filled[x] += 1
        t = -(-percent * int(n[i]) // 100)
        x, x_len = x[x_len > 0], x_len[x_len > 0]
        if len(x) < t or not len(x):
            continue
        n_long = min(len(x) - 1, t - 1, int(t / (MU * log2(max(2, int(x_len.max()))) + 1)))
        by_len = np.argsort(x_len, kind="stable")
        short, long_ = by_len[: len(x) - n_long], by_len[len(x) - n_long :]
        k = x_len[short]
        merged = postings[np.repeat(start[x[short]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        count = np.bincount(merged, minlength=i)
        c = np.flatnonzero(count >= t - n_long)
        c = c[(100 * n[c] >= percent * n[i]) & (label[c] != label[i])]
        if not len(c):
            continue
        probe = (x[long_].astype(np.int64) * m)[:, None] + c
        found = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        both = count[c] + (keys[found] == probe).sum(axis=0)
        for other in np.unique(label[c[100 * both >= percent * (n[c] + n[i] - both)]]).tolist():
            label[label == other] = label[i]
    out = np.empty(m, np.int64)
    out[order] = label
    return out


def _search(percent: int):
    """The least rid of each document's component among those of a task."""

    def run(table: pa.Table) -> pa.Table:
        rid, n = (table.column(c).to_numpy() for c in ("rid", "n"))
        order = np.argsort(rid)
        blobs = table.column("tokens").to_pylist()
        label = links([np.frombuffer(blobs[i], np.uint64) for i in order.tolist()], n[order], percent)
        rid = rid[order]
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        least = rid[first[inverse]]
        return pa.table({"rid": rid[rid != least], "least": least[rid != least]})

    return run


def _search_tasks(reps: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """(rid, least): links among the sets that are in one task of ``tasks`` (task, rid)."""
    held = tasks.distinct().join(reps.select("rid", "n", "tokens"), "rid")
    return held.groupBy("task").applyInArrow(_search(percent), "rid long, least long")


def _blocks(docs: Column, size: Column) -> Column:
    """How many blocks, of which two make a task, a group of so many sets and bytes has."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(2 * docs / DOCS, 2 * size / (8 * TOKENS)))).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def search_groups(reps: DataFrame, groups: DataFrame, posted: DataFrame, percent: int) -> DataFrame:
    """(member, least): the components of linked sets.

    ``reps``: rid, n and tokens of different sets; ``posted``: key and rid, where two sets that
    link have a key in common; ``groups``: node (a rid) and comp, the components of sets with
    common keys. Sets that are alone in their component are missing.

    1. Small groups are searched whole, about DOCS sets a task.
    2. Larger ones are cut into blocks, and each is searched together with the first one: a
       group of near copies is mostly one component after that.
    3. What is then outside a group's largest component can still have links to other
       components. Two such sets share a key, so the lists of the keys that hold sets of several
       components are searched, equal lists once; or, if that is less, the sets outside against
       the whole group. Long lists are cut into blocks, so no task holds more than DOCS sets.

    A task may hold sets that do not belong together; it returns nothing but links that are true.
    """
    key = lambda *c: F.xxhash64(*c).alias("task")
    members = cut(groups.select(F.col("node").alias("rid"), "comp").join(reps.select("rid", F.length("tokens").alias("bytes")), "rid"))
    extent = members.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("bytes").alias("size"))
    extent = cut(extent.withColumn("blocks", _blocks(F.col("docs"), F.col("size"))))
    small, large = extent.where("blocks <= 2"), extent.where("blocks > 2")
    n_docs, n_bytes = small.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).head()
    bins = max(1, ceil(n_docs / DOCS), ceil(n_bytes / 8 / TOKENS))
    whole_ = members.join(small, "comp").select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("task"), "rid")
    if not large.head(1):
        return cut(_search_tasks(reps, whole_, percent)).withColumnRenamed("rid", "member")
    own = cut(members.join(large.select("comp", "blocks", "size"), "comp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")))
    first = own.where("block = 0").withColumn("i", _numbers(F.col("blocks"))).unionByName(own.where("block > 0").withColumn("i", F.col("block")))
    found = cut(_search_tasks(reps, whole_.unionByName(first.select(key("comp", "i"), "rid")), percent))
    edges = lambda df: df.select(F.col("rid").alias("a"), F.col("least").alias("b"))
    labels = connected_components(edges(found)).withColumnRenamed("comp", "label")
    labelled = own.join(labels, own["rid"] == labels["node"], "left").select("rid", "comp", "bytes", "size", "blocks", F.coalesce("label", "rid").alias("label"))
    sizes = labelled.groupBy("comp", "label").agg(F.count("*").alias("k")).groupBy("comp").agg(F.max(F.struct("k", "label")).alias("x"))
    labelled = cut(labelled.join(cut(sizes.select("comp", F.col("x.label").alias("main"))), "comp").withColumn("out", F.col("label") != F.col("main")))
    rests = labelled.where("out").groupBy("comp").agg(F.count("*").alias("rest"), F.sum("bytes").alias("rest_size"), F.first("blocks").alias("blocks"), F.first("size").alias("size"))
    rests = cut(rests.withColumn("rests", _blocks(F.col("rest"), F.col("rest_size"))))
    if not rests.head(1):
        return labels.select(F.col("node").alias("member"), F.col("label").alias("least"))
    open_ = labelled.join(rests.select("comp"), "comp", "left_semi")
    places = cut(posted.join(open_, "rid").select("comp", "key", "rid", "label", "out", "bytes"))
    rest = lambda c: F.sum(F.when(F.col("out"), c).otherwise(0))
    lists = places.groupBy("comp", "key").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("size"), rest(F.lit(1)).alias("rest"), rest(F.col("bytes")).alias("rest_size"),
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("rid")).alias("s1"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("s2"),
    )
    same = ["comp", "n", "size", "rest", "rest_size", "s1", "s2"]
    lists = lists.where("lo <> hi").groupBy(*same).agg(F.min("key").alias("key"))
    lists = cut(lists.withColumns({"rests": _blocks(F.col("rest"), F.col("rest_size")), "blocks": _blocks(F.col("n"), F.col("size"))}))
    # A set outside is read with every block of its list, a block with every block of sets outside.
    cost = lambda: F.col("size") * F.col("rests") + F.col("rest_size") * F.col("blocks")
    by_list = lists.groupBy("comp").agg(F.sum(cost()).alias("lists"))
    way = cut(rests.join(by_list, "comp").select("comp", "rests", "blocks", (F.col("lists") < cost()).alias("cheap")))
    spread = lambda df: df.withColumns({"r": F.pmod(F.xxhash64("rid", F.lit(1)), F.col("rests")).cast("int"), "b": F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")})
    chosen = places.join(way.where("cheap").select("comp"), "comp", "left_semi").join(lists.select("comp", "key", "rests", "blocks"), ["comp", "key"])
    short = F.col("blocks") <= 2
    n_docs = lists.where(short).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).head()
    bins = max(1, ceil(n_docs[0] / DOCS), ceil(n_docs[1] / 8 / TOKENS))
    tasks = chosen.where(short).select(F.pmod(F.xxhash64("comp", "key"), F.lit(bins)).alias("task"), "rid")
    groups_ = open_.drop("blocks").join(way.where("NOT cheap").select("comp", "rests", "blocks"), "comp").withColumn("key", F.lit(None).cast("long"))
    long_ = cut(spread(chosen.where(~short).select("comp", "key", "rid", "out", "rests", "blocks").unionByName(groups_.select("comp", "key", "rid", "out", "rests", "blocks"))))
    a = long_.where("out").withColumn("b", _numbers(F.col("blocks")))
    b = long_.withColumn("r", _numbers(F.col("rests")))
    crossed = a.select(key("comp", "key", "r", "b"), "rid").unionByName(b.select(key("comp", "key", "r", "b"), "rid"))
    more = cut(_search_tasks(reps, tasks.unionByName(crossed), percent))
    ends = connected_components(edges(found).unionByName(edges(more)))
    return ends.select(F.col("node").alias("member"), F.col("comp").alias("least"))


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, row and first_row of every document.

    ``row`` is its monotonically_increasing_id in ``docs``; ``first_row`` that of the row with the
    component's smallest doc_id, or the first of several.

    A document's set are the distinct runs of ``shingle`` words (runs of anything but ASCII white
    space, A-Z lower-cased) of its whole text, or all its words if they are fewer. Two documents
    link if 100 * intersection >= percent * union; component_id is the smallest doc_id among the
    documents that links reach. Null and empty texts have no set and link with nothing; a null
    doc_id is the smallest of none, so a component without ids has a null one; repeated rows,
    and rows of one id, are documents of their own; other columns are not read; an empty table
    gives no rows. ``docs`` should be a table or another deterministic plan.

    1. The shingles of all documents are counted by hash, and each document learns how many
       documents have each of its own (``ngram_counts``). One of which less than percent/100 are
       repeated links with nothing. The others keep the repeated shingles, rarest first.
    2. Equal sets become one. By the prefix filter, sets that link share one of their first
       shingles: these join sets into groups, by connected components.
    3. ``search_groups`` finds the links in them, by T-occurrence search. No task emits pairs.

    Shingles are told apart by 58 bits of hash. Ids are whole numbers, as such or as text; any
    other text raises CAST_INVALID_INPUT.
    """
    table = cut(with_totals(docs, doc_id, text, shingle_sets(shingle), 1 / 6, _assemble(percent), DOCUMENT))  # a word has about six bytes
    sets = ["n", "h1", "h2"]
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    reps = table.where(F.col("tokens").isNotNull()).groupBy(*sets).agg(F.min(F.struct("rid", "tokens")).alias("x"), F.min(lead).alias("first"))
    reps = cut(reps.select(*sets, "first", "x.*"))
    posted = cut(reps.select("rid", "n", "tokens").mapInArrow(_prefixes(percent), "key long, rid long"))
    heads = cut(posted.groupBy("key").agg(F.min("rid").alias("lead"), F.count("*").alias("k")).where("k > 1").drop("k"))
    edges = posted.join(heads, "key").where("rid <> lead").select(F.col("rid").alias("a"), F.col("lead").alias("b"))
    linked = settle(lambda: search_groups(reps, connected_components(edges), posted, percent))
    named = reps.join(linked, F.col("rid") == F.col("member"), "left").select(*sets, "first", F.coalesce("least", "rid").alias("least"))
    named = cut(named)
    smallest = named.groupBy("least").agg(F.min("first").alias("lead"))
    classes = cut(named.join(smallest, "least").select(*sets, F.col("lead.doc_id").alias("component_id"), F.col("lead.rid").alias("first_row")))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("rid").alias("row"), "first_row"]
    alone = table.where(F.col("tokens").isNull()).withColumns({"component_id": F.col("doc_id"), "first_row": F.col("rid")}).select(*out)
    return alone.unionByName(table.where(F.col("tokens").isNotNull()).join(classes, sets).select(*out))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The documents, with their own columns, but of each component only the one of the smallest id.

    Of equal ids, and of rows without one, which come last, the first row stays. Documents without
    words, null and empty ones included, are linked with nothing and stay, each by itself. An empty
    table gives no rows; long texts are compared whole.
    """
    keep = cut(jaccard_components(docs, **kw).where("row = first_row").select(F.col("row").alias("number")))
    marked = docs.select(whole(docs).alias("row"), F.monotonically_increasing_id().alias("number"))
    return unpacked(marked.join(keep.hint("merge"), "number", "left_semi"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM i
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
