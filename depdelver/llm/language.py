"""Language identification by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depdelver.llm.rows import column, whole
from depdelver.llm.textops import BLOCK, as_bytes, slices
from depdelver.session import cut

#: Labelled rows on which the text model is fitted, about; the only bounded sample. Rows that a
#: label has in it at least, if there are so many.
LABELLED = 4000
LEAST_LABELLED = 20
BITS = 16
#: Weight of the level above, in rows, when a host's or a suffix's languages are counted.
KAPPA = 10.0
#: How often a declared language is right, before any are counted, and the weight of that, in rows.
DECLARED_RIGHT, DECLARED_WEIGHT = 0.9, 20.0
#: Documents whose best language is less likely than this are rejected.
LEAST = 0.5
#: A text is in none of the languages if its mean log-likelihood is below its language's floor. The
#: floor lies midway between a usual labelled text's and that of trigrams never seen, or lower by this
#: share of the labelled texts; standard errors by which a short text may be lower.
OUTLIERS, SLACK = 0.01, 3.0
#: Bytes of hosts' priors that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def gram_blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the texts' byte trigrams, hashed: the text of each and its number.

    Letters are folded, all else is a space, trigrams without a letter are left out; a text
    starts and ends with a space. A long text comes in several blocks, which overlap by two bytes.
    """

    def block(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        b = _FOLD[np.frombuffer(b"".join(x for _, x in parts), np.uint8)].astype(np.uint32)
        doc = np.repeat([i for i, _ in parts], [len(x) for _, x in parts])
        letters = b != 0x20
        keep = (doc[2:] == doc[:-2]) & (letters[2:] | letters[1:-1] | letters[:-2])
        gram = ((b[:-2] * np.uint32(0x10001) + b[1:-1]) * np.uint32(0x9E3779B1) + b[2:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        return doc[:-2][keep], gram[keep].astype(np.int64)

    parts, size = [], 0
    for i, text in enumerate(texts):
        text = b" " + (text or b"") + b" "
        for at in range(0, max(1, len(text) - 2), BLOCK):
            if parts and size + min(len(text), BLOCK) > BLOCK:
                yield block(parts)
                parts, size = [], 0
            parts.append((i, text[at : at + BLOCK + 2]))
            size += len(parts[-1][1])
    if parts:
        yield block(parts)


@dataclass
class Model:
    """Languages and, for each, the logarithm of every trigram's probability; the least mean of it
    in a text of the language, and its standard deviation (none: all texts are in the languages)."""

    languages: list[str]
    logs: np.ndarray
    floors: np.ndarray | None = None
    spread: np.ndarray | None = None

    def fits(self, n: np.ndarray, ll: np.ndarray) -> np.ndarray:
        """Whether each text can be in each language."""
        if self.floors is None:
            return np.ones(ll.shape, bool)
        n = np.maximum(n, 1)[:, None]
        return ll / n >= self.floors - SLACK * self.spread / np.sqrt(n)

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and its log-likelihood in each language."""
        n, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for doc, gram in gram_blocks(texts):
            n += np.bincount(doc, minlength=len(texts))
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(doc, self.logs[k][gram], minlength=len(texts))
        return n, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        texts, labels = as_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
        for doc, gram in gram_blocks(texts):
            for label in set(labels[np.unique(doc)].tolist()):
                counts.setdefault(label, np.zeros(1 << BITS, np.int64))
                counts[label] += np.bincount(gram[(labels == label)[doc]], minlength=1 << BITS)
    for label, c in counts.items():
        found = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(c[found])], ["label", "gram", "n"])


def _left_out(counts):
    """The mean log-likelihood of each labelled text in its language, as if it were not in the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = counts.value
        total = table.sum(axis=1)
        for batch in slices(batches):
            out = []
            for x, name in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = sum(np.bincount(gram, minlength=1 << BITS) for _, gram in gram_blocks([x]))
                n, at = int(own.sum()), np.flatnonzero(own)
                if n:
                    k = languages.index(name)
                    out.append((name, float((own[at] * np.log((table[k][at] - own[at]) / (total[k] - n))).sum() / n)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64())], ["label", "mean"])

    return run


def quota(counts: list[int], rows: int) -> float:
    """How many rows of each label make ``rows`` together, where a label with fewer gives all."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) >= left:
            return max(LEAST_LABELLED, left / (len(counts) - k))
        left -= n
    return max([LEAST_LABELLED, *counts])


def fit(labelled: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", rows: int = LABELLED) -> Model:
    """A model from about ``rows`` labelled rows, picked by a hash of their id.

    Each label has an equal part of them, or all its rows if these are fewer, so that a language is
    in the model however rare it is. How frequent languages are is counted by ``identify``, over all rows.
    Rows without a label or a text are not used. Counts are made on the executors; a number for
    each language and trigram reaches the driver, and one for each of these rows: how likely its
    text is by the other rows, from which the languages' floors are taken.
    """
    good = labelled.select(column(doc_id).alias("id"), column(text).alias("text"), column(label).alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in good.groupBy("label").count().toLocalIterator()}
    most = quota(list(sizes.values()), rows)
    limits = [x for k, n in sizes.items() if n > most for x in (F.lit(k), F.lit(int(most / n * (1 << 20)) + 1))]
    limit = F.coalesce(F.create_map(*limits)[F.col("label")], F.lit(1 << 20)) if limits else F.lit(1 << 20)
    own = good.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < limit).select("text", "label")
    counts = own.mapInArrow(_count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("label").to_pylist()))
    table = np.full((max(1, len(languages)), 1 << BITS), 0.5)
    at = np.array([languages.index(x) for x in counts.column("label").to_pylist()], np.int64)
    table[at, counts.column("gram").to_numpy()] += counts.column("n").to_numpy()
    share = table / table.sum(axis=1, keepdims=True)
    logs = np.log(share)
    if not languages:
        return Model(["und"], logs)
    means = own.mapInArrow(_left_out(labelled.sparkSession.sparkContext.broadcast((languages, table))), "label string, mean double").toArrow()
    names, means = np.array(means.column("label").to_pylist(), object), means.column("mean").to_numpy()
    # Trigrams as a text has them: what was counted, without the half that each has besides.
    seen = np.where(table > 0.5, table - 0.5, 0)
    seen /= seen.sum(axis=1, keepdims=True)
    spread = np.sqrt(np.maximum((seen * logs**2).sum(axis=1) - (seen * logs).sum(axis=1) ** 2, 0))
    by = [means[names == x] for x in languages]
    floors = np.array([min(np.quantile(m, OUTLIERS), (np.median(m) + logs[k].min()) / 2) for k, m in enumerate(by)])
    return Model(languages, logs, floors, spread)


def _scorer(model, at: int | None):
    """Adds n, ev, the tempered log-likelihoods, and fits, the languages that the text can be in, and
    leaves out the column text. ``at``: the text's place in row, where it is read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, ll = model.value.scores(as_bytes(batch.column("text") if at is None else batch.column("row").field(at)))
            # Trigrams are far from independent: n of them weigh like the root of n.
            ev = ll / np.sqrt(np.maximum(n, 1))[:, None]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * ev.shape[1]), pa.array(ev.ravel()))
            fits = pa.ListArray.from_arrays(cells.offsets, pa.array(model.value.fits(n, ll).ravel()))
            kept = batch.drop_columns(["text"]) if at is None else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n.astype(np.int64)), cells, fits], [*kept.schema.names, "n", "ev", "fits"])

    return run


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def declared_language(markup: Column) -> Column:
    """The primary subtag of the first lang attribute of an html tag, or null."""
    found = F.lower(F.regexp_extract(markup, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def address_suffix(url: Column) -> Column:
    """What follows the last dot of the host, or null."""
    found = F.lower(F.regexp_extract(url, r"(?s)^.*?://(?:[^/?#]*@)?[^/?#:]*\.([^./?#:]+)(?::\d*)?(?:[/?#]|$)", 1))
    return F.when(found != "", found)


def identify(docs: DataFrame, model: Model, *, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None) -> DataFrame:
    """row (all columns, whatever their names), lang, prob and keep.

    The posterior of a language is the product of the text's likelihood (naive Bayes over byte
    trigrams, tempered), of the declared language given this one, and of the host's prior. How
    declarations, suffixes and hosts go with languages is counted over all rows, each with its
    text's posterior: sums by host are smoothed towards those by suffix, and these towards all
    rows'; a row's own share is taken out of its host's sums. A row is kept if it has letters,
    its best language has at least LEAST, and its text is as likely in that language as the model's
    floor asks, so that texts in none of the languages are not kept; ties go to the first language by name.

    Null and empty texts have no evidence: their language is null, and they are not kept. Null
    declarations, suffixes and hosts give none either. Repeated rows count as often as they are
    there. An empty table gives no rows. Texts are read twice and moved only where hosts are so
    many that their priors are joined by a shuffle.
    """
    null = F.lit(None).cast("string")
    names = ["declared", "suffix", "host"]
    # The labels of the model that a declaration can name; all others are one.
    known = lambda c: F.when(c.isNull(), null).when(c.isin(model.languages), c).otherwise("other")
    evidence = [known(declared) if declared is not None else null, suffix if suffix is not None else null, host if host is not None else null]
    own = docs.select(whole(docs).alias("row"), column(text).alias("text"), *[e.alias(k) for k, e in zip(names, evidence, strict=True)])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("n", T.LongType()), T.StructField("ev", T.ArrayType(T.DoubleType())), T.StructField("fits", T.ArrayType(T.BooleanType()))]

    def scored(df: DataFrame) -> DataFrame:
        kept = [f for f in df.schema.fields if f.name != "text"]
        return df.mapInArrow(_scorer(broadcast, None if "text" in df.columns else docs.columns.index(text)), T.StructType([*kept, *added]))

    size = len(model.languages)
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    sums = [F.sum(F.get("p", i)).alias(f"s{i}") for i in range(size)]
    first = scored(own.select("text", *names)).where("n > 0").withColumn("p", softmax(F.col("ev")))
    counts = cut(first.groupBy(*names).agg(*sums, F.count("*").alias("c")))
    total = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    everywhere = counts.agg(*total).head()
    mass = sum(x or 0 for x in everywhere)
    overall = [((x or 0) + 1) / (mass + size) for x in everywhere]
    parts = F.array(*[F.col(f"s{i}") for i in range(size)])
    smooth = lambda p, c, above: F.transform(F.arrays_zip(p.alias("p"), above.alias("q")), lambda x: (x["p"] + KAPPA * x["q"]) / (c + KAPPA))
    by_suffix = counts.where("suffix IS NOT NULL").groupBy(F.col("suffix").alias("of_suffix")).agg(*total, F.sum("c").alias("c"))
    by_suffix = cut(by_suffix.select("of_suffix", smooth(parts, F.col("c"), lit(overall)).alias("suffix_prior")))
    by_host = counts.where("host IS NOT NULL").groupBy(F.col("host").alias("of_host")).agg(*total, F.sum("c").alias("host_rows"))
    by_host = cut(by_host.select("of_host", parts.alias("host_sums"), "host_rows"))
    # At most one row for each language and one for all others.
    said = {r["declared"]: [x or 0 for x in r[1:]] for r in counts.where("declared IS NOT NULL").groupBy("declared").agg(*total).collect()}
    spoken = [sum(x[i] for x in said.values()) for i in range(size)]

    def log_declared(d: str) -> list[float]:
        before = [DECLARED_RIGHT if d == k else (1 - DECLARED_RIGHT) / size for k in model.languages]
        return [float(np.log((said[d][i] + DECLARED_WEIGHT * before[i]) / (spoken[i] + DECLARED_WEIGHT))) for i in range(size)]

    claims = F.create_map(*[x for d in said for x in (F.lit(d), lit(log_declared(d)))]) if said else None
    claim = F.coalesce(claims[F.col("declared")], lit([0] * size)) if said else lit([0] * size)

    def few(df: DataFrame, key: str) -> DataFrame:
        """Sent to every executor if its names and its 8 bytes a language are found to be small."""
        bytes_ = df.agg(F.coalesce(F.sum(F.octet_length(key) + 8 * size + 32), F.lit(0))).head()[0]
        return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df

    out = scored(own.drop("text")).join(few(by_suffix, "of_suffix"), F.col("suffix") == F.col("of_suffix"), "left")
    out = out.join(few(by_host, "of_host"), F.col("host") == F.col("of_host"), "left")
    above = F.coalesce("suffix_prior", lit(overall))
    rest = F.transform(F.arrays_zip(F.col("host_sums").alias("p"), softmax(F.col("ev")).alias("q")), lambda x: F.greatest(x["p"] - x["q"], F.lit(0.0)))
    prior = F.when(F.col("host_sums").isNull(), above).otherwise(smooth(rest, F.col("host_rows") - 1, above))
    fused = F.transform(F.arrays_zip(F.col("ev").alias("t"), claim.alias("d"), prior.alias("h")), lambda x: x["t"] + x["d"] + F.log(x["h"]))
    out = out.withColumn("post", F.when(F.col("n") > 0, softmax(fused)))
    best = F.array_max("post")
    place = (F.array_position("post", best) - 1).cast("int")
    lang = F.get(F.array(*[F.lit(x) for x in model.languages]), place)
    return out.select("row", lang.alias("lang"), best.alias("prob"), F.coalesce((best >= LEAST) & F.get("fits", place), F.lit(False)).alias("keep"))


def of_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``identify`` on documents: text, markup inside it, and the source as the host.

    Nulls in any column, texts without letters, ties, repeated rows and empty tables as ``identify`` has
    them; null and empty texts have no language and are not kept.
    """
    return identify(docs, fit(labelled), declared=declared_language(column("text")), host=column("source"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Of every document; the labels train the text model and are evidence for no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = of_documents(docs.select("doc_id", "text", "source"), docs)
    return marked.select("row.doc_id", "lang", "prob", "keep")


def page_language(spark, sf_dir: str) -> DataFrame:
    """Of every page: its visible text, declared language, address suffix and host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://(?:[^/?#]*@)?([^/?#:]*)", 1))
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = pages.select("page_id", "url", "html", plain.alias("text"))
    marked = identify(rows, model, declared=declared_language(F.col("html")), suffix=address_suffix(F.col("url")), host=F.when(host != "", host))
    return marked.select("row.page_id", "lang", "prob", "keep")
