"""Quality classification of documents by interpolated modified Kneser-Ney models of trusted text.

The models count 4-grams of UTF-16 code units, an open alphabet, over all trusted texts: any script has letters of its
own, and the tables grow with the text. Counts are summed per n-gram shard; lower orders are continuation counts;
totals and discounts per context and the probabilities of the lower order reach an n-gram by joins on its shard. The
models stay in stored tables, one pair per order; nothing of them is on the driver or sent to all tasks.

A model finds the texts it was trained on more likely than others. So there are two models, each of one half of the
trusted texts (by a hash of the text, copies together), side by side in the same tables under a column ``side``, and
every document, trusted or not, is scored by the model of the other half: no text is judged by a model that has seen it,
and limits and scores mean the same.

Documents are scored by joins too. They are written into blocks of whole rows (``BLOCK_BYTES`` of text, a longer text
alone), one file each in the shared folder, under names of their own per task attempt; only blocks that a finished task
has reported are read. A block asks once for each different n-gram in it, the different n-grams of all blocks are joined
to probabilities and backoffs order by order, and the answers go to the task that reads the block's file, where the
logarithms are summed per document. So n-grams are shuffled, texts are not. A block's rows and questions are bounded, and
a key of the joins over different n-grams has at most 65,536 rows, one per code unit; so no key is hot, however often a
text or a word stands in the corpus. Files are opened by URI through Arrow's file systems.

A document's perplexity counts ``PRIOR`` further characters at the mean of its language's trusted texts, so that a few
words alone are no reason to reject. It is rejected above the ``quantile`` of the perplexities of its language's trusted
documents times ``slack``, and below the ``floor`` quantile divided by ``slack``: a text that is far more likely than any
prose repeats itself. A language without trusted documents goes by all of them. If all trusted texts fall into one half,
its model scores everything. Null and empty texts hold nothing to score and are rejected. Without any trusted text nothing
else is rejected. Null languages are one language. Repeated rows are scored each by itself. An empty table gives no rows. A
U+0000 counts as the border of a text. Input columns named perplexity and kept are replaced; all others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm.batches import slices
from caseweave.session import fresh_path, release, stage

ORDER, BITS = 4, 16
SIZE = 1 << BITS
PRIOR = 100
#: Bytes of text in a block of documents (a longer text is a block of its own), and code units looked at at once.
BLOCK_BYTES, CHUNK = 16 << 20, 1 << 20
#: Ids of trusted documents that are sent to all tasks; beyond, documents and labels are joined by a shuffle.
SENT_IDS = 1_000_000

Model = list[tuple[DataFrame, DataFrame]]


def grams(text: str) -> Iterator[np.ndarray]:
    """The 4-grams that end at each code unit of a text and at its end, as numbers, in parts of at most CHUNK."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    codes = np.zeros(len(units) + ORDER, np.uint16)
    codes[ORDER - 1 : -1] = units
    for start in range(0, len(units) + 1, CHUNK):
        part = codes[start : start + CHUNK + ORDER - 1].astype(np.uint64)
        n = len(part) - ORDER + 1
        whole = part[:n] << np.uint64(3 * BITS)
        for k in range(1, ORDER):
            whole |= part[k : k + n] << np.uint64((ORDER - 1 - k) * BITS)
        yield whole.view(np.int64)


def side_of(df: DataFrame) -> Column:
    """The model that a row belongs to; frames without that column have one model."""
    return F.col("side") if "side" in df.columns else F.lit(0).cast("byte").alias("side")


def found_by_side(part: pa.RecordBatch, text: str, side: str | None) -> dict[int, np.ndarray]:
    """The 4-grams of a slice of rows per side (0 without such a column)."""
    texts = part.column(part.schema.get_field_index(text)).to_pylist()
    sides = part.column(part.schema.get_field_index(side)).to_pylist() if side else [0] * len(texts)
    found: dict[int, list] = {}
    for t, k in zip(texts, sides, strict=True):
        if t:
            found.setdefault(k, []).extend(grams(t))
    return {k: np.concatenate(v) for k, v in found.items()}


def count_grams(texts: DataFrame) -> DataFrame:
    """(side, gram, n): the 4-grams of all texts of a frame (side, text); tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for side, found in found_by_side(part, "text", "side").items():
                    at, gram = pd.factorize(found)
                    sides = pa.array(np.full(len(gram), side, np.int8))
                    yield pa.RecordBatch.from_arrays([sides, pa.array(gram), pa.array(np.bincount(at))], names=["side", "gram", "n"])

    return texts.select("side", "text").mapInArrow(run, "side byte, gram long, n long").groupBy("side", "gram").agg(F.sum("n").alias("n"))


def context_of(gram: str = "gram") -> Column:
    """An n-gram without its last unit."""
    return F.shiftrightunsigned(gram, BITS)


def suffix_of(order: int, gram: str = "gram") -> Column:
    """An n-gram of that order without its first unit."""
    return F.col(gram).bitwiseAND(F.lit((1 << (order - 1) * BITS) - 1))


def discounts(counts: DataFrame) -> Column:
    """What is taken off a count, after the counts of counts of its model; one small row per model."""
    kinds = counts.groupBy("side").agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).collect()
    out = F.lit(0.0)
    for side, *k in kinds:
        y = k[0] / max(1, k[0] + 2 * k[1])
        d = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.0), float(i)) if k[i - 1] else 0.5 * i for i in (1, 2, 3)]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        out = F.when(F.col("side") == side, off).otherwise(out)
    return out


def kneser_ney(counts: DataFrame) -> Model:
    """Per order the stored tables (side, gram, p) and (side, context, backoff) of the interpolated models of (side, gram, n).

    ``counts`` is read several times; hand in a stored table.
    """
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # how many different units precede each
        orders[order] = stage(orders[order + 1].groupBy("side", suffix_of(order + 1).alias("gram")).agg(F.count("*").alias("n")))
    model: Model = []
    for order in range(1, ORDER + 1):
        with_off = orders[order].select("side", "gram", "n", context_of().alias("context"), discounts(orders[order]).alias("off"))
        contexts = stage(with_off.groupBy("side", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("backoff")))
        rows = with_off.join(contexts, ["side", "context"])
        if model:
            below = model[-1][0].select("side", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", suffix_of(order)).join(below, ["side", "suffix"])
        else:
            rows = rows.withColumn("below", F.lit(1.0 / SIZE))
        p = ((F.col("n") - F.col("off")) / F.col("total") + F.col("backoff") * F.col("below")).alias("p")
        model.append((stage(rows.select("side", "gram", p)), contexts.select("side", "context", "backoff")))
    release(*[orders[k] for k in range(1, ORDER)])
    return model


def train(trusted: DataFrame, text: str = "text") -> Model:
    """The stored models of all trusted texts, one per value of their column ``side`` (one in all without it)."""
    counts = stage(count_grams(trusted.select(side_of(trusted), F.col(text).alias("text"))))
    model = kneser_ney(counts)
    release(counts)
    return model


def sides_of(model: Model) -> list[int]:
    """The models that have seen any text; the lowest order has one context each."""
    return sorted(r[0] for r in model[0][1].select("side").collect())


def probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """(side, gram, p) of the different 4-grams of a stored frame (side, gram), seen in training or not."""
    asked = {ORDER: wanted.select(side_of(wanted), "gram")}
    for order in range(ORDER - 1, 0, -1):
        asked[order] = asked[order + 1].select("side", suffix_of(order + 1).alias("gram")).distinct()
    below = None
    for order, (p, contexts) in enumerate(model, 1):
        rows = asked[order].join(p.withColumnRenamed("p", "seen"), ["side", "gram"], "left")
        rows = rows.withColumn("context", context_of()).join(contexts, ["side", "context"], "left")
        if below is None:
            rows = rows.withColumn("below", F.lit(1.0 / SIZE))
        else:
            rows = rows.withColumn("suffix", suffix_of(order)).join(below.select("side", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["side", "suffix"])
        below = rows.select("side", "gram", F.coalesce("seen", F.coalesce("backoff", F.lit(1.0)) * F.col("below")).alias("p"))
    return below


def blocks(docs: DataFrame, text: str) -> DataFrame:
    """The stored table (block, path): whole rows of ``docs`` in compressed Arrow files, each named by its task and place."""
    folder, schema = fresh_path(docs.sparkSession, "blocks"), "block long, path string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text):
                more = part.column(part.schema.get_field_index(text)).nbytes
                if held and size + more > BLOCK_BYTES:
                    yield written(held, name)
                    held, size, name = [], 0, name + 1
                held.append(part)
                size += more
        if held:
            yield written(held, name)

    def written(parts: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        files, path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.arrow")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        with files.open_output_stream(path, compression=None) as sink, pa.ipc.new_stream(sink, parts[0].schema, options=options) as out:
            for part in parts:
                out.write_batch(part)
        place = f"{folder}/{path.rpartition('/')[2]}"
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([place])], names=["block", "path"])

    return stage(docs.mapInArrow(run, schema))


def block_rows(place: str) -> Iterator[pa.RecordBatch]:
    """The rows of a block, in slices."""
    files, path = fs.FileSystem.from_uri(place)
    with files.open_input_stream(path, compression=None) as source, pa.ipc.open_stream(source) as parts:
        yield from parts


def dealt(frame: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt over the tasks by block; a count given here is kept, however few bytes the rows have."""
    return frame.repartition(tasks, "block")


def questions(named: DataFrame, text: str, side: str | None) -> DataFrame:
    """(side, gram, block): the different 4-grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, place in zip(*(batch.column(k).to_pylist() for k in ("block", "path")), strict=True):
                found: dict[int, list] = {}
                for part in block_rows(place):
                    for k, here in found_by_side(part, text, side).items():
                        found.setdefault(k, []).append(pd.unique(here))
                for k, here in found.items():
                    gram = np.sort(pd.unique(np.concatenate(here)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), k, np.int8)), pa.array(gram), pa.array(np.full(len(gram), name, np.int64))], names=["side", "gram", "block"]
                    )

    return named.mapInArrow(run, "side byte, gram long, block long")


def losses(named: DataFrame, tasks: int, model: Model, text: str, side: str | None, carried: T.StructType) -> DataFrame:
    """The stored table (block, place, nll, n_predicted, carried columns): a row per document of the blocks, without its text."""
    asked = stage(questions(dealt(named, tasks), text, side))
    wanted = stage(asked.select("side", "gram").distinct())
    answers = asked.join(probabilities(wanted, model), ["side", "gram"]).select("block", "side", "gram", F.log("p").cast("float").alias("log_p"))
    long = T.LongType()
    made = [T.StructField("block", long), T.StructField("place", long), T.StructField("nll", T.DoubleType()), T.StructField("n_predicted", long)]
    schema = T.StructType([*made, *carried.fields])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        number, gram, value = (known.column(c).to_numpy() for c in ("side", "gram", "log_p"))
        tables = {k: (pd.Index(gram[number == k]), value[number == k]) for k in np.unique(number)}
        out, place = [], 0
        for name, path in zip(rows.column("block").to_pylist(), rows.column("path").to_pylist(), strict=True):
            for part in block_rows(path):
                size, columns = part.num_rows, dict(zip(part.schema.names, part.columns, strict=True))
                nll, n = np.zeros(size), np.zeros(size, np.int64)
                sides = columns[side].to_pylist() if side else [0] * size
                for i, t in enumerate(columns[text].to_pylist()):
                    for found in grams(t) if t else ():
                        index, value = tables[sides[i]]
                        at = index.get_indexer(found)
                        if (at < 0).any():
                            raise RuntimeError("a block met answers that aren't its own")
                        nll[i] -= value[at].sum(dtype=np.float64)
                        n[i] += len(found)
                places = np.arange(place, place + size)
                place += size
                arrays = [pa.array(np.full(size, name, np.int64)), pa.array(places), pa.array(nll), pa.array(n), *[columns[f.name] for f in carried.fields]]
                out.append(pa.RecordBatch.from_arrays(arrays, names=schema.names))
        return pa.Table.from_batches(out)

    scored = stage(dealt(named, tasks).groupBy("block").cogroup(dealt(answers, tasks).groupBy("block")).applyInArrow(run, schema))
    release(asked, wanted)
    return scored


def attached(named: DataFrame, tasks: int, scored: DataFrame, docs: T.StructType) -> DataFrame:
    """The documents of the blocks, read again, beside their losses."""
    schema = T.StructType([*docs.fields, T.StructField("nll", T.DoubleType()), T.StructField("n_predicted", T.LongType())])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = found.sort_by("place")
        out, at = [], 0
        for path in rows.column("path").to_pylist():
            for part in block_rows(path):
                here = order.slice(at, part.num_rows)
                at += part.num_rows
                out.append(pa.Table.from_arrays([*part.columns, here.column("nll"), here.column("n_predicted")], names=schema.names))
        return pa.concat_tables(out)

    narrow = scored.select("block", "place", "nll", "n_predicted")
    return dealt(named, tasks).groupBy("block").cogroup(dealt(narrow, tasks).groupBy("block")).applyInArrow(run, schema)


def scored_blocks(docs: DataFrame, model: Model, text: str, side: str | None, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents with ``nll`` and ``n_predicted``, and the stored narrow table behind them with the ``carried`` columns."""
    named = blocks(docs, text)
    tasks = max(1, min(named.count(), 4 * docs.sparkSession.sparkContext.defaultParallelism))
    scored = losses(named, tasks, model, text, side, T.StructType([docs.schema[c] for c in carried]))
    return attached(named, tasks, scored, docs.schema), scored


def score(docs: DataFrame, model: Model, text: str = "text", side: str | None = None) -> DataFrame:
    """``docs`` with ``nll`` (double, negative log-likelihood of the whole text) and ``n_predicted`` (long, code units and the end).

    ``side`` names the column (byte) that tells which model scores a row. Columns of the two names are replaced.
    """
    return scored_blocks(docs.drop("nll", "n_predicted"), model, text, side, [])[0]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id): the ids of documents labelled good and not toxic; sent to all tasks if they are few."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    ids = stage(good.select(F.col("doc_id").alias("trusted_id")).distinct())
    return F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids


def trusted_rows(docs: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """The documents labelled good and not toxic."""
    return docs.join(trusted_ids(labels), F.col(doc_id) == F.col("trusted_id"), "left_semi")


def thresholds(scored: DataFrame, quantile: float, floor: float, slack: float) -> dict:
    """Per language (the key None for all others) the mean loss per unit and the lowest and highest perplexity that is kept.

    ``scored`` is a stored table with lang, nll and n_predicted of trusted documents.
    """
    per_lang = {r[0]: r[1] for r in scored.groupBy("lang").agg(F.sum("nll") / F.sum("n_predicted")).filter("lang is not null").toLocalIterator()}
    (whole,) = scored.agg(F.sum("nll") / F.sum("n_predicted")).first()
    if whole is None:
        return {}
    means = {**per_lang, None: whole}
    cut = F.percentile_approx(perplexity(means), F.array(F.lit(floor), F.lit(quantile)), 100_000)
    cuts = {r[0]: r[1] for r in scored.groupBy("lang").agg(cut).filter("lang is not null").toLocalIterator()} | {None: scored.agg(cut).first()[0]}
    return {k: (means[k], cuts[k][0] / slack, cuts[k][1] * slack) for k in means}


def by_language(values: dict, lang: str = "lang") -> Column:
    """The value of a row's language, that of None elsewhere."""
    out = F.lit(values[None])
    named = [F.lit(x) for k, v in values.items() if k is not None for x in (k, v)]
    return F.coalesce(F.create_map(*named)[F.col(lang)], out) if named else out


def perplexity(means: dict, lang: str = "lang") -> Column:
    """Perplexity with PRIOR further units at the mean of the language."""
    return F.exp((F.col("nll") + PRIOR * by_language(means, lang)) / (F.col("n_predicted") + PRIOR))


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, floor: float = 0.0005,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``docs`` with ``perplexity`` (double) and ``kept`` (boolean) after training on the documents that ``labels`` trust."""
    docs = docs.drop("perplexity", "kept")
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    doc_id, text, lang = names[doc_id], names[text], names[lang]
    inner = docs.toDF(*names.values())
    half = F.pmod(F.xxhash64(text), F.lit(2)).cast("byte")
    model = train(trusted_rows(inner, labels, doc_id).select(F.col(text).alias("text"), half.alias("side")))
    if not (sides := sides_of(model)):
        filled = F.coalesce(F.octet_length(text) > 0, F.lit(False))
        return inner.select("*", F.lit(None).cast("double"), filled).toDF(*docs.columns, "perplexity", "kept")
    other = F.lit(1).cast("byte") - half if len(sides) == 2 else F.lit(sides[0])
    flagged = inner.join(trusted_ids(labels), F.col(doc_id) == F.col("trusted_id"), "left")
    flagged = flagged.select(*inner.columns, F.isnotnull("trusted_id").alias("trusted"), F.coalesce(other, F.lit(sides[0])).cast("byte").alias("side"))
    scored, narrow = scored_blocks(flagged, model, text, "side", ["trusted", lang])
    trusted = narrow.filter("trusted and n_predicted > 0").select(F.col(lang).alias("lang"), "nll", "n_predicted")
    cuts = thresholds(trusted, quantile, floor, slack)
    release(*[t for pair in model for t in pair])
    mean, low, high = ({k: v[i] for k, v in cuts.items()} for i in range(3))
    filled = F.col("n_predicted") > 0
    scored = scored.withColumn("perplexity", F.when(filled, perplexity(mean, lang)))
    kept = filled & F.col("perplexity").between(by_language(low, lang), by_language(high, lang))
    return scored.select(*inner.columns, "perplexity", kept).toDF(*docs.columns, "perplexity", "kept")
