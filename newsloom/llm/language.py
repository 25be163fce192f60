"""Language identification by averaged hashed subword embeddings with calibrated rejection.

The model is fitted on a bounded sample of documents whose language is known (``sample`` per
language at most, chosen by a hash of id and text) and then travels with the scoring function: its size
depends on the number of hash buckets and languages only. Scoring is one pass over whole texts.

A text is rejected for either of two measures: its confidence (the greatest probability), which is low
when it is like several languages, and its usualness (mean log share of its n-grams among all learned
languages), which is low when it is like none. Each has a cut per length class, calibrated on set-aside
texts and their beginnings.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.subwords import Grams, Model, logits_sizes, raw_logits, shares, softmax, text_features, train
from newsloom.llm.texts import free_name
from newsloom.plans.staging import staged

GRAMS = Grams(orders=(2, 3, 4), bits=15, letters_only=True)
SAMPLE = 800
MOST_LANGUAGES = 200
UNKNOWN = "und"
LENGTHS = 24
BEGINNINGS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)
LEAST_PIECES = 20
UNSEEN = 0.01


class Identifier(NamedTuple):
    """Languages in code point order, the model, and the least confidence and usualness of a text.

    The model's last column is the log share of each bucket. Cuts are per length class, or one for all.
    """

    languages: list[str]
    model: Model | None
    least: np.ndarray | float
    least_usual: np.ndarray | float


def _share_features(frame: DataFrame, text: str, keep: list[str], grams: Grams) -> DataFrame:
    """The kept columns with bucket ids (32 bits each) and counts (16 bits each) as bytes."""

    def spread(batches):
        for batch in batches:
            found = list(text_features(batch.column(text), grams))
            columns = [batch.column(k) for k in keep]
            columns += [pa.array([part[k].tobytes() for part in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "counts"])

    types = dict(frame.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keep)
    return frame.select(text, *keep).mapInArrow(spread, f"{fields}, ids binary, counts binary")


def sample_features(sample: DataFrame, text: str, label: str, grams: Grams) -> tuple[list, list]:
    """Features and labels of a bounded sample, brought to the driver in a fixed order.

    Features hold at most ``2**grams.bits`` entries a text, however long it is.
    """
    rows = _share_features(sample, text, ["doc_id", label], grams).toArrow()
    order = sorted(range(len(rows)), key=lambda i, k=rows["doc_id"], v=rows[label]: (str(k[i]), str(v[i])))
    ids, counts = rows["ids"], rows["counts"]
    features = [
        (np.frombuffer(ids[i].as_buffer(), np.int32), np.frombuffer(counts[i].as_buffer(), np.uint16))
        for i in order
    ]
    labels = rows[label].to_pylist()
    return features, [labels[i] for i in order]


def _length_class(sizes: np.ndarray) -> np.ndarray:
    """Doublings of the number of n-grams."""
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), LENGTHS - 1)


def _cuts(values: np.ndarray, kinds: np.ndarray, share: float) -> np.ndarray:
    """For each length class the value that all but ``share`` of such texts reach.

    A sample too small to show that share has its least value lowered by how far the tail goes on, taken
    as exponential from the lowest hundredth on (or the lowest two values). A class of few texts has the
    cut of the next shorter class, or else of the next longer one; without any there is no cut.
    """
    cuts = np.full(LENGTHS, np.nan)
    for kind in range(LENGTHS):
        found = np.sort(values[kinds == kind])
        if len(found) < LEAST_PIECES:
            continue
        cuts[kind] = np.quantile(found, share)
        if share * len(found) < 1:
            near = max(1, len(found) // 100)
            unseen = np.log(1 / (share * len(found))) / np.log(near + 1)
            cuts[kind] = found[0] - unseen * (found[near] - found[0])
    known = np.flatnonzero(~np.isnan(cuts))
    if not len(known):
        return np.full(LENGTHS, -np.inf)
    at = np.searchsorted(known, np.arange(LENGTHS), side="right") - 1
    return cuts[known[np.maximum(at, 0)]]


def _bound(sample: int, rows: int) -> int:
    """A hash below which lie at least ``sample`` of about ``rows`` hashes, and not many more.

    The margin is six deviations of the draw and a tenth, five deviations of the counted rows.
    """
    share = (1.1 * sample + 6 * sample**0.5 + 50) / max(rows, 1)
    return min(int(-(2**63) + share * 2**64), 2**63 - 1)


def fit(
    training: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample: int = SAMPLE,
    rejected: float = 0.0005,
    grams: Grams = GRAMS,
) -> Identifier:
    """An identifier fitted on at most ``sample`` documents of each language.

    About one document in five of the sample is set aside to calibrate: the scale of the logits that
    makes the probabilities fit best and, for each length class, the confidence and the usualness that
    all but a share ``rejected`` of the texts and their ``BEGINNINGS`` reach (confidence: of the
    rightly identified ones). Rows without text or language teach nothing; without any row there is no
    language to predict.
    """
    known = training.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    # Rows equal in id and text count once, so that no repeated id can fill the sample or exceed it.
    keyed = known.withColumn("at", F.xxhash64("doc_id", "text", F.lit(8)))
    about = F.approx_count_distinct("at", 0.02).alias("n")
    counts = keyed.groupBy("lang").agg(about).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is {lang} a language column?")
    languages = sorted(row.lang for row in counts)
    if not languages:
        return Identifier([], None, 0.0, 0.0)
    # The hashes are even, so a little more than a sample of each language lies below its bound, and only
    # those rows meet to be ranked.
    bounds = training.sparkSession.createDataFrame(
        [(row.lang, _bound(sample, row.n)) for row in counts], "lang string, bound long"
    )
    near = keyed.select("lang", "at").join(F.broadcast(bounds), "lang").filter(F.col("at") <= F.col("bound"))
    first = Window.partitionBy("lang").orderBy("at")
    ranked = near.select("lang", "at").distinct().withColumn("rank", F.row_number().over(first))
    cuts = ranked.filter(F.col("rank") <= sample).groupBy("lang").agg(F.max("at").alias("cut"))
    # At most MOST_LANGUAGES rows.
    chosen = keyed.join(F.broadcast(cuts), "lang").filter(F.col("at") <= F.col("cut"))
    sampled = chosen.groupBy("lang", "at").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    # The label begins with 1 for the texts set aside.
    tagged = F.concat(F.expr("IF(pmod(at, 5) = 4, '1', '0')"), F.col("lang"))
    sampled = staged(sampled.select("doc_id", "text", tagged.alias("label")))
    features, labels = sample_features(sampled, "text", "label", grams)
    classes = np.array([languages.index(x[1:]) for x in labels], dtype=np.int64)
    aside = np.array([x[0] == "1" for x in labels], dtype=bool)
    if aside.all():
        aside[:] = False
    learned = [f for f, a in zip(features, aside, strict=True) if not a]
    fitted = train(learned, classes[~aside], len(languages), grams)
    share = np.full(1 << grams.bits, UNSEEN)
    for ids, found in learned:
        share[ids] += shares(found, grams)
    usual = np.log(share / share.sum())[:, None].astype(np.float32)
    # The log shares join the model as a column, so that one pass over a text finds both measures.
    fitted = fitted._replace(table=np.hstack([fitted.table, usual]), bias=np.append(fitted.bias, 0.0))
    true = classes[aside]
    if not len(true):
        return Identifier(languages, fitted, 0.0, -np.inf)
    whole = [f for f, a in zip(features, aside, strict=True) if a]
    raw = raw_logits(whole, fitted)[:, :-1]
    at = np.arange(len(true))
    scales = 2.0 ** np.arange(-3, 4, 0.5)
    losses = [-np.log(softmax(raw * s)[at, true] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(losses))])
    spans = F.array(*[F.lit(n) for n in BEGINNINGS])
    pieces = sampled.filter("label LIKE '1%'").withColumn("n", F.explode(spans)).filter(F.length("text") > F.col("n"))
    pieces = pieces.select("label", F.col("text").substr(F.lit(1), F.col("n")).alias("text"))
    begun = _share_features(pieces, "text", ["label"], grams).toArrow().to_pylist()
    parts = whole + [
        (np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.uint16)) for r in begun
    ]
    true = np.append(true, np.array([languages.index(r["label"][1:]) for r in begun], dtype=np.int64))
    sizes = np.array([int(found.sum(dtype=np.int64)) for _, found in parts])
    values = raw_logits(parts, fitted)
    sure, kinds = softmax(values[:, :-1] * scale), _length_class(sizes)
    right = (sure.argmax(1) == true) & (sizes > 0)
    # A longer text may be of several languages: it need not be surer than a shorter one.
    least = np.minimum.accumulate(_cuts(sure.max(1)[right], kinds[right], rejected))
    least_usual = _cuts(values[sizes > 0, -1], kinds[sizes > 0], rejected)
    return Identifier(languages, fitted._replace(scale=scale), least, least_usual)


def identified(text: Column, found: Identifier) -> Column:
    """Struct of ``lang``, ``score`` (0 to 1) and ``rejected``; any text has one.

    A null text and a text without a letter are ``und`` with score 0 and are rejected, and so is
    everything when no language was learned. Ties go to the first language in code point order.
    """
    languages, model, least, least_usual = found
    if model is None:
        return F.struct(
            F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        )

    cuts = [np.broadcast_to(np.asarray(x, np.float64), LENGTHS) for x in (least, least_usual)]

    @F.arrow_udf("struct<at int, score double, rejected boolean>")
    def best(texts: pa.Array) -> pa.Array:
        values, sizes = logits_sizes(texts, model)
        sure, kinds = softmax(values[:, :-1]), _length_class(sizes)
        usual = values[:, -1] / model.scale
        low = usual < cuts[1][kinds]
        # A text that repeats itself is no surer sign than what it repeats.
        at = np.flatnonzero(low)
        if len(at):
            distinct = np.array([len(ids) for ids, _ in text_features(texts.take(pa.array(at)), model.grams)])
            low[at] = usual[at] < cuts[1][_length_class(distinct)]
        low |= sure.max(1) < cuts[0][kinds]
        return pa.StructArray.from_arrays(
            [pa.array(sure.argmax(1), pa.int32()), pa.array(sure.max(1), pa.float64()), pa.array(low)],
            ["at", "score", "rejected"],
        )

    def shaped(b: Column) -> Column:
        names = F.array(*[F.lit(x) for x in languages])
        return F.struct(
            F.get(names, b["at"]).alias("lang"), b["score"].alias("score"), b["rejected"].alias("rejected")
        )

    unknown = F.struct(
        F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    )
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    # As an element of an array the model runs once a row.
    scored = F.get(F.transform(F.array(best(text)), shaped), F.lit(0))
    return F.when(has_letter, scored).otherwise(unknown)


def identify(docs: DataFrame, found: Identifier, text: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns with the struct of :func:`identified` added under a free name."""
    return docs.withColumn(free_name(docs.columns, out), identified(F.col(text), found))


def keep_identified(docs: DataFrame, found: Identifier, text: str = "text") -> DataFrame:
    """The rows whose language is recognised, columns as they were."""
    return docs.filter(~identified(F.col(text), found)["rejected"])
