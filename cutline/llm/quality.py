"""Quality by importance resampling over hashed n-grams.

Two generative models of a text, each a bag of hashed one- and two-token n-grams: the target (texts
labelled as good) and the raw corpus (all of it). A document's importance weight is the ratio of its
probabilities under the two. Adding Gumbel noise to the log-weights and taking the k largest draws k
documents without replacement in proportion to their weights. The same weight, per n-gram, with the
cut that best parts a bounded sample of labelled documents, says which documents are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators.positions import positions

from .common import blocks, cut, mixed, runs_hashed, text_hashes

BUCKETS = 1 << 14
#: Labelled rows, at most, that the target and the cut are learnt from (those of the smallest hashed ids).
LABELS = 20_000
#: Weight of a lost good document against that of a junk document that stays, in choosing the cut.
GOOD_WEIGHT = 4.0

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 everything else
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, one text after the other, and how many each has.

    Tokens are runs of letters and digits (lower-cased A-Z) or of other characters; n-grams are single
    tokens and pairs of neighbours; all pairs of equal neighbours are one n-gram.
    """
    buffer = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    kind = _KIND[buffer]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    starts = change[kind[change] > 0]
    stops = np.append(change[1:], len(buffer))[kind[change] > 0]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    one = runs_hashed(buffer)(starts, stops)
    same = of[1:] == of[:-1]
    two = np.where(one[:-1] == one[1:], np.uint64(1), mixed(one[:-1] * np.uint64(0x9FB21C651E98DF25) + one[1:]))[same]
    found, owner = np.concatenate([one, two]), np.concatenate([of, of[1:][same]])
    order = np.argsort(owner, kind="stable")
    return (found[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(texts))


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, most: int) -> DataFrame:
    """(doc_id, text, good): good is null where no sampled label is at hand."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id", "left")


def models(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log-ratio of target and raw probability by bucket, from (doc_id, text, good) of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for rows, texts in blocks(batches, "text"):
            found, sizes = features(texts, buckets)
            raw += np.bincount(found, minlength=buckets)
            good = np.array([x == 1 for x in rows.column("good").to_pylist()], bool)
            target += np.bincount(found[np.repeat(good, sizes)], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)  # nothing is labelled as good: all weights are 0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, good, log_weight, n_features, text_hash) of each row of (doc_id, text, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            found, sizes = features(texts, len(ratio))
            owner = np.repeat(np.arange(len(texts)), sizes)
            weight = np.bincount(owner, ratio[found], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("good").cast(pa.int32()), pa.array(weight, pa.float64()), pa.array(sizes.astype(np.int64)), text_hashes(texts)], ["doc_id", "good", "log_weight", "n_features", "text_hash"])

    return docs.mapInArrow(run, "doc_id long, good int, log_weight double, n_features long, text_hash long")


def best_cut(mean: np.ndarray, good: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The cut (accept at or above it) with the least weighted errors; of equal ones the lowest; -inf if nothing is to be told apart."""
    if not len(mean) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(mean, kind="stable")
    mean, good = mean[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) * good_weight
    stays = (~good).sum() - np.concatenate([[0], np.cumsum(~good)])
    cost = (lost + stays).astype(float)
    cost[1:-1][mean[1:] == mean[:-1]] = np.inf
    at = int(np.argmin(cost))
    if at == 0:
        return float("-inf")
    return float("inf") if at == len(mean) else float((mean[at - 1] + mean[at]) / 2)


def importance(docs: DataFrame, labels: DataFrame, share: float | None = 0.5, seed: int = 42, max_labels: int = LABELS, doc_id: str = "doc_id", text: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, log_weight, n_features, accepted, gumbel_key, sampled, and text_hash if wanted): one row per row of docs.

    log_weight is the log of the importance weight; accepted: its mean per n-gram is at least the cut
    learnt from at most `max_labels` labelled rows; gumbel_key is the weight with Gumbel noise drawn
    from a hash of doc_id and text; sampled marks the given share (rounded to whole rows) of the accepted rows: those with
    the largest keys, ties to the smaller doc_id, then the smaller text_hash; of equal rows as many as are needed, whichever they are.
    With share None nothing is drawn and sampled is null. Texts without tokens (null or empty too) have weight 0. Labels with
    null doc_id or quality are passed over, of several for one doc_id the lowest counts; without
    labels of both kinds every row is accepted. text_hash (XXH64 of the text, seed 42) tells rows of one doc_id apart. Rows with null doc_id are scored like others. An empty
    table gives no rows; other columns are not read.
    """
    rows = _labelled(docs, labels, doc_id, text, max_labels)
    scored = cut(weights(rows, models(rows)))
    known = scored.where("good is not null").orderBy("doc_id", "text_hash").select("log_weight", "n_features", "good").limit(2 * max_labels).toPandas()
    at = best_cut((known["log_weight"] / known["n_features"].clip(lower=1)).to_numpy(float), (known["good"] == 1).to_numpy(bool))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scored = scored.withColumn("accepted", F.col("log_weight") / F.greatest("n_features", F.lit(1)) >= F.lit(at))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    sampled = F.lit(None).cast("boolean")
    if share is not None:
        k = round(share * scored.where("accepted").count())
        scored = positions(scored, [~F.col("accepted"), F.desc("gumbel_key"), "doc_id", "text_hash"], "place")
        sampled = F.col("accepted") & (F.col("place") < k)
    return scored.select("doc_id", "log_weight", "n_features", "accepted", "gumbel_key", sampled.alias("sampled"), *["text_hash"] * text_hash)
