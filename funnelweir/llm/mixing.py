"""Document rates that bring a corpus to target weights of soft domains.

1. A softmax classifier over hashed words learns domains from a labelled table. It is fitted
   on a sample of at most ``max_labelled`` labelled rows, the ones with the smallest hashes.
2. Every document gets posteriors p over the domains and its number of tokens n (words).
3. Rates r >= 0 minimise the squared distance between the expected token totals
   sum(r * n * p) and the targets. Accelerated projected gradient: each iteration is one job
   that sums the totals over all documents; only these few numbers reach the driver.
   A document's rate follows from its own p and the gradients so far, so tasks replay it
   and no state has to be kept, moved or recovered. The start is a rate of 1 everywhere.
4. ``copies`` rounds the rate at random by a hash of the id, so its expectation is the rate.

Targets: ``weights`` are shares of the domains; the domain ``anchor`` keeps ``headroom``
times its expected tokens, which fixes the total.

Null texts have no words: such a document has the posteriors of the class shares and does
not count in the totals. A null id draws one fixed number. Labels that are null are left
out; of several labels of a document the smallest counts. Without labelled rows all
posteriors are equal. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.bpe import Recent
from funnelweir.llm.common import cut, slices

BUCKETS = 1 << 16
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_BUCKET = Recent(lambda word: zlib.crc32(word) % BUCKETS, 40_000)
ADDED = "n_tokens long, posteriors array<double>, rate double, copies long"


@dataclass
class Mixer:
    """What the driver holds: classifier, step, targets and the gradients so far."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    step: float = 0.0
    total: float = 0.0
    targets: np.ndarray | None = None
    gradients: list[np.ndarray] = field(default_factory=list)

    def rates(self, posteriors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps so far, and the point at which the next gradient is taken."""
        rate = np.ones(len(posteriors))
        ahead, pace = rate, 1.0
        for gradient in self.gradients:
            new = np.maximum(0.0, ahead - self.step * (posteriors @ gradient))
            next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead = new + (pace - 1) / next_pace * (new - rate)
            rate, pace = new, next_pace
        return rate, ahead


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_CLEAN).split() if text else []


def buckets(words: list[bytes]) -> np.ndarray:
    """The distinct hashed words of a text."""
    return np.unique(np.fromiter(map(_BUCKET.__getitem__, words), np.int64, len(words)))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def posterior(words: list[bytes], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    if not words:
        return softmax(bias)
    found = buckets(words)
    return softmax(weights[found].sum(axis=0, dtype=np.float64) + bias)


def train(rows: list[tuple[int, np.ndarray]], n_domains: int, steps: int = 120, penalty: float = 2e-4, rate: float = 0.04, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on word presence by Adam on whole batches; the bias starts at the class shares.

    Words of fewer than ``least`` documents of the sample get no weight.
    """
    weights, bias = np.zeros((BUCKETS, n_domains)), np.zeros(n_domains)
    if not rows:
        return weights.astype(np.float32), bias
    label = np.array([r[0] for r in rows])
    wanted = np.eye(n_domains)[label]
    bias = np.log(wanted.mean(axis=0) + 1e-3)
    column = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    common = np.bincount(column, minlength=BUCKETS) >= least
    row, column = row[common[column]], column[common[column]]
    used, place = np.unique(column, return_inverse=True)
    own = np.zeros((len(used), n_domains))
    first, second = np.zeros_like(own), np.zeros_like(own)
    for t in range(1, steps + 1):
        scores = np.stack([np.bincount(row, own[place, k], len(rows)) for k in range(n_domains)], axis=1)
        miss = (softmax(scores + bias) - wanted) / len(rows)
        slope = np.stack([np.bincount(place, miss[row, k], len(used)) for k in range(n_domains)], axis=1) + penalty * own
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        own -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        bias -= 0.1 * miss.sum(axis=0)
    weights[used] = own
    return weights.astype(np.float32), bias


def classifier(docs: DataFrame, labels: DataFrame, domains: list[str], max_labelled: int, id_column: str, text_column: str) -> Mixer:
    """``labels``: (id, domain name). The sample's ids are broadcast: at most ``max_labelled`` rows."""
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    known = labels.select(F.col(id_column).alias("label_id"), index.cast("int").alias("label")).filter("label_id is not null and label >= 0")
    known = known.groupBy("label_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    texts = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "label_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [buckets(words_of(t)).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["label", "found"])

    rows = sorted((r["label"], bytes(r["found"])) for r in texts.mapInArrow(run, "label int, found binary").collect())
    weights, bias = train([(k, np.frombuffer(b, "<i4").astype(np.int64)) for k, b in rows], len(domains))
    return Mixer(domains, weights, bias)


def memberships(docs: DataFrame, mixer: Mixer, id_column: str, text_column: str) -> DataFrame:
    """(id, n, p): tokens and posteriors of every document, one narrow row each."""
    weights, bias = mixer.weights, mixer.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n, p = batch.column(1), [], []
            for i in range(len(texts)):
                words = words_of(texts[i].as_py())
                n.append(len(words))
                p.append(posterior(words, weights, bias))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["id", "n", "p"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n long, p array<double>")


def summed(members: DataFrame, mixer: Mixer, products: bool = False) -> np.ndarray:
    """Totals over all documents of y * n * p at the current point, or of n * p p' if asked for."""
    k = len(mixer.domains)
    width = k * k if products else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in slices(batches):
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if products:
                total += ((p * n[:, None]).T @ p).ravel()
            elif len(n):
                total += (n * mixer.rates(p)[1]) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    rows = members.select("n", "p").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for row in rows:
        out[row["place"]] = row["value"]
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    anchor: str,
    headroom: float = 1.1,
    max_labelled: int = 6000,
    iterations: int = 40,
    tolerance: float = 2e-5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[Mixer, DataFrame]:
    """The fitted mixer, and (id, n, p) of every document.

    ``labels`` has columns id and domain; ``weights`` gives each domain's share of the mix.
    """
    domains = sorted(weights)
    mixer = classifier(docs, labels, domains, max_labelled, id_column, text_column)
    members = cut(memberships(docs, mixer, id_column, text_column))
    spread = summed(members, mixer, products=True).reshape(len(domains), -1)
    now = spread.sum(axis=1)
    mixer.total = float(now.sum()) or 1.0
    mixer.step = mixer.total / max(float(np.linalg.eigvalsh(spread).max()), 1e-9 * mixer.total)
    share = np.array([weights[d] for d in domains])
    at = domains.index(anchor)
    mixer.targets = share / share.sum() * headroom * now[at] / (share[at] / share.sum())
    for _ in range(iterations):
        gradient = (summed(members, mixer) - mixer.targets) / mixer.total
        mixer.gradients.append(gradient)
        if len(mixer.gradients) > 1 and np.abs(gradient - mixer.gradients[-2]).max() < tolerance:
            break
    return mixer, members


def draw_of(column: str):
    """A number in [0, 1) by the hash of an id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), column), 11).cast("double") / float(1 << 53)


def rates_of(members: DataFrame, mixer: Mixer, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, posteriors, rate and copies out of (id, n, p)."""
    k = len(mixer.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = mixer.rates(p)[0]
            copies = np.floor(rate + batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rate), pa.array(copies)], names=["id", "n_tokens", "posteriors", "rate", "copies"])

    kind = members.schema["id"].dataType.simpleString()
    out = members.select("id", "n", "p", draw_of("id").alias("draw")).mapInArrow(run, f"id {kind}, {ADDED}")
    return out.withColumnRenamed("id", id_column)


def sampled(docs: DataFrame, mixer: Mixer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that get a copy or more, once each, with all columns as they are.

    Posteriors are computed again where the rows are, so no text is shuffled.
    """
    where = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(where)
            p = np.array([posterior(words_of(texts[i].as_py()), mixer.weights, mixer.bias) for i in range(len(texts))])
            rate = mixer.rates(p.reshape(-1, len(mixer.domains)))[0]
            draw = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(rate + draw >= 1))

    return docs.select(*docs.columns, draw_of(id_column).alias("__draw")).mapInArrow(run, docs.schema)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table with quality and toxic flags: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select("doc_id", domain.alias("domain"))


#: The mix of the registered query and of the pipeline: shares of the tokens.
MIX = {"good": 0.87, "poor": 0.11, "toxic": 0.02}
