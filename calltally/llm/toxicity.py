"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A text is cut into blocks of `BLOCK` words. The block's vector is the mean of the embeddings of its
character n-grams (hashed into a table, so a misspelling shares most of its n-grams with the word it
comes from), and a linear softmax over that vector gives the block's probability. The text's score is
that of its worst block: one insult counts as much in a long text as in a short one. Embeddings and
softmax are trained together, by gradient descent in numpy, on a bounded sample of labelled rows.

Two classes make the gradient of an embedding a multiple of the difference of the class vectors, so
training needs one number per n-gram and step, and scoring needs one table of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltally.llm.common import Rolling, chunks, in_slices, mixed

BLOCK = 24
STEADY = 400  # n-grams of weight zero that every mean also holds, so that a block of few words is not noise
PIECE = 1 << 18  # characters that are looked at together; a longer text is cut between words
_ROLL = Rolling()
_WORD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    table: np.ndarray  # logit per bucket: embedding times difference of the class vectors
    bias: float
    wordless: float  # logit of a text without words: the share of label 1 in the sample
    embeddings: np.ndarray
    classes: np.ndarray


def _pieces(text: str) -> list[bytes]:
    """The text in lower case as words between single or repeated spaces, cut between words if long."""
    whole = (text or "").lower().encode("utf-8", "replace").translate(_WORD)
    out = []
    while len(whole) > PIECE:
        at = whole.rfind(b" ", 0, PIECE) + 1 or PIECE
        out.append(whole[:at])
        whole = whole[at:]
    return [*out, whole]


def grams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, ordered by block; the start of each block there; the text of each block.

    Every text has a block at least; blocks without n-grams are left out unless they are the only one.
    """
    raw = np.frombuffer(b"".join(b" " + t + b"    " for t in texts), np.uint8)
    space = raw == 32
    begins = space[:-1] & ~space[1:]  # a word begins at the next place
    words = np.cumsum(begins, dtype=np.int32)
    ends = np.cumsum([len(t) + 5 for t in texts])
    first = np.concatenate(([0], words[np.minimum(ends, len(words)) - 1]))  # words before each text
    sizes = np.diff(first)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    base = np.concatenate(([0], np.cumsum(blocks)))
    word_text = np.repeat(np.arange(len(texts)), sizes)
    block_of_word = base[word_text] + (np.arange(len(word_text)) - first[word_text]) // BLOCK
    # a word that its block already has says nothing new
    begin, finish = np.flatnonzero(begins) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    key = _ROLL.ranges(_ROLL.prefix(raw), begin, finish) ^ mixed(block_of_word.astype(np.uint64))
    fresh = np.zeros(len(key), bool)
    fresh[np.unique(key, return_index=True)[1]] = True
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    h = raw.astype(np.uint32)
    at = len(raw)
    value, ids, places = h, [], []
    last = space
    for n in (2, 3, 4, 5):
        at -= 1
        value = value[:at] * np.uint32(0x01000193) ^ h[n - 1 :]
        if n > 2:
            inside = inside[:at] | last[n - 2 : n - 2 + at]  # noqa: F821  a space that is not at an end
            keep = np.flatnonzero(~inside)
            places.append(keep)
            spread = (value[keep] + np.uint32(n)) * np.uint32(0x9E3779B1)
            ids.append(((spread ^ (spread >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift)
        else:
            inside = np.zeros(at, bool)
    place, bucket = np.concatenate(places), np.concatenate(ids)
    if len(word_text):
        # the word that a gram lies in: the first that begins at or after its place, or the one it is inside
        of = words[np.minimum(place, len(words) - 1)] - 1
        of = np.clip(of, 0, len(word_text) - 1)
        block = block_of_word[of]
        new = fresh[of]
        bucket, block = bucket[new], block[new]
        order = np.argsort(block, kind="stable")
        bucket, block = bucket[order], block[order]
    else:
        bucket, block = bucket[:0], np.zeros(0, np.int64)
    present, starts = np.unique(block, return_index=True)
    text_of_block = np.repeat(np.arange(len(texts)), blocks)
    return bucket, starts, text_of_block[present]


def _block_logits(table: np.ndarray, bias: float, bucket: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(bucket))
    out = np.zeros(len(starts))
    for at in range(0, len(starts), 4096):  # in slices, as the looked-up numbers of a sample are many
        a, b = starts[at : at + 4096], ends[at : at + 4096]
        out[at : at + 4096] = np.add.reduceat(table[bucket[a[0] : b[-1]]], a - a[0]) / (b - a + STEADY) + bias
    return out


def logits(texts: list[str], table: np.ndarray, bias: float, wordless: float = 0.0) -> np.ndarray:
    """The largest block logit of each text; `wordless` for a text without words."""
    out = np.full(len(texts), -np.inf)
    pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t)]
    for part in chunks([p for _, p in pieces], PIECE):
        owners = np.array([k for k, _ in pieces[: len(part)]])
        del pieces[: len(part)]
        bucket, starts, owner = grams(part, len(table))
        np.maximum.at(out, owners[owner], _block_logits(table, bias, bucket, starts))
    return np.where(np.isneginf(out), wordless, out)


def train(
    texts: list[str], labels: np.ndarray, buckets: int = 1 << 17, width: int = 8, steps: int = 60,
    seed: int = 7, rate: float = 0.5, decay: float = 0.02, rare: int = 5,
) -> Model:
    """Fit embeddings and softmax together by gradient descent over the whole sample.

    The first third of the steps spreads a text's label over its blocks; afterwards the worst block of
    a text carries it. Buckets seen in fewer than `rare` texts stay zero, as does everything if one
    class is missing.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    table, bias = np.zeros(buckets), 0.0
    emb = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    cls = rng.normal(0, 1.0, (width, 2)).astype(np.float32)
    share = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    if not 0 < labels.sum() < len(labels):
        return Model(table, share, share, emb, cls)
    found = [grams([b" ".join(_pieces(t))], buckets) for t in texts]
    bucket = np.concatenate([b for b, _, _ in found])
    lengths = np.array([len(b) for b, _, _ in found])
    shift = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    starts = np.concatenate([s + o for (_, s, _), o in zip(found, shift, strict=True)])
    owner = np.concatenate([np.full(len(s), k) for k, (_, s, _) in enumerate(found)])
    seen = np.zeros(buckets, np.int32)
    for b, _, _ in found:
        seen[np.unique(b)] += 1
    del found
    used = seen >= rare
    emb *= used[:, None]
    size = np.diff(np.append(starts, len(bucket)))
    per_text = np.bincount(owner, minlength=len(texts))
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    moved, scale = [np.zeros_like(emb), np.zeros_like(cls)], [0.0, 0.0]
    for step in range(1, steps + 1):
        diff = cls[:, 1] - cls[:, 0]
        logit = _block_logits(emb @ diff, bias, bucket, starts)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step <= steps // 3:
            g = (prob - labels[owner]) * weight[owner] / per_text[owner]
            chosen = np.arange(len(starts))
        else:
            order = np.lexsort((-logit, owner))
            chosen = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
            g = (prob[chosen] - labels[owner[chosen]]) * weight[owner[chosen]]
        c = np.zeros(buckets)
        for some in range(0, len(chosen), 4096):
            part = chosen[some : some + 4096]
            spans = size[part]
            at = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(spans)))[:-1], spans) + np.arange(spans.sum())
            per_gram = np.repeat(g[some : some + 4096] / (spans + STEADY), spans)
            c += np.bincount(bucket[at], weights=per_gram, minlength=buckets)
        c *= used
        grad_e = np.outer(c, diff).astype(np.float32)
        towards = (c @ emb).astype(np.float32)
        grad_c = np.stack([-towards, towards], 1)
        # momentum over a step that is scaled as a whole: a rare bucket moves little, whatever it fits
        for value, grad, m, at in ((emb, grad_e, moved[0], 0), (cls, grad_c, moved[1], 1)):
            scale[at] = max(0.9 * scale[at], float(np.abs(grad).max()), 1e-12)
            m *= 0.8
            m += grad / scale[at]
            value *= 1 - rate * decay
            value -= rate * m
        bias -= rate * float(np.clip(g.sum() * 4, -1, 1))
    table = (emb @ (cls[:, 1] - cls[:, 0])).astype(np.float64)
    return Model(table, float(bias), share, emb, cls)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = 1000, negatives: int = 3000, longest: int = 6000,
) -> Model:
    """Train on the texts of at most `positives` rows of label 1 and `negatives` of label 0 of `labels`.

    Rows are chosen by a hash of `key`, so that only the few chosen keys are sent to the texts; a key
    with several labels counts with the largest. Texts that are null or over `longest` characters are
    left out. These bounds limit what the driver holds. Null labels and keys are ignored; without rows
    of both labels every text gets one score.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    chosen = [
        rows.where(F.col("label") == wanted).orderBy(F.xxhash64(key), key).limit(most)
        for wanted, most in ((0, negatives), (1, positives))
    ]
    bounded = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most positives + negatives rows of two numbers
    sample = (
        docs.select(key, F.col(text).alias("text")).where(F.length("text") <= longest)
        .join(bounded, key).select(key, "text", "label").collect()
    )
    sample.sort(key=lambda r: (r["label"], r[0]))
    return train([r["text"] for r in sample], np.array([r["label"] for r in sample]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a probability in `name` (an existing column of that name is replaced).

    Null and empty texts, and texts without a word, score the share of label 1 in the sample. Whole texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.bias, model.wordless))

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, bias, wordless = sent.value

        def of(texts: list[str | None]) -> np.ndarray:
            values = logits([x if x is not None else "" for x in texts], table, bias, wordless)
            return 1 / (1 + np.exp(-np.clip(values, -30, 30)))

        for batch in batches:
            yield in_slices(batch, of, pa.float64())

    return docs.withColumn(name, probability(F.col(text)))
