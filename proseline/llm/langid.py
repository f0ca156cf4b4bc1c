"""Operator 10, language identification: expectation-maximisation over mixtures of languages.

Training counts byte trigrams of lower-cased texts by language, over all training rows, in a table of fixed width. A
text is its words; a word's likelihood under a language is the product over its trigrams, white space around it
included. Expectation-maximisation finds the languages' shares of the words. The set of languages starts from the best
single one and grows by the language whose mixture raises the likelihood most, as long as the gain exceeds a penalty
for the parameter it adds. All texts of a batch are handled at once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import body, guarded, slices

BINS = 1 << 16
ROUNDS = 12
#: Weight of a trigram that training hasn't seen, and the most that one word counts, in nats between languages.
SMOOTHING, CLIP = 0.5, 12.0
#: Bytes of text that are handled at once.
BLOCK = 1 << 20
#: Words of a text that a mixture is fitted to count by their number; the penalty grows with its logarithm.
PENALTY = 3.0
UNKNOWN = "und"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bin of the trigram that ends at each byte from the third on."""
    x = data.astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def lowered(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n): trigram counts of all rows of docs (text, lang) whose lang isn't null."""

    def run(batches):
        table: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(b" " + lowered(text) + b" ", np.uint8)
                if len(data) > 2:
                    own = table.setdefault(lang, np.zeros(BINS, np.int64))
                    np.add(own, np.bincount(trigrams(data), minlength=BINS), out=own)
        for lang, own in table.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())],
                names=["lang", "bin", "n"],
            )

    partial = docs.where("lang is not null").select(body().alias("body"), "lang")
    return partial.mapInArrow(run, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def model(found: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and, by bin and language, the log probability of a trigram."""
    langs = sorted(set(found["lang"]))
    table = np.full((len(langs), BINS), SMOOTHING)
    place = {x: i for i, x in enumerate(langs)}
    table[found["lang"].map(place).to_numpy(int), found["bin"].to_numpy(int)] += found["n"].to_numpy(float)
    return langs, np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32))


def fit(scores: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood of each text by expectation-maximisation, over the languages that are allowed.

    scores: words x languages; first: each text's first word (every text has one); allowed: texts x languages.
    """
    n = np.diff(np.append(first, len(scores)))
    of = np.repeat(np.arange(len(first)), n)
    share = allowed / allowed.sum(1, keepdims=True)
    top = scores.max(1, keepdims=True)
    odds = np.exp(scores - top)
    for _ in range(ROUNDS):
        joint = odds * share[of]
        total = joint.sum(1, keepdims=True)
        np.maximum(total, 1e-30, out=total)
        share = np.add.reduceat(joint / total, first, axis=0) / n[:, None]
    total = np.maximum((odds * share[of]).sum(1), 1e-30)
    return share, np.add.reduceat(np.log(total) + top[:, 0], first)


def mixtures(scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text over the set of languages that penalised likelihood selects, and that set."""
    n = np.diff(np.append(first, len(scores)))
    alone = np.add.reduceat(scores, first, axis=0)
    texts, langs = alone.shape
    chosen = np.zeros((texts, langs))
    chosen[np.arange(texts), alone.argmax(1)] = 1
    share, best = chosen.copy(), alone.max(1)
    cost = PENALTY + np.log(n)
    growing = np.arange(texts)
    for _ in range(langs - 1):
        # the language that explains most words better than those chosen so far
        ends = first + n
        words = np.concatenate([np.arange(first[i], ends[i]) for i in growing]) if len(growing) < texts else np.arange(len(scores))
        counts_ = n[growing]
        starts = np.concatenate([[0], np.cumsum(counts_)[:-1]]).astype(np.int64)
        part = scores[words]
        of = np.repeat(growing, counts_)
        now = np.where(chosen[of] > 0, part, -np.inf).max(1, keepdims=True)
        gain = np.add.reduceat(np.maximum(part - now, 0), starts, axis=0)
        gain[chosen[growing] > 0] = -1
        add = gain.argmax(1)
        hope = gain[np.arange(len(growing)), add] > cost[growing]
        if not hope.any():
            break
        keep = np.repeat(hope, counts_)
        growing, add, counts_, part = growing[hope], add[hope], counts_[hope], part[keep]
        starts = np.concatenate([[0], np.cumsum(counts_)[:-1]]).astype(np.int64)
        wider = chosen[growing].copy()
        wider[np.arange(len(growing)), add] = 1
        fitted, likely = fit(part, starts, wider)
        better = likely - best[growing] > cost[growing]
        growing = growing[better]
        if not len(growing):
            break
        chosen[growing], share[growing], best[growing] = wider[better], fitted[better], likely[better]
    return share, chosen


def word_scores(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words x languages of log likelihoods, each text's first word, and which texts have words."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)
    space = _SPACE[joined]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    bounds = np.cumsum([1, *(len(x) + 1 for x in texts)])
    first = np.searchsorted(start, bounds)
    filled = np.diff(first) > 0
    if not len(start):
        return np.zeros((0, table.shape[1])), np.zeros(0, np.int64), filled
    bins = trigrams(joined)
    # a word's trigrams end at its second byte (the first with white space before) up to the white space after it
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    length = end - start
    out = np.empty((len(start), table.shape[1]))
    for i in range(table.shape[1]):
        summed = np.concatenate([[0.0], np.cumsum(table[bins, i], dtype=np.float64)])
        # trigram t covers bytes t, t+1, t+2: from the white space before the word to the one after it
        out[:, i] = summed[np.maximum(end - 1, start)] - summed[start - 1]
    out -= out.max(1, keepdims=True)
    np.maximum(out, -CLIP * np.minimum(1, length[:, None] / 2), out=out)
    return out, first[:-1][filled], filled


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """keep's columns (doc_id unless given) with lang_pred, score and langs (array of lang, share) for each row."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        for batch in slices(batches):
            texts = [lowered(x) if isinstance(x, bytes) else (x or "").lower().encode() for x in batch.column(place).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= BLOCK):
                    size += len(texts[stop]) + 1
                    stop += 1
                part = texts[at:stop]
                named, score, shares = [UNKNOWN] * len(part), [0.0] * len(part), [[] for _ in part]
                if langs:
                    scores, first, filled = word_scores(part, table)
                    if len(first):
                        share, _ = mixtures(scores, first)
                        for row, i in zip(share, np.flatnonzero(filled), strict=True):
                            if _LETTER.search(part[i].decode()):
                                top = int(row.argmax())
                                named[i], score[i] = langs[top], float(min(row[top], 1.0))
                                shares[i] = [{"lang": langs[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)]
                kept = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(i) for i in range(len(keep))), pa.array(named, pa.string()), pa.array(score, pa.float64()),
                     pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=[*keep, "lang_pred", "score", "langs"],
                )
                at = stop

    named = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    bytes_ = body().alias("_body")
    place = keep.index("text") if "text" in keep else len(keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], *[bytes_] * (place == len(keep))).mapInArrow(
        run, f"{named}lang_pred string, score double, langs array<struct<lang: string, share: double>>"
    )


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of all rows of docs with a lang. What the driver gets is BINS rows a language at most."""
    return model(counts(docs).toPandas())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Predictions for each row of docs by a model trained on its rows that aren't held out and have a lang.

    A null text, one without a letter, and any text where nothing could be learned have lang_pred und, score 0 and no
    langs. A null doc_id isn't held out. Repeated rows get equal results; no rows give none.
    """
    langs, table = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs, langs, table, keep)


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs with a language that makes up `least` of them or more; those of none, or of many in parts, go."""
    docs, names = guarded(docs)
    found = identify(docs, docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns).toDF(*names)
