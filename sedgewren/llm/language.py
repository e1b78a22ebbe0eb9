"""Languages of documents and of their lines (problem 10).

A sparse multinomial logistic regression on TF-IDF weights of hashed character 1- to 3-grams, trained with
follow-the-regularised-leader proximal updates under an elastic-net penalty (McMahan 2011) on labelled lines, and calibrated by
one temperature. Document frequencies are counted over all documents; only the fit uses a bounded sample of labelled rows.
Scoring works on all lines of a batch at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import bounded, code_points, histogram, mixed_hash, strings

BITS = 16
ORDERS = 3
SPACE, NUMBER = 0x20, 0x30


def _folded_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points, offsets = code_points(texts)
    points = points.copy()
    upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE)
    points[upper] += 32
    points[(points >= 48) & (points <= 57)] = NUMBER
    points[(points < 33) | (points >= 0x2000) & (points <= 0x206F)] = SPACE
    return points, offsets


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of all texts, and the text of each; alone, an ideograph or kana counts as one of its script."""
    points, offsets = _folded_points(texts)
    script = np.where((points >= 0x3400) & (points <= 0x9FFF), 0x4E00, np.where((points >= 0x3041) & (points <= 0x30FF), 0x3042, points)).astype(np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    keys, owners, value = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        value = (value[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :].astype(np.uint64)
        inside = of[: len(value)] == of[n - 1 :] if n > 1 else slice(None)
        keys.append((mixed_hash(script.astype(np.uint64) if n == 1 else value, n) >> np.uint64(64 - BITS)).astype(np.int32)[inside])
        owners.append(of[: len(value)][inside])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.int32), np.empty(0, np.int32))


def line_split(text: str) -> list[str]:
    """Non-blank lines, stripped."""
    return [x.strip() for x in re.split(r"\r\n|\n|\r", text) if x.strip()]


def document_frequencies(texts: DataFrame):
    """Documents that hold each hashed gram, over all rows of the one-column frame ``texts``."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((1, 1 << BITS), np.int64)
        for part in bounded(strings(batch.column(0))):
            keys, of = grams(part)
            out[0] += np.bincount(np.unique(of.astype(np.int64) << BITS | keys) & ((1 << BITS) - 1), minlength=1 << BITS)
        return out

    return histogram(texts, count, BITS)[0]


@dataclass
class LanguageModel:
    """Weights (grams, languages), already multiplied by inverse document frequency; bias, temperature, language codes."""

    codes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of logits for each text; TF-IDF weights are scaled to sum 1 by text."""
        n = len(texts)
        if not n:
            return np.zeros((0, len(self.codes)), np.float32)
        keys, of = grams(texts)
        total = np.bincount(of, weights=self.idf[keys], minlength=n)
        out = np.empty((n, len(self.codes)))
        for k in range(len(self.codes)):
            out[:, k] = np.bincount(of, weights=self.weights[keys, k], minlength=n)
        return out / np.maximum(total, 1e-9)[:, None] * SCALE + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


SCALE = 30.0


def fit_ftrl(texts: list[str], labels: np.ndarray, codes: list[str], idf: np.ndarray, alpha=0.3, beta=1.0, l1=0.5, l2=0.5, epochs=3, batch=96, seed=0) -> LanguageModel:
    """FTRL-proximal over mini-batches of lines, then a temperature on the tenth of lines kept apart."""
    k = len(codes)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(seed).permutation(len(texts))
    held, train = order[: len(order) // 10], order[len(order) // 10 :]
    keys, of = grams(texts)
    starts = np.searchsorted(np.sort(of, kind="stable"), np.arange(len(texts) + 1))
    by = np.argsort(of, kind="stable")
    features = []
    for t in range(len(texts)):
        u, c = np.unique(keys[by[starts[t] : starts[t + 1]]], return_counts=True)
        v = c * idf[u]
        features.append((u, v / max(v.sum(), 1e-9) * SCALE))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    heavy = np.bincount(labels[train], minlength=k)
    heavy = np.clip(np.sqrt(heavy.max() / np.maximum(heavy, 1)), 1, 4)  # rare languages weigh more
    rng = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            u = np.concatenate([features[t][0] for t in rows])
            v = np.concatenate([features[t][1] for t in rows])
            r = np.repeat(np.arange(len(rows)), [len(features[t][0]) for t in rows])
            w = weights(z[u], n[u])
            x = np.add.reduceat(w * v[:, None], np.concatenate([[0], np.cumsum([len(features[t][0]) for t in rows])[:-1]]), axis=0)
            bias = weights(zb, nb)
            x += bias
            p = np.exp(x - x.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= heavy[labels[rows], None]
            uu, inv = np.unique(u, return_inverse=True)
            g = np.stack([np.bincount(inv, weights=p[r, c] * v, minlength=len(uu)) for c in range(k)], 1)
            old, grown = weights(z[uu], n[uu]), n[uu] + g * g
            z[uu] += g - (np.sqrt(grown) - np.sqrt(n[uu])) / alpha * old
            n[uu] = grown
            gb = p.sum(axis=0)
            sb = (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha
            zb += gb - sb * bias
            nb += gb * gb
    model = LanguageModel(codes, (weights(z, n) * idf[:, None]).astype(np.float32), weights(zb, nb), idf)
    if len(held):
        logits, gold = model.logits([texts[t] for t in held]), labels[held]

        def loss(temperature: float) -> float:
            s = logits / temperature
            return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(gold)), gold]))

        model.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return model


def base_code(lang):
    """Language part of a label column: no case, no region; '' for no language."""
    code = F.lower(F.regexp_extract(F.trim(F.coalesce(lang, F.lit(""))), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code.isin("und", "unk", "mul", "zxx"), "").otherwise(code)


def fit_language_model(docs: DataFrame, codes: list[str], text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2400, sample_pieces: int = 12000, rounds: int = 2, seed: int = 0) -> LanguageModel:
    """Fit on at most ``sample_pieces`` sentences of at most ``sample_docs`` labelled documents, spread evenly over the labels.

    Labels are cleaned first: in each round the documents are halved, and a sentence is left out if the model of the other half
    prefers another language than its label's, or if it does so for most of its document. That removes wrong labels and passages
    in another language.
    """
    counted = document_frequencies(docs.where(F.col(text_col).isNotNull()).select(text_col))
    total = max(1, docs.count())
    idf = np.log((1 + total) / (1 + counted)) + 1
    labelled = docs.select(F.col(text_col).alias("t"), base_code(F.col(lang_col)).alias("l")).where(F.col("l").isin(codes) & F.col("t").isNotNull())
    # about equally many different texts of each label: counted in one pass, chosen by hash in another
    per, h = -(-sample_docs // len(codes)), F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1_000_000))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.approx_count_distinct("t").alias("n")).collect()}
    share = F.lit(0)
    for c, n in sizes.items():
        share = F.when(F.col("l") == c, int(1_000_000 * min(1.0, 1.1 * per / max(n, 1)))).otherwise(share)
    picked = labelled.where(h < share).select("t", "l").distinct().limit(2 * sample_docs)
    found = sorted((r["t"], codes.index(r["l"])) for r in picked.collect())
    rows = _undisputed([(line, y, n) for n, (t, y) in enumerate(found) for line in line_split(t) for line in _pieces(line)], len(codes))
    rng, by_label = np.random.default_rng(seed), {}
    for i in rng.permutation(len(rows)):
        by_label.setdefault(rows[i][1], []).append(i)
    rows = [rows[i] for part in by_label.values() for i in part[: max(1, sample_pieces // len(codes))]]
    texts, labels, of = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
    if not len(texts):
        return LanguageModel(codes, np.zeros((1 << BITS, len(codes)), np.float32), np.zeros(len(codes)), idf)
    # halves of equally many documents of each label
    turn, half_of = np.random.default_rng(seed).integers(0, 2, len(codes)), np.zeros(len(found), np.int64)
    for n, (_, y) in enumerate(found):
        half_of[n], turn[y] = turn[y] % 2, turn[y] + 1
    keep, side_of = np.ones(len(texts), bool), half_of[of]
    for _ in range(rounds):
        agrees = keep.copy()
        for side in (0, 1):
            at, other = np.flatnonzero(keep & (side_of == side)), np.flatnonzero(keep & (side_of != side))
            if len(at) and len(other):
                half = fit_ftrl([texts[i] for i in at], labels[at], codes, idf, seed=seed)
                known = np.isin(labels[other], labels[at])  # a label that one half lacks can't be judged by it
                agrees[other] = ~known | (half.logits([texts[i] for i in other]).argmax(axis=1) == labels[other])
        # a document most of whose sentences disagree is wrongly labelled as a whole
        share = np.bincount(of, weights=agrees, minlength=len(found)) / np.maximum(np.bincount(of, weights=keep, minlength=len(found)), 1)
        keep = agrees & (share[of] >= 0.5)
    at = np.flatnonzero(keep)
    return fit_ftrl([texts[i] for i in at], labels[at], codes, idf, seed=seed)


def _undisputed(rows: list[tuple[str, int, int]], k: int) -> list[tuple[str, int, int]]:
    """Rows (text, label, document) whose label is the one their sentence, digits aside, has most often; even ones are left out.

    A set sentence in wrongly labelled documents would otherwise be learnt by heart under their label.
    """
    votes: dict[str, np.ndarray] = {}
    forms = [re.sub(r"[0-9０-９]+", "0", text) for text, _, _ in rows]
    for f, (_, y, _) in zip(forms, rows):
        votes.setdefault(f, np.zeros(k, np.int64))[y] += 1
    return [r for f, r in zip(forms, rows) if votes[f][r[1]] == votes[f].max() and (votes[f] == votes[f].max()).sum() == 1]


def _pieces(line: str) -> list[str]:
    """Sentences of a training line, so that short texts are learnt too."""
    return [x for x in re.split(r"(?<=[。！？.!?])\s*(?=\D)", line) if len(x) >= 8] or [line]


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, segment_no, lang_code, confidence, labelled): segment 0 is the document, n >= 1 its n-th non-blank line.

    A document's language is that of most of its characters. Only lines in another language than the document's are given,
    so a document in one language has one row. ``labelled`` is the label's language code, '' if there is none. NULL or blank
    texts get one row with lang_code NULL and confidence 0. A line below 12 letters has the
    document's language; an ideograph or kana counts as three letters.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), base_code(F.col(lang_col)).alias("l"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for b in batches:
            split = [line_split(t) for t in strings(b.column("t"))]
            flat = [x for lines in split for x in lines]
            p = np.concatenate([np.zeros((0, len(m.codes))), *(m.probabilities(part) for part in bounded(flat))])
            out = ([], [], [], [], [])
            at = 0
            for i, lines, label in zip(b.column("i").to_pylist(), split, b.column("l").to_pylist()):
                q = p[at : at + len(lines)]
                at += len(lines)
                for seg, code, sure in _document(lines, q, m.codes):
                    for column, x in zip(out, (i, seg, code, sure, label)):
                        column.append(x)
            yield pa.record_batch([pa.array(out[0], b.schema.field("i").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.string())], names=["doc_id", "segment_no", "lang_code", "confidence", "labelled"])

    return d.mapInArrow(score, f"doc_id {kind}, segment_no int, lang_code string, confidence double, labelled string")


def _document(lines: list[str], p: np.ndarray, codes: list[str]):
    if not lines:
        yield 0, None, 0.0
        return
    size = np.array([len(x) for x in lines], float)
    best = p.argmax(axis=1)
    main = int(np.argmax(np.bincount(best, weights=size, minlength=len(codes))))
    yield 0, codes[main], float((p[:, main] * size).sum() / size.sum())
    for n, line in enumerate(lines):
        if best[n] != main and _letters(line) >= 12 and p[n, best[n]] >= 0.5:
            yield n + 1, codes[int(best[n])], float(p[n, best[n]])


def _letters(line: str) -> int:
    """Letters of a line, an ideograph, kana or syllable sign counting three, as it says about as much."""
    return sum(3 if c > "\u2e7f" else 1 for c in line if c.isalpha())


def label_errors(found: DataFrame) -> DataFrame:
    """(doc_id, segment_no, lang_code) of missing or wrong document labels and of lines in another language."""
    return found.where("lang_code IS NOT NULL AND (segment_no > 0 OR labelled <> lang_code)").select("doc_id", "segment_no", "lang_code")
