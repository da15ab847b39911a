"""Language identification by hierarchical discrimination.

A text is a vector of hashed character n-grams (one to three characters). A linear model predicts the language family
first; within a family, one-versus-one linear support vector machines separate each pair of its languages, and the
language of the most votes (then of the largest summed margin) wins. Everything is learned from labelled texts: the
languages are the label values seen, and the families are given by FAMILIES, a language not listed being a family of
its own.

The models are fitted on a bounded sample: at most about PER_LANGUAGE documents of each language, those of the least
hash of id, so the same rows whatever the partitions. Every document is classified on its whole text.

Cases: a null text, or one without a letter, is ``und`` with score 0; texts are otherwise always given a learned
language; with no labelled text, everything is ``und``; a null id counts as id '' for the split; repeated rows are
predicted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import shared_dir

#: Sampled documents of a language, at most about.
PER_LANGUAGE = 600
DIM = 4096
SLICE = 2_000_000
#: Families of common languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi".split(),
    "romance": "fr es pt it ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi mr ne bn pa gu".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
}
FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors (texts x DIM) of square roots of hashed n-gram counts; runs of other than letters count as one space."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, t in enumerate(texts):
        c = np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        c = np.where((c < 97) | ((c > 122) & (c < 170)), 32, c).astype(np.uint32)
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        n = np.bincount((c * np.uint32(0x165667B1)) >> 20, minlength=DIM)
        n = n + np.bincount((two ^ (two >> 15)) * np.uint32(0x2C1B3C6D) >> 20, minlength=DIM)
        n = n + np.bincount((three ^ (three >> 15)) * np.uint32(0x297A2D39) >> 20, minlength=DIM)
        root = np.sqrt(n.astype(np.float32))
        out[row] = root / max(1e-9, float(np.sqrt(n.sum())))
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (with a bias last) of a linear support vector machine of squared hinge loss, by accelerated gradient steps. y: +1, -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    share = np.where(y > 0, 1.0 / max(1, (y > 0).sum()), 1.0 / max(1, (y < 0).sum()))  # classes weigh the same
    w = v = np.zeros(x.shape[1])
    step, t = 1.0 / (1.0 + 2 * c * 2 * 2.0), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * (x.T @ (share * y * slack)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


@dataclass
class Model:
    """families: names in order, with one-versus-rest weights; pairs: (language, language, weights) of each family."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages of vectors, and scores in 0..1: how sure the least sure of the decisions taken is."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
        margins = x @ self.family_weights.T
        best = margins.argmax(1)
        if len(self.families) > 1:
            two = np.sort(margins, 1)[:, -2:]
            sure = 1 / (1 + np.exp(-2 * (two[:, 1] - two[:, 0])))
        else:
            sure = np.ones(len(x))
        lang = [""] * len(x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            names = self.languages[name]
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.full((len(rows), len(names)), np.inf)
            for a, b, w in self.pairs[name]:
                m = x[rows] @ w
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            pick = (votes + 1e-6 * np.tanh(sums)).argmax(1)
            for r, p, m in zip(rows.tolist(), pick.tolist(), least[np.arange(len(rows)), pick].tolist(), strict=True):
                lang[r] = names[p]
                if np.isfinite(m):
                    sure[r] = min(sure[r], 1 / (1 + np.exp(-4 * m)))
        return lang, sure


def fit(x: np.ndarray, lang: list[str]) -> Model | None:
    """Models from vectors and their languages."""
    if not lang:
        return None
    lang_of = np.array(lang)
    fam = np.array([FAMILY.get(v, v) for v in lang])
    families = sorted(set(fam))
    top = np.array([fit_linear(x, np.where(fam == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((1, x.shape[1] + 1))
    languages = {f: sorted(set(lang_of[fam == f])) for f in families}
    pairs = {}
    for f, names in languages.items():
        pairs[f] = []
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                rows = (lang_of == names[a]) | (lang_of == names[b])
                pairs[f].append((a, b, fit_linear(x[rows], np.where(lang_of[rows] == names[a], 1, -1))))
    return Model(families, top, {k: [str(v) for v in vs] for k, vs in languages.items()}, pairs)


def bucket(doc: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def vectors(text: Column) -> Column:
    """Feature vectors as binary (float32)."""

    @F.arrow_udf("binary")
    def text_vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([x.tobytes() for t in batch.to_pylist() for x in features([t or ""])], pa.binary())

    return text_vectors(text)


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on the sample. Only vectors of sampled rows reach the driver, PER_LANGUAGE and a few standard deviations for each language."""
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & (bucket(F.col("id")) != 2) & has_letter(F.col("t")))
    rows = rows.withColumn("u", F.xxhash64(F.lit(6), "id", "l") / F.lit(2.0**64) + 0.5)
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).collect()  # one row for each language
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(per_language / r["n"]))])
    picked = rows.filter(F.col("u") < F.try_element_at(share, F.col("l"))).select("id", "l", "u", vectors(F.col("t")).alias("x"))
    got = picked.toPandas().sort_values(["u", "l", "id"], kind="stable")
    x = np.frombuffer(b"".join(map(bytes, got["x"])), np.float32).reshape(len(got), DIM)
    return fit(x, got["l"].tolist())


def predicted(text: Column, model: Model | None) -> Column:
    """struct<lang, score> of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict_language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            ok = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, good in enumerate(ok) if good] if model else []
            for lo in range(0, len(rows), 512):
                part = rows[lo : lo + 512]
                names, sure = model.predict(features([texts[i] for i in part]))
                for i, name in zip(part, names, strict=True):
                    lang[i] = name
                score[part] = sure
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return predict_language(text)


def identify(docs: DataFrame, keep: list[str], doc: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """The kept columns of docs with lang_pred and score, by a model that is fitted on docs if none is given."""
    shared_dir(docs.sparkSession)
    model = model or train(docs, doc, text)
    rows = docs.select(*keep, predicted(F.col(text), model).alias("__p"))
    return rows.select(*keep, F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"))
