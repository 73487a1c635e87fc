"""Language identification in two steps: the family, then the language inside it.

A text is described by the counts of its byte trigrams (letters only, lower case) in ``DIMENSIONS`` hashed cells, as
square roots scaled to length one. Linear support vector machines, trained by averaged stochastic subgradients, decide
between families (each against the rest) and then, inside the family found, between every two of its languages. The
language with most won duels is taken, ties going to the larger sum of margins.

The machines are fitted on a bounded sample: about ``SAMPLE`` different texts of each language, chosen by a hash of the
text, so that the bound holds whatever ids are null or repeated. Every language with a labelled text is learned; the
driver holds the cells of the sample and a machine for each family and for each pair of languages of a family.
Prediction reads every text whole and shuffles nothing.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if no language could be learned; rows
with a null label are not used; a text counts once for each language it is labelled with, however often it is repeated;
repeated rows get equal answers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import batches, documents, fold

DIMENSIONS = 4096
SAMPLE = 1000
UNKNOWN = "und"
# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "hi", "mr", "ne", "pa", "ur"],
}
LETTER = re.compile(r"[^\W\d_]")
# Bytes of letters; everything else becomes a space. Bytes above 127 belong to letters as a rule.
_BYTES = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cell, value) of the trigrams of a whole text."""
    raw = _BYTES[np.frombuffer(f"  {text.lower()}  ".encode(), np.uint8)]
    codes = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    codes = codes[raw[1:-1] != 32]
    counts = np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / max(1e-9, np.sqrt((value * value).sum()))


@dataclass
class Machine:
    weights: np.ndarray
    bias: float

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[at] @ value) + self.bias


Cells = tuple[np.ndarray, np.ndarray]


def fit_machine(rows: list[Cells], sign: np.ndarray, epochs: int = 12, rate: float = 0.5, penalty: float = 1e-4) -> Machine:
    """Hinge loss with classes of equal weight; the average over the later half of the steps is returned."""
    n, rng = len(rows), np.random.default_rng(7)
    weight_of = {s: n / (2 * max(1, int((sign == s).sum()))) for s in (1, -1)}
    w, bias, w_sum, bias_sum, taken = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0, 0
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(n):
            s, (at, value) = sign[i], rows[i]
            if s * (w[at] @ value + bias) < 1:
                w[at] += step * s * weight_of[s] * value
                bias += 0.1 * step * s * weight_of[s]
        w *= 1 - penalty * step * n
        if 2 * epoch >= epochs:
            w_sum, bias_sum, taken = w_sum + w, bias_sum + bias, taken + 1
    return Machine(w_sum / taken, bias_sum / taken)


@dataclass
class Model:
    families: dict[str, list[str]]
    family_machines: dict[str, Machine]
    pair_machines: dict[tuple[str, str], Machine]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.families or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, value = cells(text)
        family, sure = next(iter(self.families)), 1.0
        if self.family_machines:
            margins = {name: machine.margin(at, value) for name, machine in self.family_machines.items()}
            family = max(margins, key=margins.__getitem__)
            rest = max(m for name, m in margins.items() if name != family)
            sure = _sigmoid(2 * (margins[family] - rest))
        langs = self.families[family]
        won, total, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), {}
        for (a, b), machine in self.pair_machines.items():
            if a in won and b in won:
                margin = machine.margin(at, value)
                won[a if margin > 0 else b] += 1
                total[a] += margin
                total[b] -= margin
                least[a], least[b] = min(least.get(a, margin), margin), min(least.get(b, -margin), -margin)
        lang = max(langs, key=lambda x: (won[x], total[x]))
        return lang, sure * (_sigmoid(4 * least[lang]) if lang in least else 1.0)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [cells(t) for t in batch.column(2).to_pylist()]
    at = pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32()))
    value = pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, value], names=["lang", "key", "at", "value"])


def chosen_texts(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, key, text): about ``sample`` different texts of each language with a letter, all where there are fewer."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("key"), "text")
    texts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not texts:
        return usable
    share = F.create_map(*[F.lit(x) for lang, n in texts.items() for x in (lang, min(1.0, sample / n))])
    # A text may be a third of all rows: its copies are combined in the tasks that read them.
    return usable.filter(F.pmod("key", F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).dropDuplicates(["lang", "key"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (text, lang) on the bounded sample; the driver holds its cells only."""
    found = batches(chosen_texts(labelled, sample), _describe, "lang string, key long, at array<int>, value array<float>").toArrow()
    found = found.sort_by([("lang", "ascending"), ("key", "ascending")])
    langs = np.array(found.column("lang").to_pylist(), object)
    rows = [
        (at.values.to_numpy(), value.values.to_numpy().astype(np.float64))
        for at, value in zip(found.column("at"), found.column("value"), strict=True)
    ]
    families: dict[str, list[str]] = {}
    for lang in dict.fromkeys(langs):
        families.setdefault(family_of(lang), []).append(lang)
    family = np.array([family_of(lang) for lang in langs], object)
    families_fit = {f: fit_machine(rows, np.where(family == f, 1, -1)) for f in families} if len(families) > 1 else {}
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            both = np.flatnonzero((langs == a) | (langs == b))
            pairs[a, b] = fit_machine([rows[i] for i in both], np.where(langs[both] == a, 1, -1))
    return Model(families, families_fit, pairs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.predict(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(fold(4) != 2).select("text", "lang"))
    return predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
