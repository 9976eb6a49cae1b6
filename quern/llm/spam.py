"""Problem 10: keyword-stuffed pages, link lists and tag listings.

Method: every document gets a vector of density, entropy, repetition and function-word features. Per language, a robust
centre and scatter (mean and covariance of the inner part of the data) are computed over all documents; the robust
Mahalanobis distance says how far a document lies from informative text. Its spam-directed part is the distance, in the same
metric, to the nearest point that is not spam-directed, that is, with no more repetition, links or prices and no less variety
than the centre, and with any share of function words and sentences (tables and directories have few). Features that go
together in ordinary text, such as variety and entropy, so count once. A document is flagged where both distances are beyond
the chi-square quantile of ``LEVEL`` for their number of features.

Cost: one pass over the texts in Arrow batches makes 8 numbers a document, which are cut to disk; everything after works on
those. Statistics are approximate percentiles and sums per language (a handful of groups, folded by partial aggregation).

Defined results: null, blank and wordless texts are never flagged; the language is recognised from function words, and a
text without any takes part in the group of its stored ``lang`` if that is known, else in ``und``; languages with fewer than
``MIN_DOCS`` documents use the statistics of all documents; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

# Common function words of the languages at hand.
FUNCTION_WORDS = {
    "en": "the a an of to in and or for on at by with from as is are was were be been it its this that these those which who whom has have had will would can could may so but not no if than then there their they he she his her our we you your i how what when where why while about into over after before between more most some any each every all such only also do does did because for since until without within until one two".split(),
    "es": "el la los las un una unos unas de del al a en y o u e que se su sus por para con sin sobre como es son fue era ser ha han lo le les no si más muy este esta estos estas ese esa cuando donde quien cual entre hasta desde tras durante antes después porque pero también ya mejor qué nuestro nuestra".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder in im an am auf zu zum zur von vom mit für über aus bei nach vor seit um durch ist sind war wird werden hat haben als auch nicht nur noch so wie wenn dass sich sie er es wir ihr sein ihre unser unsere wer was wo warum weil aber bis ohne zwischen".split(),
}
FEATURES = ("function_words", "sentences", "variety", "entropy", "repeated_pairs", "links", "prices", "repeated_segments")
#: +1 where more is spam-directed, -1 where less is.
DIRECTION = np.array([-1.0, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0, 1.0])
WINDOW = 60
MIN_DOCS = 50
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"https?://[^\s<>\"')\]]+|<a\s[^>]{0,2000}>|</a>|www\.[^\s<>\"')\]]+|#\w+", re.I)
_DELIMITERS = (*"|,;•»·<>[]()\r\t\u00a0", " - ", " – ", " — ", ". ", "! ", "? ", "  ")
_END = re.compile(r"[.!?…](?=\s|$|[\"”»)*<])")
_PRICE = re.compile(r"[$€£]\s?\d|\d\s?[$€£]|-\d+\s?%")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ])")
_TAG_NOISE = re.compile(r"https?|www|href|example|html?|com|<a", re.I)
_LANGS = tuple(FUNCTION_WORDS)
_FUNCTION = {w: sum(1 << i for i, lang in enumerate(_LANGS) if w in FUNCTION_WORDS[lang]) for ws in FUNCTION_WORDS.values() for w in ws}
#: v log v for counts within a window.
_VLOGV = np.array([0.0] + [v * math.log(v) for v in range(1, WINDOW + 1)])
#: Words' worth of ordinary text that a short text's variety is pulled towards.
PRIOR = 15.0


def _tells(word: str) -> bool:
    """Whether a word counts as content: short words and small numbers do not, codes do."""
    return len(word) > 2 if word.isdigit() else len(word) > 3 or not word.isalpha()


class Measure:
    """Features of texts. Words are numbered as they come, so that counting is done on integers; the numbering is dropped at a fixed size."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.marks = np.zeros(1 << 12, np.uint8)

    def _number(self, ws: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, ws), dtype=np.int64, count=len(ws))
        except KeyError:
            if len(ids) > self.most:
                self.reset()
                ids = self.ids
            for w in ws:
                if w not in ids:
                    i = ids[w] = len(ids)
                    if i >= len(self.marks):
                        self.marks = np.concatenate([self.marks, np.zeros(len(self.marks), np.uint8)])
                    self.marks[i] = _FUNCTION.get(w, 0) or (0 if _tells(w) else 128)
            return np.fromiter(map(ids.__getitem__, ws), dtype=np.int64, count=len(ws))

    def __call__(self, text: str | None) -> tuple[str, int, list[float]] | None:
        """(language, words, features) of a text; None where it has no words."""
        if not text:
            return None
        links, plain = 0, text
        if "#" in text or "<" in text or "http" in text or "www." in text:
            links = len(_URL.findall(text))
            if links:
                plain = _URL.sub(
                    lambda m: " " + (_CAMEL.sub(" ", m.group()[1:]) if m.group()[0] == "#" else _TAG_NOISE.sub(" ", m.group())) + " ",
                    text,
                )
        ws = _WORD.findall(plain.lower())
        n = len(ws)
        if not n:
            return None
        ids = self._number(ws)
        marks = self.marks[ids]
        used = [int(np.count_nonzero(marks & (1 << i) & 127)) for i in range(len(_LANGS))]
        most = max(used)
        lang = _LANGS[used.index(most)] if most >= max(2, 0.04 * n) else "und"
        content = ids[marks == 0]
        if not len(content):
            content = ids
        m = len(content)
        variety, entropy = _windows(content)
        pairs = np.sort(content[1:] * (len(self.ids) + 1) + content[:-1])
        repeated = np.count_nonzero(pairs[1:] == pairs[:-1]) / max(1, m - 1)
        segments = [s for s in map(str.strip, _segments(plain)) if len(s) > 2]
        ns = len(segments)
        damp = n / (n + 10.0)
        return lang, n, [
            most / n,
            min(1.0, 12.0 * len(_END.findall(text)) / n),
            variety,
            entropy,
            repeated * damp / math.log(math.e + m / 60.0),
            min(1.0, 5.0 * links / n) * damp,
            min(1.0, 5.0 * len(_PRICE.findall(text)) / n) * damp if "$" in text or "€" in text or "£" in text or "%" in text else 0.0,
            (ns - len(set(segments))) / max(ns, 6) * damp / math.log(math.e + ns / 30.0),
        ]


def _segments(text: str) -> list[str]:
    """The text in lower case, cut at list delimiters, dashes between words, ends of sentences and wide gaps."""
    low = text.lower()
    for delimiter in _DELIMITERS:
        low = low.replace(delimiter, "\n")
    return low.split("\n")


def _windows(content: np.ndarray) -> tuple[float, float]:
    """Mean over windows of distinct words and of normalised entropy; a short text is pulled towards an ordinary one."""
    m = len(content)
    full = m // WINDOW
    kinds, entropies, weights = [], [], []
    for part in (
        [content[: full * WINDOW].reshape(full, WINDOW)] if full else []
    ) + ([content[full * WINDOW :].reshape(1, -1)] if m % WINDOW else []):
        rows, k = part.shape
        x = np.sort(part, axis=1)
        new = np.ones((rows, k), bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]
        starts = np.flatnonzero(new.ravel())
        runs = np.diff(np.append(starts, rows * k))
        row = starts // k
        distinct = np.bincount(row, minlength=rows)
        h = math.log(k) - np.bincount(row, weights=_VLOGV[runs], minlength=rows) / k if k > 1 else np.zeros(rows)
        kinds.append((distinct + 0.92 * PRIOR) / (k + PRIOR))
        entropies.append((h / math.log(k) * k + 0.97 * PRIOR) / (k + PRIOR) if k > 1 else np.full(rows, 0.97))
        weights.append(np.full(rows, k))
    w = np.concatenate(weights)
    return float(np.average(np.concatenate(kinds), weights=w)), float(np.average(np.concatenate(entropies), weights=w))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, f array<double>) of the texts that have words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Measure()
        for pdf in batches:
            out = []
            for d, t, g in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                m = measure(t)
                if m is not None:
                    own = g.strip().lower()[:2] if isinstance(g, str) else ""
                    out.append((d, m[0] if m[0] != "und" or own not in FUNCTION_WORDS else own, m[1], m[2]))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "n_words", "f"])

    return docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    ).mapInPandas(run, "doc_id long, lang string, n_words long, f array<double>")


#: Least scale of each feature.
FLOOR = np.array([0.03, 0.08, 0.03, 0.015, 0.03, 0.05, 0.05, 0.03])
#: Features whose deviation makes an outlier spam-directed; few function words or sentences alone (tables, directories) do not.
_EVIDENCE = slice(2, 8)
#: Share of ordinary documents that a distance may take for outliers.
LEVEL = 1e-4


def chi_square_quantile(level: float, features: int) -> float:
    """The value that a chi-square of an even number of degrees exceeds with probability ``level``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        x = (lo + hi) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(features // 2))
        lo, hi = (x, hi) if beyond > level else (lo, x)
    return lo


def directed_distance(x: np.ndarray, covariance: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Squared Mahalanobis distance of each row of ``x`` to the nearest point without a positive coordinate."""
    metric, near = np.linalg.inv(covariance), np.minimum(x, 0.0)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            pull = (near - x) @ metric[:, j] - metric[j, j] * (near[:, j] - x[:, j])
            near[:, j] = np.minimum(0.0, x[:, j] - pull / metric[j, j])
    gap = x - near
    return np.einsum("ij,jk,ik->i", gap, metric, gap)


def robust_statistics(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of each language and of all documents ("und"), from its inner three quarters."""
    p = len(FEATURES)
    both = table.select("lang", "f").where(F.col("lang") != "und").unionByName(table.select(F.lit("und").alias("lang"), "f"))
    quartiles = both.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(F.col("f")[i], [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i in range(p)],
    )
    rough = {r["lang"]: (r["n"], np.array([r[f"q{i}"] for i in range(p)])) for r in quartiles.collect()}  # one row a language
    if "und" not in rough:
        return {}
    q = F.create_map(*[x for lang, (_, v) in rough.items() for x in (F.lit(lang), F.array(*[F.lit(float(c)) for c in v[:, 1]]))])
    scale = {lang: np.maximum((v[:, 2] - v[:, 0]) / 1.349, FLOOR) for lang, (_, v) in rough.items()}
    s = F.create_map(*[x for lang, v in scale.items() for x in (F.lit(lang), F.array(*[F.lit(float(c)) for c in v]))])
    d = sum(F.pow((F.col("f")[i] - q[F.col("lang")][i]) / s[F.col("lang")][i], 2) for i in range(p))
    near = both.withColumn("_d", d)
    cuts = {r["lang"]: r["c"] for r in near.groupBy("lang").agg(F.percentile_approx("_d", 0.75, 10000).alias("c")).collect()}
    edge = F.create_map(*[x for lang, c in cuts.items() for x in (F.lit(lang), F.lit(float(c)))])
    inner = near.where(F.col("_d") <= edge[F.col("lang")])
    sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(p)] + [
        F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    out = {}
    for r in inner.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        n, lang = r["n"], r["lang"]
        mu = np.array([r[f"s{i}"] for i in range(p)]) / n
        second = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / n
        out[lang] = (mu, (second - np.outer(mu, mu)) * 1.6 + np.diag(FLOOR**2))
    return {lang: v if rough[lang][0] >= MIN_DOCS else out["und"] for lang, v in out.items()}


def distances(f: np.ndarray, centre: np.ndarray, covariance: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance, directed) of feature rows; ``directed`` is at most ``distance``, and 0 where that is not beyond ``least``."""
    dv = (f - centre) * DIRECTION
    whole = covariance * np.outer(DIRECTION, DIRECTION)
    distance = np.einsum("ij,jk,ik->i", dv, np.linalg.inv(whole), dv)
    directed = np.zeros(len(f))
    far = distance > least
    directed[far] = directed_distance(dv[far][:, _EVIDENCE], whole[_EVIDENCE, _EVIDENCE])
    return distance, directed


def spam_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", level: float = LEVEL) -> DataFrame:
    """(doc_id, lang, n_words, distance, directed, spam): the squared robust Mahalanobis distance, its spam-directed part (0 for
    documents that are no outliers), and whether both are beyond the chi-square quantiles of ``level``."""
    table = cut(measured(docs, doc_id, text, lang), "p10")
    statistics = robust_statistics(table)  # a few numbers for each language
    far = chi_square_quantile(level, len(FEATURES))
    spammy = chi_square_quantile(level, _EVIDENCE.stop - _EVIDENCE.start)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            distance, directed = np.zeros(len(pdf)), np.zeros(len(pdf))
            for g, rows in pdf.groupby("lang").indices.items():
                own = statistics[g] if g in statistics else statistics["und"]
                distance[rows], directed[rows] = distances(np.stack(pdf["f"].iloc[rows].to_list()), *own, far)
            out = pdf[["doc_id", "lang", "n_words"]].assign(distance=distance, directed=directed)
            yield out.assign(spam=(out["distance"] > far) & (out["directed"] > spammy))

    return table.mapInPandas(score, "doc_id long, lang string, n_words long, distance double, directed double, spam boolean")


def spam_documents(docs: DataFrame, level: float = LEVEL, **columns: str) -> DataFrame:
    """The rows of ``spam_scores`` that are flagged."""
    return spam_scores(docs, level=level, **columns).where("spam")
