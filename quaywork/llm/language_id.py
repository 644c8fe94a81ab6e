"""Language ID by interpolated Kneser-Ney character models, one for each language.

Characters are letters (lower case) and a space for every run of anything else, so a document is a string over a small
alphabet. For each language the distinct n-grams are counted by Spark over a bounded sample of labelled rows; lower
orders count the distinct characters that come before an n-gram (continuation counts), and each order is discounted and
interpolated with the one below. An n-gram of up to four characters packs into 64 bits; every order is a sorted array of
those codes with a column of log-probabilities for each language, looked up by binary search. The language is that of
the lowest cross-entropy per character; a document whose cross-entropy is far above what labelled documents of its
language have is rejected.

Style: training counts are Spark aggregates, the model is bounded by the sample and the alphabet, and scoring is one
map over Arrow batches without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick
from ._text import give_back, slices

ORDER = 4
#: Expected number of labelled documents of each language that the model is fitted on, and of those that calibrate it.
SAMPLE, CALIBRATION = 1500, 300
#: Standard deviations above the mean cross-entropy of its language from which a document is rejected.
TOLERANCE = 6.0
UNKNOWN = "und"
SPACE = 32
#: Log-probabilities are whole multiples of 1 / UNIT bits, so their sums don't depend on the order of adding.
UNIT = 1 << 20
#: Characters that are looked up at once, and bytes of the texts that are handled together (a longer text: alone).
BLOCK, SLICE = 1 << 17, 1 << 19
MASKS = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, else a space; letters beyond 16 bits share the last code."""
    table = np.full(0x110000, SPACE, dtype=np.uint16)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = min(ord(low) if len(low) == 1 else code, 0xFFFF)
    return table


_TABLE: list[np.ndarray] = []


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts after one another, with one space before each and after the last, and where those spaces stand.

    Whatever isn't a letter at the ends of a text is part of those spaces, so a text has the same codes beside any other.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    filled = pc.fill_null(texts.cast(pa.string()), "")
    raw = np.frombuffer(" ".join(["", *filled.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _TABLE[0][raw]
    edge = np.zeros(len(codes), dtype=bool)
    edge[np.concatenate([[0], np.cumsum(pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])] = True
    keep = (codes != SPACE) | edge
    keep[1:] |= codes[:-1] != SPACE  # the first of a run
    codes, edge = codes[keep], edge[keep]
    keep = (codes != SPACE) | edge
    keep[:-1] |= ~edge[1:]
    return codes[keep], np.flatnonzero(edge[keep])


def packed(codes: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """The last ``ORDER`` characters up to each place from ``a`` >= 1 to ``b`` in 64 bits; before a text stand spaces."""
    at = np.arange(a, b)
    place = at - starts[np.searchsorted(starts, at) - 1]
    out = codes[a:b].astype(np.uint64)
    for k in range(1, ORDER):
        before = np.where(place >= k, codes[np.maximum(at - k, 0)], SPACE).astype(np.uint64)
        out |= before << np.uint64(16 * k)
    return out


@dataclass
class CharacterModels:
    """``grams[k]``: sorted codes of order k + 1, ``logs[k]`` their log2 probabilities by language, times ``UNIT``;
    ``contexts[k]``: sorted codes of k characters, ``backoffs[k]`` log2 of the weight of the order below after them."""

    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> CharacterModels:
        """From the distinct codes of the highest order and their counts in each language."""
        langs = sorted(counts)
        every = [[None] * ORDER for _ in langs]
        for i, lang in enumerate(langs):
            codes, n = counts[lang]
            order = np.argsort(codes)
            codes, n = codes[order], n[order].astype(np.float64)
            every[i][ORDER - 1] = (codes, n)
            for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
                codes, n = np.unique(codes & MASKS[k], return_counts=True)
                every[i][k - 1] = (codes, n.astype(np.float64))
        alphabet = max(1, len(np.unique(np.concatenate([e[0][0] for e in every])))) if langs else 1
        model = cls(langs, floor=np.full(len(langs), round(-np.log2(alphabet + 1.0) * UNIT), dtype=np.int32))
        for k in range(ORDER):
            grams = np.unique(np.concatenate([e[k][0] for e in every])) if langs else np.zeros(0, np.uint64)
            contexts = np.unique(grams >> np.uint64(16)) if k else np.zeros(1, np.uint64)
            logs, backs = np.zeros((len(grams), len(langs))), np.zeros((len(contexts), len(langs)))
            below = model.lookup(grams & MASKS[k], k - 1) / UNIT
            for i in range(len(langs)):
                codes, n = every[i][k]
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
                at = np.searchsorted(contexts, codes >> np.uint64(16)) if k else np.zeros(len(codes), dtype=np.int64)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                own = np.zeros(len(grams))
                own[np.searchsorted(grams, codes)] = n - discount
                of = np.searchsorted(contexts, grams >> np.uint64(16)) if k else np.zeros(len(grams), dtype=np.int64)
                logs[:, i] = np.log2(own / np.maximum(total[of], 1) + weight[of] * np.exp2(below[:, i]))
                backs[:, i] = np.log2(weight)
            model.grams.append(grams)
            model.logs.append(np.rint(logs * UNIT).astype(np.int32))
            model.contexts.append(contexts)
            model.backoffs.append(np.rint(backs * UNIT).astype(np.int32))
        return model

    def lookup(self, codes: np.ndarray, top: int) -> np.ndarray:
        """log2 probability, times ``UNIT``, by language of each code's last character, from order ``top`` + 1 downwards."""
        out = np.zeros((len(codes), len(self.langs)), dtype=np.int32)
        left = np.arange(len(codes))
        for k in range(top, -1, -1):
            if not len(left) or not len(self.grams[k]):
                continue
            want = codes[left] & MASKS[k + 1]
            at = np.minimum(np.searchsorted(self.grams[k], want), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == want
            out[left[hit]] += self.logs[k][at[hit]]
            left, want = left[~hit], want[~hit]
            if len(left):
                context = want >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
                seen = self.contexts[k][at] == context
                out[left[seen]] += self.backoffs[k][at[seen]]
        out[left] += self.floor
        return out

    def entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text by language, and its number of letters."""
        codes, starts = characters(texts)
        rows = len(starts) - 1
        sums, letters = np.zeros((rows, len(self.langs)), dtype=np.int64), np.zeros(rows, dtype=np.int64)
        if not rows:
            return sums / UNIT, letters
        # a text's characters are those after the space before it, up to the space after it
        for a in range(1, len(codes), BLOCK):
            b = min(a + BLOCK, len(codes))
            own = slice(np.searchsorted(starts, a) - 1, np.searchsorted(starts, b - 1))
            cuts = np.maximum(starts[own] + 1, a) - a
            sums[own] += np.add.reduceat(self.lookup(packed(codes, starts, a, b), ORDER - 1), cuts, axis=0, dtype=np.int64)
            letters[own] += np.add.reduceat(codes[a:b] != SPACE, cuts, dtype=np.int64)
        return -sums / UNIT / np.diff(starts)[:, None], letters

    def predict(self, texts: pa.Array) -> dict[str, np.ndarray]:
        bits, letters = self.entropy(texts)
        rows = len(letters)
        if not self.langs:
            return {"lang": np.full(rows, UNKNOWN, dtype=object), "score": np.zeros(rows), "bits": np.zeros(rows), "rejected": np.ones(rows, dtype=bool)}
        best = bits.argmin(axis=1)
        low = bits[np.arange(rows), best]
        score = 1 / np.exp2(-8 * (bits - low[:, None])).sum(axis=1)
        some = letters > 0
        rejected = ~some
        if self.mean is not None:
            rejected |= low > self.mean[best] + TOLERANCE * self.spread[best] * np.sqrt(1 + 400 / np.maximum(letters, 1))
        return {"lang": np.where(some, np.array(self.langs, dtype=object)[best], UNKNOWN), "score": np.where(some, score, 0.0), "bits": np.where(some, low, 0.0), "rejected": rejected}


def _sampled(labelled: DataFrame) -> DataFrame:
    """Rows of the sample with ``part``: 0 to fit, 1 to calibrate; chosen by a hash of doc_id and text, repeated rows once.

    The languages and their totals are in the plan (the model has a column for each anyway); only sampled texts move.
    """
    totals = labelled.groupBy("lang").agg(F.count("*").alias("total")).collect()
    if not totals:
        return labelled.select("lang", F.lit(0).alias("part"), "text")
    total = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], float(r["total"]))])[F.col("lang")]
    key = F.xxhash64("doc_id", "text", F.lit("language"))
    place = F.pmod(key, F.lit(1 << 30)) / float(1 << 30) * total
    part = (place >= F.least(total, F.lit(float(SAMPLE + CALIBRATION))) * (SAMPLE / (SAMPLE + CALIBRATION))).cast("int")
    rows = labelled.where(place < SAMPLE + CALIBRATION).select("lang", part.alias("part"), key.alias("key"), "text")
    return rows.groupBy("lang", "part", "key").agg(F.first("text").alias("text")).drop("key")


def train(labelled: DataFrame) -> CharacterModels:
    """Models of the languages of ``labelled`` (doc_id, text, lang), without rows whose text or lang is null.

    About ``SAMPLE`` documents of each language are learned from and ``CALIBRATION`` say what is usual; texts without
    letters say nothing.
    """
    rows = _sampled(pick(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                for part in slices(batch.filter(pc.equal(batch.column("lang"), lang)), most=SLICE):
                    codes, starts = characters(part.column("text"))
                    some = np.repeat(np.diff(starts) > 1, np.diff(starts))
                    for a in range(1, len(codes), BLOCK):
                        b = min(a + BLOCK, len(codes))
                        grams, n = np.unique(packed(codes, starts, a, b)[some[a - 1 : b - 1]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.where("part = 0").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    own = {lang: counted.filter(pc.equal(counted.column("lang"), lang)) for lang in pc.unique(counted.column("lang")).to_pylist()}
    model = CharacterModels.fit({lang: (part.column("gram").to_numpy().view(np.uint64), part.column("n").to_numpy()) for lang, part in own.items()})

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {lang: i for i, lang in enumerate(model.langs)}
        for batch in batches:
            for part in slices(batch, most=SLICE):
                bits, letters = model.entropy(part.column("text"))
                own = [bits[r, at[lang]] if lang in at and n >= 40 else None for r, (lang, n) in enumerate(zip(part.column("lang").to_pylist(), letters.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(own, pa.float64())], ["lang", "bits"])

    own = rows.where("part = 1").select("lang", "text").mapInArrow(calibrate, "lang string, bits double").where("bits is not null")
    # the middle half says how far ordinary documents spread; mislabelled or odd ones don't widen it
    found = {r["lang"]: r["q"] for r in own.groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.5, 0.75, 0.95], 1000).alias("q")).collect()}
    if found:
        middle = np.mean([q[1] for q in found.values()])
        model.mean = np.array([found[lang][1] if lang in found else middle for lang in model.langs])
        model.spread = np.array([max((found[lang][2] - found[lang][0]) / 1.35, (found[lang][3] - found[lang][1]) / 1.65, 0.15) if lang in found else 0.5 for lang in model.langs])
    return model


def identify(docs: DataFrame, model: CharacterModels, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, bits, rejected for every row's whole ``text``.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no letter. score is the share
    of the best language among all, by the differences of their bits per character. rejected: no letters, or bits per
    character too high for the language (more is allowed to short texts). Rows are independent: ties between languages
    go to the first by name, repeated rows get the same answer; no rows give no rows; other columns are never read.
    """
    source = pick(docs, *keep, *([] if "text" in keep else ["text"]))
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                p = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(p["lang"].tolist(), pa.string()), pa.array(p["score"]), pa.array(p["bits"]), pa.array(p["rejected"])], [*keep, "lang_pred", "score", "bits", "rejected"])
        give_back()

    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double, rejected boolean")
