"""Reading level of each document's own prose, by a latent difficulty model of the Rasch kind.

A document has a level, a word a difficulty: the rate of a word among the running words of a
document of level t is exp(a + b t), over the sum of these for all words of its language. As in
Rasch's model a document's level then depends on its words only through one sum, that of the b of
its running words. Levels and words are estimated in turn, as distributed aggregations; documents
that people gave a band are held at it, and after each round the levels are mapped onto the bands by
a monotone regression over them, so that the scale can't drift. Long but childish and short but
learned words are told apart by where they occur, not by their form.

Only what is bounded by fixed grids goes to the driver: sums per language and level, at most
26 * 26 languages by 61 levels.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.prose import words
from strata.llm.tokens import spread
from strata.scratch import Scratch

#: Levels run over this grid; bands are its whole numbers from 1 to 5.
GRID = np.round(np.linspace(0, 6, 61), 1)
CENTRE = 3.0
#: Weight of a document without a band in the estimates of words.
UNLABELLED = 0.1
#: Fewer running words of own prose than this are never a case.
LEAST_WORDS = 10
#: The estimates have converged once levels move by less than this from one round to the next, on average.
TOLERANCE = 0.05
#: Rounds after which an estimate that does not settle is returned with a warning.
MOST_ROUNDS = 30
#: Tables with one row per word are joined by broadcast up to this many rows of about 50 bytes, by a shuffle beyond.
FEW_WORDS = 200_000


def _by_word(table: DataFrame) -> DataFrame:
    """A written table of words, marked for broadcast if it is small."""
    return F.broadcast(table) if table.count() <= FEW_WORDS else table


def bags(documents: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, words, counts) of the own prose of every document; tag is the declared
    language's first two letters, NULL where there are none. Repeated ids give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            tags = [t if (t := (x or "").strip().lower()[:2]).isascii() and len(t) == 2 and t.isalpha() else None for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(tags, pa.string()), pa.array([sum(c.values()) for c in found], pa.int64()),
                    pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "tag", "n_words", "words", "counts"],
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text", "lang"), "doc_id").mapInArrow(
        run, "doc_id bigint, tag string, n_words bigint, words array<string>, counts array<int>"
    )


def _runs(bag: DataFrame, *more: str) -> DataFrame:
    return bag.select("doc_id", *more, F.explode(F.arrays_zip("words", "counts")).alias("x")).select("doc_id", *more, F.col("x.words").alias("word"), F.col("x.counts").alias("n"))


def languages(bag: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang): the language whose documents share its words; declared ones are often wrong."""
    seen = _runs(bag.where("tag IS NOT NULL"), "tag").groupBy("word", "tag").agg(F.count(F.lit(1)).alias("docs"))
    gain = _by_word(scratch.cut(seen.select("word", "tag", F.log((F.col("docs") + 0.1) / 0.1).alias("gain"))))
    scores = _runs(bag).select("doc_id", "word").join(gain, "word").groupBy("doc_id", "tag").agg(F.sum("gain").alias("score"))
    return scores.groupBy("doc_id").agg(F.max_by("tag", F.struct("score", "tag")).alias("lang"))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone regression of y on ascending x by pooling: the knots to interpolate between."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([b, w, a * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b2, w2, a2 = pools.pop()
            b1, w1, a1 = pools.pop()
            pools.append([(b1 * w1 + b2 * w2) / (w1 + w2), w1 + w2, a1 + a2])
    return np.array([a / w for _, w, a in pools]), np.array([b for b, _, _ in pools])


def _fitted_words(items: DataFrame, mass: dict[str, np.ndarray]) -> DataFrame:
    """(lang, word, a, b): each word's own Newton steps against the expected counts on the level grid."""
    g = GRID - CENTRE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.stack([mass[x] for x in f["lang"]]) if len(f) else np.zeros((0, len(g)))
            n, t = f["n"].to_numpy(), f["t"].to_numpy()
            a, b = np.log((n + 0.1) / (m.sum(1) + 1)), np.zeros(len(f))
            for _ in range(8):
                rate = m * np.exp(np.clip(a[:, None] + b[:, None] * g, -30, 3))
                s0, s1, s2 = rate.sum(1) + 1e-6, (rate * g).sum(1), (rate * g * g).sum(1) + 1
                d0, d1 = n - s0, t - s1 - b
                det = s0 * s2 - s1 * s1
                a += np.clip((s2 * d0 - s1 * d1) / det, -2, 2)
                b += np.clip((s0 * d1 - s1 * d0) / det, -1, 1)
            yield pd.DataFrame({"lang": f["lang"], "word": f["word"], "a": a, "b": b})

    return items.mapInPandas(run, "lang string, word string, a double, b double")


def _norms(params: DataFrame) -> dict[str, np.ndarray]:
    """The log of the sum of all words' rates, per language, over the grid."""
    g = GRID - CENTRE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            rates = np.exp(np.clip(f["a"].to_numpy()[:, None] + f["b"].to_numpy()[:, None] * g, -30, 3))
            for lang, rows in f.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, 0) + rates[rows].sum(0)
        yield pd.DataFrame({"lang": list(sums), "z": [v.tolist() for v in sums.values()]})

    parts = params.mapInPandas(run, "lang string, z array<double>").select("lang", F.posexplode("z").alias("i", "z"))
    out: dict[str, np.ndarray] = {}
    for lang, i, z in parts.groupBy("lang", "i").agg(F.sum("z")).collect():
        out.setdefault(lang, np.ones(len(GRID)))[i] = z
    return {k: np.log(v) for k, v in out.items()}


def _best_levels(sums: DataFrame, norms: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, raw): the grid level of greatest posterior from each document's sum of b."""
    g = GRID - CENTRE

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            z = np.stack([norms[x] for x in f["lang"]]) if len(f) else np.zeros((0, len(g)))
            score = f["s"].to_numpy()[:, None] * g - f["n_words"].to_numpy()[:, None] * z - 0.5 * (g / 2) ** 2
            yield pd.DataFrame({"doc_id": f["doc_id"], "raw": GRID[score.argmax(1)] if len(f) else np.zeros(0)})

    return sums.mapInPandas(run, "doc_id bigint, raw double")


def _mapped(raw: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, raw, level): raw levels on the scale of the bands, by monotone regression over all labels."""
    knots = raw.join(bands, "doc_id").groupBy("raw").agg(F.avg("band").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("raw").collect()
    x, y = monotone(*(np.array([float(r[i]) for r in knots]) for i in range(3)))
    table = F.array(*[F.lit(float(v)) for v in np.interp(GRID, x, y)])
    return raw.select("doc_id", "raw", table[F.round(F.col("raw") * 10).cast("int")].alias("level"))


def levels(
    documents: DataFrame, labels: DataFrame, *, tolerance: float = TOLERANCE, moves: list[float] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_words, level): one row per document, level on the scale of the bands, 1 to 5.

    Words and levels are estimated in turn until levels move by less than ``tolerance`` on average;
    ``moves`` takes up the mean move of each round. Warns where this takes over ``MOST_ROUNDS``.

    ``documents``: doc_id, text, lang; ``labels``: doc_id, band, possibly several per document, of
    which the mean counts. A document without own words has no level, nor has any document if no
    labelled one has words. NULL bands and labels of unknown documents are ignored.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    bag = scratch.cut(bags(documents))
    shown = bag.select("doc_id", "n_words")
    bands = labels.where("band IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("band").alias("band"))
    lang = languages(bag, scratch)
    bag = scratch.cut(bag.where("n_words > 0").join(lang, "doc_id", "left").join(bands, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("--")).alias("lang"), "n_words", "words", "counts", "band"))
    bands = bag.where("band IS NOT NULL").select("doc_id", "band")
    if bands.isEmpty():
        return shown.withColumn("level", F.lit(None).cast("double"))
    # first levels: each word at the mean band of its labelled documents, each document at its words' mean
    known = _runs(bag.where("band IS NOT NULL"), "lang", "band").groupBy("lang", "word").agg(
        ((F.sum(F.col("n") * F.col("band")) + CENTRE) / (F.sum("n") + 1)).alias("score")
    )
    known = _by_word(scratch.cut(known))
    first = _runs(bag, "lang").join(known, ["lang", "word"], "left").groupBy("doc_id").agg(
        (F.sum(F.col("n") * F.coalesce("score", F.lit(CENTRE))) / F.sum("n")).alias("mean")
    )
    now = scratch.cut(_mapped(first.select("doc_id", F.round("mean", 1).alias("raw")), bands))
    moves = [] if moves is None else moves
    while not moves or moves[-1] > tolerance:
        if len(moves) >= MOST_ROUNDS:
            warnings.warn(f"levels still move by {moves[-1]:.3f} after {MOST_ROUNDS} rounds", stacklevel=2)
            break
        place = [
            F.round(F.coalesce("band", "level"), 1).alias("level"), F.when(F.col("band").isNull(), UNLABELLED).otherwise(1.0).alias("weight"),
        ]
        held = bag.join(now.select("doc_id", "level"), "doc_id")
        mass: dict[str, np.ndarray] = {}
        for x, level, m in held.select("lang", "n_words", *place).groupBy("lang", "level").agg(F.sum(F.col("n_words") * F.col("weight"))).collect():
            mass.setdefault(x, np.zeros(len(GRID)))[int(round(level * 10))] += m
        items = _runs(held.select("doc_id", "lang", *place, "words", "counts"), "lang", "level", "weight").groupBy("lang", "word").agg(
            F.sum(F.col("n") * F.col("weight")).alias("n"), F.sum(F.col("n") * F.col("weight") * (F.col("level") - CENTRE)).alias("t")
        )
        params = scratch.cut(_fitted_words(items, mass))
        norms = _norms(params)
        sums = _runs(bag, "lang", "n_words").join(_by_word(params).select("lang", "word", "b"), ["lang", "word"]).groupBy("doc_id", "lang", "n_words").agg(F.sum(F.col("n") * F.col("b")).alias("s"))
        nxt = scratch.cut(_mapped(_best_levels(sums, norms), bands))
        both = nxt.join(now.select("doc_id", F.col("level").alias("before")), "doc_id")
        moves.append(both.agg(F.avg(F.abs(F.col("level") - F.col("before")))).first()[0] or 0.0)
        scratch.drop(now)
        now = nxt
    return shown.join(now.select("doc_id", "level"), "doc_id", "left")
