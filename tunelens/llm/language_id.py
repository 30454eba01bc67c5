"""Language ID by words first, then by ever shorter character n-grams.

Per language the model holds the commonest words and the commonest character n-grams of each length
with their log frequencies. A word that some language knows is scored by its frequency in each; an
unseen word falls back to its n-grams of the greatest length of which any is known, then to shorter
ones. A text's score is the mean over its words, and the language with the best mean wins.

``fit`` counts over a bounded sample of labelled documents (``max_documents`` of each language, the
first by CRC-32 of the id), so the tables that every task receives are bounded by ``max_words`` and
``max_grams`` for each language. ``identify`` reads every whole text once and shuffles nothing.

Defined results: null text and text without a letter are ``und`` with score 0; text with letters of
which nothing is known gets the first learned language (by number of words, then name) with
score 1 / languages; ties go to the earlier language by name; without labelled rows everything is
``und``; rows are judged one by one, so repeated rows agree; all input columns are carried along,
and the new columns' names are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.llm.tokens import Words, chunks, mix

ORDER_RANGES = 1_024
MAX_DOCUMENTS = 2_000
MAX_WORDS = 20_000
MAX_GRAMS = 10_000
GRAM_SIZES = (5, 4, 3, 2, 1)
PENALTY = 7.0  # minus log10 frequency of what a language does not know
UNKNOWN = "und"

NOT_LETTERS = np.ones(256, bool)  # of ASCII only; bytes of other scripts belong to words
NOT_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False
COUNTED = "lang string, size int, code long, n long"


def _words(column: pa.Array) -> Words:
    return Words(pc.utf8_lower(column.cast(pa.large_string())), NOT_LETTERS, lower=False)


def _grams(words: Words, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character n-grams of the chosen words, edges marked, and the word of each."""
    spans = [bytes(words.data[words.starts[w] : words.ends[w]]).decode("utf-8", "replace") for w in chosen]
    flat = np.frombuffer("".join(f" {s} " for s in spans).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(s) + 2 for s in spans], np.int64)
    of = np.repeat(np.arange(len(spans)), lengths)
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        code = np.full(n, size, np.uint64)
        for k in range(size):
            code = mix(code * np.uint64(31) + flat[k : k + n])
    whole = of[:n] == of[size - 1 :]
    return code[whole], of[:n][whole]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for part in chunks(texts):
            some = texts.slice(part.start, part.stop - part.start)
            names, row_lang = np.unique(
                langs.slice(part.start, part.stop - part.start).to_numpy(zero_copy_only=False).astype(str),
                return_inverse=True,
            )
            words = _words(some)
            lang = row_lang[words.doc]
            codes, first, inverse = np.unique(words.codes(), return_index=True, return_inverse=True)
            per = np.zeros((len(names), len(codes)), np.int64)
            np.add.at(per, (lang, inverse), 1)
            found = [(0, codes, per)]
            for size in GRAM_SIZES:
                grams, of = _grams(words, first, size)
                keys, place = np.unique(grams, return_inverse=True)
                sums = np.stack([np.bincount(place, per[i][of], len(keys)) for i in range(len(names))])
                found.append((size, keys, sums.astype(np.int64)))
            for size, keys, sums in found:
                which, where = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[which], pa.string()),
                        pa.array(np.full(len(which), size, np.int32)),
                        pa.array(keys[where].astype(np.int64)),
                        pa.array(sums[which, where]),
                    ],
                    names=["lang", "size", "code", "n"],
                )


class Model:
    """Log frequencies of words (size 0) and n-grams by code, one column for each language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.tables = tables

    def look_up(self, size: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each code in the table of that size, and whether it is known."""
        keys, _ = self.tables[size]
        if not len(keys):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return at, keys[at] == codes

    def costs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct word its cost in every language (nan: nothing known), and each word's place."""
        codes, first, inverse = np.unique(words.codes(), return_index=True, return_inverse=True)
        at, known = self.look_up(0, codes)
        costs = np.full((len(codes), len(self.languages)), np.nan, np.float32)
        costs[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for size in GRAM_SIZES:
            if not len(left):
                break
            grams, of = _grams(words, first[left], size)
            at, known = self.look_up(size, grams)
            n = np.bincount(of[known], minlength=len(left))
            rows = self.tables[size][1][at[known]]
            sums = np.stack([np.bincount(of[known], rows[:, i], len(left)) for i in range(len(self.languages))], 1)
            some = n > 0
            costs[left[some]] = sums[some] / n[some, None]
            left = left[~some]
        return costs, inverse

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = _words(texts)
        n_rows, n_langs = len(texts), len(self.languages)
        lettered = _has_letter(texts, words)
        if not n_langs:
            return [UNKNOWN] * n_rows, np.zeros(n_rows)
        sums, counted = np.zeros((n_rows, n_langs)), np.zeros(n_rows)
        if len(words.starts):
            costs, place = self.costs(words)
            each = costs[place]
            usable = ~np.isnan(each[:, 0])
            doc = words.doc[usable]
            counted = np.bincount(doc, minlength=n_rows).astype(float)
            sums = np.stack([np.bincount(doc, each[usable, i], n_rows) for i in range(n_langs)], 1)
        mean = sums / np.maximum(counted, 1)[:, None]
        best = mean.argmin(1)
        chance = 10.0 ** -(mean - mean.min(1, keepdims=True))
        score = np.where(lettered, 1.0 / chance.sum(1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def _has_letter(texts: pa.Array, words: Words) -> np.ndarray:
    """Whether a text has a letter: at once for ASCII ones, by character where all bytes are others."""
    data = words.data
    ascii_letter = np.concatenate([[0], np.cumsum((data >= ord("a")) & (data <= ord("z")))])
    found = np.diff(ascii_letter[words.bounds]) > 0
    for row in np.flatnonzero(~found & (words.counts > 0)):
        found[row] = any(map(str.isalpha, texts[int(row)].as_py()))
    return found


def fit(
    documents: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    max_words: int = MAX_WORDS,
    max_grams: int = MAX_GRAMS,
) -> Model:
    """The model of text and lang columns; rows without a language, a text or an id teach nothing."""
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # How many ids each of ORDER_RANGES ranges of the order holds tells where the first max_documents
    # end, so no task sorts all ids of a language.
    placed = labelled.select("doc_id", "lang", order.alias("__order"))
    size = 2**32 // ORDER_RANGES
    ranges = placed.groupBy("lang", F.floor(F.col("__order") / size).alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    ends = ranges.withColumn("before", before).filter(F.col("before") < max_documents)
    ends = ends.groupBy("lang").agg(((F.max("range") + 1) * size).alias("__end"))
    first = Window.partitionBy("lang").orderBy("__order", "doc_id")
    chosen = (
        placed.join(ends, "lang")
        .filter(F.col("__order") < F.col("__end"))
        .withColumn("__place", F.row_number().over(first))
        .filter(F.col("__place") <= max_documents)
        .select("doc_id", "lang")
    )
    # At most max_documents ids of each language.
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(_count, COUNTED)
    summed = counts.groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "code"))
    total = F.sum("n").over(Window.partitionBy("lang", "size"))
    kept = (
        summed.withColumn("total", total)
        .withColumn("place", rank)
        .filter(F.col("place") <= F.when(F.col("size") == 0, max_words).otherwise(max_grams))
        .select("lang", "size", "code", "n", "total")
        .toArrow()
        .to_pandas()
    )
    languages = sorted(kept["lang"].unique())
    tables = {}
    for size in (0, *GRAM_SIZES):
        rows = kept[kept["size"] == size]
        keys, place = np.unique(rows["code"].to_numpy(np.int64).astype(np.uint64), return_inverse=True)
        table = np.full((len(keys), len(languages)), PENALTY, np.float32)
        table[place, np.searchsorted(languages, rows["lang"])] = -np.log10(rows["n"] / rows["total"])
        tables[size] = keys, table
    return Model(languages, tables)


def language_of(text: Column, model: Model) -> Column:
    """struct<lang string, score double> for every text."""

    @F.arrow_udf("struct<lang string, score double>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            langs: list[str] = []
            scores = [np.zeros(0)]
            for part in chunks(column):
                lang, score = model.judge(column.slice(part.start, part.stop - part.start))
                langs += lang
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["lang", "score"]
            )

    return judged(text)


def identify(documents: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All input columns and the predicted language with its score.

    Input columns that have the names of these two are replaced.
    """
    found = documents.withColumn("__found", language_of(F.col("text"), model))
    return found.withColumns({lang: F.col("__found.lang"), score: F.col("__found.score")}).drop("__found")
