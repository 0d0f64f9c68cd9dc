"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of a word is the sum, over all
its segmentations into pieces, of the product of their probabilities, by a forward algorithm; a text's score is the
product over its words, which pieces never cross. Words are runs of letters, lower-cased, with the vocabulary's
word-start mark. Probabilities come from expectation maximisation over all segmentations of the training words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import col, map_arrow, unused

MARK = "▁"
LONGEST = 16
ROUNDS = 4
#: Training reads at most this many distinct documents of each language, those with the smallest hash of their text, of at
#: most so many characters, of at most so many languages.
DOCS_PER_LANG = 300
LONGEST_TEXT = 1 << 16
MOST_LANGS = 200
#: Pseudo-counts, in proportion to the pooled counts of all languages, that each language's counts get.
PRIOR = 200.0
#: Longer words are scored in parts of this many characters, so that products stay within doubles.
PART = 40
KEPT_WORDS = 60_000
#: How many times as improbable as in training a word's letters may be, the letters from which on a word tells, the most that
#: one word can say against a text, and what a text may have against it, in nats.
SURPRISE, TELLING, AGAINST, EVIDENCE = 2.2, 4, 8.0, 32.0


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> dict[str, int]:
    """piece -> number, for the pieces of a sentencepiece model with at most LONGEST characters and no control pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return {p: i for i, p in enumerate(dict.fromkeys(p for p in pieces if len(p) <= LONGEST))}


class Pieces:
    """A vocabulary for lookups of many windows at once: by length, sorted hashes with numbers and code points."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int]):
        self.size, self.longest, self.tables = len(vocab), max(map(len, vocab), default=1), {}
        for n in sorted({len(p) for p in vocab if p}):
            own = [p for p in vocab if len(p) == n]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            hashes = np.zeros(len(own), np.uint64)
            for i in range(n):
                hashes = self.step(hashes, codes[:, i])
            order = np.argsort(hashes)
            self.tables[n] = hashes[order], np.array([vocab[p] for p in own], np.int32)[order], codes[order]

    def step(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (hashes ^ (codes.astype(np.uint64) + np.uint64(1))) * self.BASE

    def find(self, n: int, hashes: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece of the n code points from each `at`, -1 where it is none."""
        out = np.full(len(at), -1, np.int32)
        if n in self.tables and len(at):
            sorted_, numbers, points = self.tables[n]
            place = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
            hit = np.flatnonzero(sorted_[place] == hashes)
            same = (codes[at[hit][:, None] + np.arange(n)] == points[place[hit]]).all(axis=1)
            out[hit[same]] = numbers[place[hit[same]]]
        return out


@functools.lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(vocabulary(model_file))


class Lattice:
    """The pieces of many words as arcs, in the order of their ends; the last piece number stands for any unknown character."""

    def __init__(self, words: list[str], pieces: Pieces):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), sizes)
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - begins[owner]
        left = sizes[owner] - place
        self.first = begins + np.arange(len(words))
        self.last, self.size = self.first + sizes, len(codes) + len(words)
        begin, end, piece, step = [], [], [], []
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, pieces.longest + 1):
            some = left[at] >= n
            at, hashes = at[some], hashes[some]
            if not len(at):
                break
            hashes = pieces.step(hashes, codes[at + n - 1])
            found = pieces.find(n, hashes, codes, at)
            if n == 1:
                found[found < 0] = pieces.size
            hit = found >= 0
            node = at[hit] + owner[at[hit]]
            begin.append(node)
            end.append(node + n)
            piece.append(found[hit])
            step.append(place[at[hit]] + n)
        begin, end, piece, step = (np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32) for x in (begin, end, piece, step))
        order = np.argsort(step, kind="stable")
        self.begin, self.end, self.piece = begin[order], end[order], piece[order]
        steps = step[order]
        self.cuts = np.searchsorted(steps, np.arange(1, (int(steps[-1]) if len(steps) else 0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each word's beginnings; p: one language's piece probabilities."""
        sums = np.zeros(self.size)
        sums[self.first] = 1.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            np.add.at(sums, self.end[a:b], sums[self.begin[a:b]] * p[self.piece[a:b]])
        return sums

    def backward(self, p: np.ndarray) -> np.ndarray:
        sums = np.zeros(self.size)
        sums[self.last] = 1.0
        for a, b in zip(self.cuts[:-1][::-1], self.cuts[1:][::-1], strict=True):
            np.add.at(sums, self.begin[a:b], sums[self.end[a:b]] * p[self.piece[a:b]])
        return sums

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations in proportion to their probability."""
        fore, back = self.forward(p), self.backward(p)
        share = np.repeat(weight / np.maximum(fore[self.last], 1e-300), self.last - self.first + 1)
        return np.bincount(self.piece, fore[self.begin] * p[self.piece] * back[self.end] * share[self.begin], minlength=len(p))


def parts(word: str) -> list[str]:
    marked = MARK + word
    return [marked[i : i + PART] for i in range(0, len(marked), PART)]


def words_of(texts: pa.Array) -> pa.ListArray:
    """The runs of letters of each text, lower-cased."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    return pc.split_pattern(pc.utf8_trim(spaced, " "), " ")


def flat_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each word, number of each word, distinct words); the empty word of wordless texts is left out."""
    listed = words_of(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(np.asarray(listed.offsets)))
    coded = listed.flatten().dictionary_encode()
    numbers, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
    if "" in names:
        some = numbers != names.index("")
        rows, numbers = rows[some], numbers[some]
    return rows, numbers, names


class Model:
    """languages, vocabulary and log-probability tables; scores words and keeps the scores of those seen."""

    def __init__(self, model_file: str, languages: list[str], tables: np.ndarray, typical: np.ndarray | None = None):
        """`typical`: each language's mean log-probability of a letter, over its training words."""
        self.model_file, self.languages, self.tables = model_file, languages, tables
        self.typical = np.zeros(len(languages)) if typical is None else typical
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.known = np.empty((0, len(self.languages)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log of the marginal probability of each word in each language."""
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > KEPT_WORDS:
            self._forget()
            new = words
        made = [self.known]
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            cut = [parts(w) if w else [MARK] for w in some]
            lattice = Lattice([p for c in cut for p in c], pieces_of(self.model_file))
            owner = np.repeat(np.arange(len(some)), [len(c) for c in cut])
            made.append(np.stack([np.bincount(owner, np.log(np.maximum(lattice.forward(p)[lattice.last], 1e-300)), minlength=len(some)) for p in self.tables], axis=1))
        at = len(self.seen)
        self.seen.update(zip(new, range(at, at + len(new)), strict=True))
        if new:
            self.known = np.concatenate(made)
        return self.known[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        """The most likely language, its share among the languages, and whether the text can be of it. What speaks against
        that is the sum, over its words of TELLING letters or more, of how much less probable they are than letters SURPRISE
        times as improbable as in training: more probable words outweigh others, no word counts more than AGAINST, and less
        than EVIDENCE in all is no reason, which spares short texts and those with keys or numbers among their words. `und`, 0
        and False for a text with no letter."""
        if not len(texts):
            return [], [], []
        rows, numbers, names = flat_words(texts)
        n, k = len(texts), len(self.languages)
        if not k or not len(rows):
            return ["und"] * n, [0.0] * n, [False] * n
        scores = self.word_scores(names)
        sums = np.stack([np.bincount(rows, scores[numbers, i], minlength=n) for i in range(k)], axis=1)
        some = np.bincount(rows, minlength=n) > 0
        best = sums.argmax(axis=1)
        share = 1 / np.exp(np.minimum(700, sums - sums.max(axis=1, keepdims=True))).sum(axis=1)
        sizes = np.fromiter(map(len, names), float, len(names))[:, None]
        against = np.where(sizes >= TELLING, np.minimum(SURPRISE * self.typical * sizes - scores, AGAINST), 0.0)
        known = some & (np.bincount(rows, against[numbers, best[rows]], minlength=n) <= EVIDENCE)
        return [self.languages[b] if c else "und" for b, c in zip(best, some, strict=True)], np.where(some, share, 0.0).tolist(), known.tolist()


def fit(texts: list[str], langs: list[str], model_file: str, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation from equal probabilities; languages in order of their names."""
    languages = sorted(set(langs))
    pieces = pieces_of(model_file)
    index = np.array([languages.index(x) for x in langs], np.int64)
    rows, numbers, names = flat_words(pa.array(texts, pa.string()))
    counts = np.zeros((len(languages), len(names)))
    np.add.at(counts, (index[rows], numbers), 1.0)
    cut = [parts(w) if w else [MARK] for w in names]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in cut])
    lattice = Lattice([p for c in cut for p in c], pieces)
    size = pieces.size + 1
    uniform = np.full(size, 1 / size)
    tables = np.tile(uniform, (len(languages), 1))
    for _ in range(rounds if len(names) else 0):
        used = np.stack([lattice.expected(t, c[owner]) for t, c in zip(tables, counts, strict=True)])
        pooled = used.sum(axis=0) + 0.01
        used = used + PRIOR * pooled / pooled.sum()
        tables = used / used.sum(axis=1, keepdims=True)
    typical = np.zeros(len(languages))
    if len(names):
        sizes = np.fromiter(map(len, names), float, len(names))
        for i, (table, own) in enumerate(zip(tables, counts, strict=True)):
            logs = np.bincount(owner, np.log(np.maximum(lattice.forward(table)[lattice.last], 1e-300)), minlength=len(names))
            typical[i] = (own @ logs) / max(1.0, own @ sizes)
    return Model(model_file, languages, tables, typical)


def train(docs: DataFrame, model_file: str, text: str = "text", lang: str = "lang", per_lang: int = DOCS_PER_LANG, most: int = MOST_LANGS) -> Model:
    """A model of docs' labelled rows: at most per_lang distinct whole texts of each language, those with the smallest
    hashes, of at most LONGEST_TEXT characters each; so many, and no more, reach the driver, however often rows repeat.
    Null labels and texts are left out; without any labelled row the model knows no language. Of more than `most`
    languages, those with the most distinct texts are learned (ties by name). doc_id and source are not read."""
    value = col(text)
    rows = docs.where(col(lang).isNotNull() & value.isNotNull() & (F.length(value) <= LONGEST_TEXT))
    rows = rows.select(col(lang).cast("string").alias("lang"), F.xxhash64(value).alias("h"), value.cast("string").alias("text"))
    rows = rows.withColumn("bucket", F.shiftright(F.col("h"), 54))
    # distinct texts by the first ten bits of their hash tell how far each language must be read
    counts = rows.select("lang", "bucket", "h").distinct().groupBy("lang", "bucket").count()
    found = counts.groupBy("lang").agg(F.sum("count").alias("n"), F.collect_list(F.struct("bucket", "count")).alias("own"))
    reach = {}
    for r in found.orderBy(F.desc("n"), "lang").limit(most).collect():
        total = 0
        for last, many in sorted(map(tuple, r.own)):
            total += many
            reach[r.lang] = last
            if total >= per_lang:
                break
    if not reach:
        return fit([], [], model_file)
    last = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(reach.items()) for x in kv]), F.col("lang"))
    near = rows.where(F.col("bucket") <= last).groupBy("lang", "h").agg(F.first("text").alias("text"))
    first = near.withColumn("n", F.expr("row_number() over (partition by lang order by h)")).where(F.col("n") <= per_lang)
    got = sorted((r.lang, r.text) for r in first.select("lang", "text").collect())
    return fit([t for _, t in got], [g for g, _ in got], model_file)


def identify(docs: DataFrame, model: Model, text: str = "text", known: str | None = None) -> DataFrame:
    """Adds lang_pred string and score double (the share of the best language among all learned ones), and, if a name is
    given, `known` boolean: whether the text can be of that language at all.

    Whole texts are scored. A text that is null or has no letter is `und` with score 0; equal scores go to the
    language first by name. Input columns of these names are replaced; repeated rows agree; empty input, empty output.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    fields += [T.StructField(known, T.BooleanType())] if known else []
    made = {f.name.lower() for f in fields}
    kept = [c for c in docs.columns if c.lower() not in made]

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for at in range(0, rows.num_rows, 1024):
            raw = arrays[0].slice(at, 1024).to_pylist()
            got = model.predict(pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.large_string()))
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield rows.slice(at, 1024), [pa.array(x, t) for x, t in zip(got, kinds)][: len(fields)]

    return map_arrow(docs, kept, [col(text).cast("binary")], fields, make)


def held_out(doc_id) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9(docs: DataFrame, model_file: str) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))), model_file)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model_file: str, least: float = 0.5) -> DataFrame:
    """docs less those whose language the method rejects: no letter (so null and empty texts), no language with a share of
    `least`, or letters too improbable for the best language, as in languages that were not learned or in random text.
    Repeated rows share their fate; an empty table stays empty; without any label no language is known, and all go."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    model = train(docs.where(~held_out(F.col("doc_id"))), model_file)
    found = identify(docs.toDF(*inner), model, f"c{names.index('text')}", "known")
    stays = (F.col("lang_pred") != "und") & (F.col("score") >= least) & F.col("known")
    return found.where(stays).select(*inner).toDF(*names)
