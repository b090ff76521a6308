"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language,
fitted by expectation maximisation over all segmentations of the training
words.  A word's probability is the sum over all its segmentations into pieces
of any length (the forward algorithm, rescaled on its way, so that runs of any
length neither underflow nor are cut); a text's is the product over its words
(runs of letters, lower case).  The score is the posterior of the best language
under equal priors.

The fit reads a bounded sample: ``per_language`` labelled documents of each
language, those with the smallest hashes of their ids, none of them held out; it
sends the driver counts of their distinct words, of which runs of more than
WINDOW letters are cut for the fit alone.  Every labelled language is learnt; a
table with more than LANGUAGES of them is refused.  Scoring reads every text
whole and computes each distinct word of a task once.  A run of more than WINDOW
letters is summed window by window, with the last positions alone in memory.

Defined edge cases: a letter is a character of Unicode category L (``\u00bd`` and
``\u2167`` are none); a text that is null or has no letter is ``und`` with score 0;
rows without a language are not learnt from; with no labelled row at all every
text is ``und``; ids may be null or repeat; ties go to the language that sorts
first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, smallest_hashes, table
from .kernels import chunks, segment_sums, text_buffer, words
from .wordcache import WordCache

PER_LANGUAGE = 400
#: Languages of a table at most: the model has a number for each piece and language.
LANGUAGES = 2048
#: Letters of a run that are held at once.
WINDOW = 1 << 14
#: Probability of a character that is no piece.
FLOOR = 1e-7
ROUNDS = 3
#: Positions between two rescalings, and numbers held for a group of words at once.
STEP, CELLS = 8, 1 << 21
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
_MARK = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def vocabulary(model_path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, lower-cased."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    return sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U)


class Lattice:
    """All segmentations of a list of words into pieces, by word length."""

    def __init__(self, pieces: list[str], width: int = 1):
        self.width = width
        hashes, lengths = np.zeros(len(pieces), _U), np.array([len(p) for p in pieces])
        for n in np.unique(lengths):
            some = np.flatnonzero(lengths == n)
            h = np.zeros(len(some), _U)
            for c in _codes([pieces[i] for i in some]).reshape(len(some), n).T:
                h = (h * _BASE) ^ (c + _U(1))
            hashes[some] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._low(self.hashes)] = True
        self.size, self.longest = len(pieces), int(lengths.max()) if len(pieces) else 1

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(29))) & _U((1 << 20) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(self.bits[self._low(h)])
        wanted = h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), self.size - 1)
        out[maybe] = np.where(self.hashes[at] == wanted, self.ids[at], -1)
        return out

    def edges(self, text: str) -> np.ndarray:
        """Of one text: at [l - 1, i] the piece id (-1: none) of length l at position i."""
        n = len(text)
        codes, out, h = _codes([text]) + _U(1), np.full((self.longest, n), -1, np.int32), np.zeros(n, _U)
        for size in range(1, min(self.longest, n) + 1):
            h = (h[: n - size + 1] * _BASE) ^ codes[size - 1 :]
            out[size - 1, : len(h)] = self._find(h)
        return out

    def groups(self, texts: list[str]):
        """Yield (indices of words of one length, edges); edges[l - 1][:, i] are the
        piece ids (-1: none) of length l at position i."""
        lengths = np.array([len(x) for x in texts])
        for n in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == n)
            most = max(1, CELLS // ((n + 1) * max(self.width, 4)))
            for k in range(0, len(some), most):
                part = some[k : k + most]
                codes = _codes([texts[i] for i in part]).reshape(len(part), n) + _U(1)
                edges, h = [], np.zeros(codes.shape, _U)
                for size in range(1, min(self.longest, n) + 1):
                    h = (h[:, : n - size + 1] * _BASE) ^ codes[:, size - 1 :]
                    edges.append(self._find(h))
                yield part, edges


def _weights(p: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Probabilities (words, languages) of an edge."""
    return np.where(ids[:, None] >= 0, p[ids], FLOOR if size == 1 else 0.0)


def forward(p: np.ndarray, edges: list[np.ndarray], back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(value, scale), both (characters + 1, words, languages): value[j] * exp(scale[j]) is
    the summed probability of all segmentations of the first j characters, or with
    ``back`` of those from j on."""
    m, n = edges[0].shape
    there = [(x >= 0).any(axis=0) for x in edges]
    value, scale = np.zeros((n + 1, m, p.shape[1])), np.zeros((n + 1, m, p.shape[1]))
    value[n if back else 0] = 1
    now = np.zeros((m, p.shape[1]))
    for step in range(n + 1):
        at = n - step if back else step
        if step and step % STEP == 0:
            # what is still open ahead; what lies behind keeps its scale
            ahead = slice(max(0, at - len(edges)), at + 1) if back else slice(at, at + len(edges) + 1)
            most = value[ahead].max(axis=0)
            value[ahead] /= most
            now = now + np.log(most)
        scale[at] = now
        for size in range(1, min(len(edges), at if back else n - at) + 1):
            i = at - size if back else at
            if size == 1 or there[size - 1][i]:
                value[i if back else at + size] += value[at] * _weights(p, edges[size - 1][:, i], size)
    return value, scale


def log_probability(p: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Of each word in each language."""
    value, scale = forward(p, edges)
    return np.log(value[-1]) + scale[-1]


def windowed_probability(p: np.ndarray, lattice: Lattice, text: str) -> np.ndarray:
    """The same of one word of any length.  Only as many positions are held as the longest
    piece has letters: value[d] belongs to the position d letters ahead."""
    n, reach = len(text), lattice.longest
    value, scale = np.zeros((reach + 1, p.shape[1])), np.zeros(p.shape[1])
    value[0] = 1
    for at in range(0, n, WINDOW):
        edges = lattice.edges(text[at : at + WINDOW + reach - 1])
        for i in range(min(WINDOW, n - at)):
            if i % STEP == 0:
                most = value.max(axis=0)
                value /= most
                scale += np.log(most)
            ids = edges[:, i]
            sizes = np.flatnonzero(ids >= 0)
            if ids[0] < 0:
                value[1] += value[0] * FLOOR
            value[sizes + 1] += value[0] * p[ids[sizes]]
            value[:-1] = value[1:]
            value[-1] = 0
    return np.log(value[0]) + scale


def _expected(p: np.ndarray, edges: list[np.ndarray], weight: np.ndarray, out: np.ndarray) -> None:
    """Add the expected piece counts of words with ``weight`` (words, languages)."""
    (alpha, a), (beta, b) = forward(p, edges), forward(p, edges, back=True)
    total = np.log(alpha[-1]) + a[-1]
    for size, ids in enumerate(edges, 1):
        for i in np.flatnonzero((ids >= 0).any(axis=0)):
            have = np.flatnonzero(ids[:, i] >= 0)
            piece, j = ids[have, i], i + size
            share = alpha[i][have] * p[piece] * beta[j][have] * np.exp(a[i][have] + b[j][have] - total[have])
            np.add.at(out, piece, share * weight[have])


def stretches(word: str) -> list[str]:
    """The letter runs of a word, lower case, marked at the start."""
    return [_MARK + run for run in _RUN.findall(word.lower())]


def fit(counts: dict[str, np.ndarray], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (pieces, languages) from stretch counts by language."""
    pairs = [(x[i : i + WINDOW], n) for x, n in counts.items() for i in range(0, len(x), WINDOW)]
    texts, weight = [x for x, _ in pairs], np.array([n for _, n in pairs], float)
    k = weight.shape[1]
    groups = list(Lattice(pieces, k).groups(texts))
    p = np.full((len(pieces), k), 1.0 / len(pieces))
    for _ in range(rounds):
        out = np.full((len(pieces), k), 0.05)
        for part, edges in groups:
            _expected(p, edges, weight[part], out)
        p = out / out.sum(axis=0)
    return p


class Scorer:
    """Log-probabilities of words: one column a language, then whether there are letters."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.lattice, self.p = Lattice(pieces, p.shape[1]), p

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [stretches(x) for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        flat = [y for x in found for y in x]
        out = np.zeros((len(texts), self.p.shape[1] + 1))
        short = np.array([len(x) <= WINDOW for x in flat], bool)
        owners = owner[short]
        for part, edges in self.lattice.groups([x for x, s in zip(flat, short.tolist(), strict=True) if s]):
            np.add.at(out[:, :-1], owners[part], log_probability(self.p, edges))
        for i in np.flatnonzero(~short).tolist():
            out[owner[i], :-1] += windowed_probability(self.p, self.lattice, flat[i])
        out[owner, -1] = 1
        return out


def _training_counts(docs: DataFrame, per_language: int) -> tuple[list[str], dict[str, np.ndarray]]:
    """Stretch counts by language of the sample."""
    narrow = docs.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).select("id", "lang")
    if narrow.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    ids = smallest_hashes(narrow, "lang", per_language, LANGUAGES)  # ranked without the texts
    sample = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("id"))).join(F.broadcast(ids), ["id", "lang"], "left_semi").select("lang", "text")

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in _WORD.findall(text or ""):
                    for x in stretches(word):
                        seen[lang, x] = seen.get((lang, x), 0) + 1
            if seen:
                yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())})

    rows = sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toPandas()
    langs = sorted(rows["lang"].unique())
    at, counts = {x: i for i, x in enumerate(langs)}, {}
    for lang, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
        counts.setdefault(word, np.zeros(len(langs)))[at[lang]] += n
    return langs, counts


def identify(docs: DataFrame, model_path: str, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of each document; languages are those of ``lang_col``."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs, counts = _training_counts(slim, per_language)
    pieces = vocabulary(model_path)
    model = spark.sparkContext.broadcast((pieces, fit(counts, pieces) if counts else np.ones((len(pieces), 1)), langs))

    def run(batches):
        pieces, p, langs = model.value
        score = WordCache(Scorer(pieces, p), p.shape[1] + 1)
        for batch in batches:
            names, best = [], []
            for _, _, part, offs in chunks(*text_buffer(batch.column(1))):
                starts, ends, wo = words(part, offs)
                total = segment_sums(score(part, starts, ends), wo)
                some, total = (total[:, -1] > 0.5) & bool(langs), total[:, :-1]
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                top = total.argmax(axis=1)
                names += [langs[i] if ok else "und" for i, ok in zip(top, some, strict=True)]
                best.append(np.where(some, (odds / odds.sum(axis=1, keepdims=True)).max(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(best) if best else [], pa.float64())], names=["id", "lang_pred", "score"])

    out = slim.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
