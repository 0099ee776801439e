"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Stretches that look disguised (leetspeak, letters spaced out, letters repeated)
are lattices: every character may stand for itself, for the letters it imitates,
or for nothing, and a gap for nothing or for a word break. A Viterbi search finds
the likeliest plain reading under a character trigram model, and the readings
take the stretches' places. The restored text is then scored by a logistic model
over a lexicon of words and beginnings of words (languages that compound have no
fixed word list), both learnt from labelled rows, and over how much of the text
they are and how much of it was disguised.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ASCII_LOWER, ASCII_UPPER, filled, fold, only
from marginalia.session import cut, ship

THRESHOLD = 0.7
#: Most labelled documents that the classifier is fitted on, taken by hash of the id.
MAX_LABELLED = 12_000
#: An entry of the lexicon is a word, or a beginning of so many letters (marked by a hyphen).
HEADS = (5, 6, 7)
MIN_TOXIC_DOCS = 3
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
GAPS = " ._*-"
_SYMBOLS = "".join(map(re.escape, (c for c in LEET if not c.isdigit())))
_IMITATION = re.compile(rf"[0-9{_SYMBOLS}]++")
_RUN = re.compile(rf"(?:[^\W_]++|[{_SYMBOLS}]++)*+")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]*+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Four or more single characters set apart.
_SPACED = re.compile(rf"(?<![^\W_])(?!_)[\w{_SYMBOLS}](?![^\W_])(?:[ ._*\-]{{1,2}}(?!_)[\w{_SYMBOLS}](?![^\W_])){{3,}}+")
_IMITATIONS = "".join(LEET)
_GAP = frozenset(GAPS)
STATES = 27


@lru_cache(maxsize=4096)
def code(c: str) -> int:
    """1 to 26 for a letter, whatever accents it has; 0 for what isn't one of a to z."""
    base = unicodedata.normalize("NFD", c)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 0


def disguised(low: str) -> list[tuple[int, int]]:
    """Stretches of a lower-case text that may hide words, in order and apart, of any length; linear in the text.

    A whole run of letters (of any alphabet) and of digits or symbols that
    imitate them, with one of each; single characters set apart; a word with a
    letter three times.
    """
    found = [m.span() for m in _SPACED.finditer(low)]
    for first, whole, marks in ((_IMITATION, _RUN, LEET), (_TRIPLE, _LETTERS, ())):
        end = 0
        for m in first.finditer(low):
            a = m.start()
            if a < end:
                continue  # in the run before
            while a > end and (low[a - 1].isalpha() or low[a - 1] in marks):
                a -= 1
            end = whole.match(low, m.start()).end()  # type: ignore[union-attr]
            if _LETTER.search(low, a, end):
                found.append((a, end))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for a, b in found:
        if a >= end:
            out.append((a, b))
            end = b
    return out


@dataclass
class Channel:
    """The character model (log probability of a letter after two, 0 is the edge of a word) and what a change costs."""

    logp: np.ndarray
    swap: float = -0.7
    drop: float = -0.4
    lose: float = -2.5
    split: float = -1.0

    def __post_init__(self) -> None:
        self.table = self.logp.tolist()

    def options(self, c: str, last: str) -> tuple[list[tuple[str, float]], float | None, bool]:
        """Letters that a character may stand for with their costs; what it costs to leave it out, if it may be; whether it may be a word break."""
        if c in GAPS:
            return [], 0.0, True
        readings = [(c, 0.0)] if code(c) else []
        readings += [(r, self.swap) for r in LEET.get(c, "")]
        return readings, self.drop if c == last else self.lose if not readings or c in LEET else None, False

    def restore(self, span: str) -> str:
        """The likeliest plain reading of a lower-case span: exact, over the last two letters as states."""
        table = self.table
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # a reading is (what stands before, letter), so that long runs stay linear
        last = ""
        for c in span:
            readings, skip, gap = self.options(c, last)
            codes = [(code(r), r, cost) for r, cost in readings]
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, text) in best.items():
                own = table[a][b]
                for i, r, cost in codes:
                    to = score + cost + own[i]
                    if (held := following.get((b, i))) is None or held[0] < to:
                        following[b, i] = (to, (text, r))
                if skip is not None:
                    to = score + skip
                    if (held := following.get((a, b))) is None or held[0] < to:
                        following[a, b] = (to, text)
                if gap and b:
                    to = score + own[0] + self.split
                    if (held := following.get((0, 0))) is None or held[0] < to:
                        following[0, 0] = (to, (text, " "))
            best = following
            if not gap:
                last = c
        text, out = max(((score + table[a][b][0], text) for (a, b), (score, text) in best.items()), key=lambda x: x[0])[1], []
        while text:
            text, r = text
            out.append(r)
        return "".join(reversed(out)).strip()


def letter_counts(documents: DataFrame) -> DataFrame:
    """code, n: trigrams of letters (0 for what isn't one) over all texts, as (a * 27 + b) * 27 + c."""
    ship(documents.sparkSession)
    code = np.zeros(256, np.int32)
    code[97:123] = code[65:91] = np.arange(1, 27)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES**3, np.int64)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[texts.offset] : offsets[texts.offset + len(texts)]]
            for at in range(0, len(data), 1 << 22):
                s = code[data[max(0, at - 2) : at + (1 << 22)]]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * STATES + s[1:-1]) * STATES + s[2:], minlength=STATES**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["code", "n"])

    return only(documents, "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(corpus: np.ndarray, lexicon: list[str]) -> np.ndarray:
    """Trigram log probabilities, half from the corpus and half from the lexicon (words and beginnings), each smoothed by bigrams and letters."""
    own = np.zeros((STATES,) * 3)
    for w in lexicon:
        s = [0, 0, *map(code, w.removesuffix("-")), *([] if w.endswith("-") else [0])]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            own[a, b, c] += 1

    def smooth(n: np.ndarray) -> np.ndarray:
        one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * STATES)
        two = (n.sum(0) + 2 * one) / (n.sum(0).sum(-1, keepdims=True) + 2)
        return (n + 2 * two[None]) / (n.sum(-1, keepdims=True) + 2)

    corpus = corpus.reshape((STATES,) * 3).astype(float)
    corpus[0, 0] += corpus[:, 0].sum(0)  # the first letter of a word, whatever stood before
    return np.log(0.5 * smooth(corpus) + 0.5 * smooth(own))


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray
    channel: Channel

    def restored(self, low: str, trie: ahocorasick.Automaton | None, cache: dict[str, tuple[str, bool]]) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
        """The text with readings in place of disguised stretches; those that hold an entry, with their readings, and where these stand in it.

        A stretch whose reading holds no entry stays as it is.
        """
        parts, spans, places, at, size = [], [], [], 0, 0
        for a, b in disguised(low):
            span = low[a:b]
            if (known := cache.get(span)) is None:
                if len(cache) > 100_000:
                    cache.clear()
                core = span.strip(_IMITATIONS)
                if core.isalpha() and self.entries(core, trie):  # a plain word beside punctuation
                    known = (span, False)
                else:
                    read = self.channel.restore(span)
                    if not self.entries(read, trie) and not _GAP.isdisjoint(span):
                        read = self.parted(read, trie)
                    known = (read, True) if self.entries(read, trie) else (span, False)
                if len(span) <= 1000:  # the cache stays small
                    cache[span] = known
            read, hit = known
            if hit:
                left = " " if a and low[a - 1].isalpha() else ""  # a reading is words of its own
                right = " " if b < len(low) and low[b].isalpha() else ""
                parts += [low[at:a], left, read, right]
                size += a - at + len(left)
                places.append((size, size + len(read)))
                size += len(read) + len(right)
                spans.append((a, b, read))
                at = b
        return "".join([*parts, low[at:]]), spans, places

    def parted(self, read: str, trie: ahocorasick.Automaton | None) -> str:
        """A reading of spaced letters, where any letter may begin a word, with breaks around its longest whole entry."""
        found = [(-length, end + 1 - length, end + 1) for end, spelt in (trie.iter(read) if trie else ()) for _, length, whole in spelt if whole]
        if not found:
            return read
        _, a, b = min(found)
        return f"{read[:a]} {read[a:b]} {read[b:]}".strip()

    def entries(self, low: str, trie: ahocorasick.Automaton | None) -> list[tuple[int, int]]:
        """(entry, place of its last letter) wherever a word begins with one, or is one."""
        out, n = [], len(low)
        for end, spelt in trie.iter(low) if trie else ():
            start = end - spelt[0][1] + 1
            if start == 0 or not low[start - 1].isalpha():
                goes_on = end + 1 < n and low[end + 1].isalpha()
                out += [(k, end) for k, _, whole in spelt if whole != goes_on]
        return out

    def hits(self, text: str | None, trie: ahocorasick.Automaton | None, cache: dict[str, tuple[str, bool]]) -> tuple[dict[int, int], int, list[tuple[int, int, str]]]:
        """Lexicon entries of the restored text (number: times; -1: those in disguised stretches), words in the text, disguised stretches with their readings."""
        low = (text or "").translate(_LOWER)
        plain, spans, places = self.restored(low, trie, cache)
        found: dict[int, int] = {}
        hidden, k = 0, 0
        for entry, end in self.entries(plain, trie):
            found[entry] = found.get(entry, 0) + 1
            while k < len(places) and places[k][1] <= end:
                k += 1
            hidden += k < len(places) and places[k][0] <= end
        if hidden:
            found[-1] = hidden
        return found, len(low.split()), spans

    def vector(self, found: dict[int, int], words: int) -> np.ndarray:
        x = np.zeros(len(self.lexicon) + EXTRA)
        total = 0
        for k, n in found.items():
            if k >= 0:
                x[k] = math.log1p(n)
                total += n
        x[-5:] = math.log1p(found.get(-1, 0)), len(found.keys() - {-1}), math.log1p(total), math.log1p(100 * total / (words + 1)), 1
        return x

    def score(self, found: dict[int, int], words: int) -> float:
        return float(1 / (1 + np.exp(-self.vector(found, words) @ self.weights)))


#: Columns of the classifier beside the lexicon's: disguised entries, distinct ones, all, their share of the words, and the constant.
EXTRA = 5
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def trie_of(lexicon: list[str]) -> ahocorasick.Automaton | None:
    if not lexicon:
        return None
    made = ahocorasick.Automaton()
    for k, w in enumerate(lexicon):
        head = w.removesuffix("-")
        made.add_word(head, (*made.get(head, ()), (k, len(head), head == w)))  # a word and a beginning may be spelt alike
    made.make_automaton()
    return made


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last column is the constant."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, *, modulus: int = 3, held: int = 1, max_labelled: int = MAX_LABELLED) -> Model:
    """Character model from all texts; lexicon and weights from at most ``max_labelled`` labelled rows outside the held-out fold.

    Labels of one id that differ count as toxic if any is; null labels and ids
    are left out. Without labels of both kinds nothing is known to be toxic and
    every text scores the share of toxic labels. The lexicon is every entry of
    the sample that is in toxic texts far more often than in others; the sample
    bounds it, nothing else.
    """
    marked = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    docs = cut(only(documents, "doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most max_labelled ids, and few rows an id
    words = F.expr(f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '(?<![\\\\p{{L}}])[\\\\p{{L}}]{{3,32}}+(?![\\\\p{{L}}])', 0)")
    each = docs.select("toxic", "doc_id", F.explode(words).alias("w")).groupBy("toxic", "doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    heads = ", ".join(f"if(length(w) > {n}, concat(left(w, {n}), '-'), null)" for n in HEADS)
    each = each.select("toxic", "doc_id", "c", F.explode(F.expr(f"array_compact(array(w, {heads}))")).alias("entry"))
    counted = each.groupBy("toxic", "doc_id", "entry").agg(F.log1p(F.sum("c")).alias("x"))
    n = {bool(r.toxic): r.n for r in docs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    lexicon: list[str] = []
    if toxic and clean:
        side = lambda mark, x: F.sum(F.when(F.col("toxic") == mark, x).otherwise(0.0))
        by = counted.groupBy("entry").agg(
            F.count_if(F.col("toxic") == 1).alias("docs"), side(1, F.col("x")).alias("t1"), side(1, F.col("x") ** 2).alias("t2"), side(0, F.col("x")).alias("c1"), side(0, F.col("x") ** 2).alias("c2"))
        t, c = F.col("t1") / toxic, F.col("c1") / clean
        spread = F.sqrt((F.col("t2") / toxic - t * t) / toxic + (F.col("c2") / clean - c * c) / clean + 1e-12)
        lexicon = sorted(r.entry for r in by.where((F.col("docs") >= MIN_TOXIC_DOCS) & (t > 0.01) & (t > 5 * c) & ((t - c) / spread > 3.5))
                         .select("entry").collect())  # of the sample's words those that pass
    corpus = np.zeros(STATES**3)
    for r in letter_counts(documents).collect():  # at most 27 ** 3 rows
        corpus[r.code] = r.n
    made = Model(lexicon, np.zeros(len(lexicon) + EXTRA), Channel(character_model(corpus, lexicon)))
    base = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -10.0
    made.weights[-1] = base
    if lexicon:
        rows = _read(docs.select("doc_id", "text", "toxic"), made, "toxic").select("toxic", "found", "times", "n_words").collect()  # short rows
        x = np.array([made.vector(dict(zip(r.found, r.times, strict=True)), r.n_words) for r in rows])
        made.weights = logistic(x, np.array([r.toxic for r in rows], float))
    return made


def _read(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """doc_id, (a kept column,) found, times, n_words, spans, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # lexicon and character model: both of bounded size
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        trie, cache = trie_of(own.lexicon), {}
        for batch in batches:
            read = [own.hits(t.as_py(), trie, cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *([batch.column(2)] if keep else []), pa.array([list(f) for f, _, _ in read], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f, _, _ in read], pa.list_(pa.int32())), pa.array([n for _, n, _ in read], pa.int64()),
                 pa.array([[{"start": a, "end": b, "text": x} for a, b, x in s] for _, _, s in read], pa.list_(span)), pa.array([own.score(f, n) for f, n, _ in read], pa.float64())],
                names=["doc_id", *([keep] if keep else []), "found", "times", "n_words", "spans", "score"])

    types = dict(docs.dtypes)
    extra = f"{keep} {types[keep]}, " if keep else ""
    return docs.mapInArrow(run, f"doc_id {types['doc_id']}, {extra}found array<int>, times array<int>, n_words long, spans array<struct<start:long,end:long,text:string>>, score double")


def toxicity(documents: DataFrame, labels: DataFrame, *, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (disguised words: start, end in code points, reading) of every row.

    Only the text makes the score. Null text is empty and scored like any other;
    repeated rows stay repeated; an empty table gives no rows; other columns are
    left out. Texts are read whole in linear time, stretches of any length.
    """
    model = fit(documents, labels, modulus=modulus, held=held)
    return _read(only(documents, "doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
