"""Language identification with interpolated Kneser-Ney character models.

Letters are lowered and every run of other characters counts as one space. Each language has a model of ORDER
characters: the highest order from raw counts, the lower ones from continuation counts, each interpolated with the next by an
absolute discount estimated from the counts of counts, the lowest with the uniform distribution over all characters seen.

A model is stored as sorted arrays of n-gram keys, one array for each order over the n-grams of all languages, with the
full interpolated log probability by language, and a sorted array of contexts with their log back-off weights. Scoring
looks up the longest n-gram; where no language has seen it, it adds the context's back-off weights and looks up the next
shorter one. A text gets the language of the lowest cross-entropy per character.

It is rejected (column `rejected`) if it has no letters, or if that cross-entropy, less ERRORS standard errors for the text's
length, is nearer to what other languages' texts have under this model than to what the language's own have: above the middle of
the two medians on the calibration texts. (Where languages are so close that this would cut off their own tail, above `slack` times
the distance of the 95th percentile of their own.) All of this comes from the calibration fifth of the training sample;
tests leave a language out and see its texts rejected. A language of fewer than FEW usable calibration texts has its own
cross-entropies by cross-validation, over all its texts or, if these are fewer, over FEW parts of them. So every
language has a limit (where even that is impossible, the median of the others'), and a text with foreign passages stays, a foreign one goes. The
score is a softmax of the cross-entropies whose temperature has the least log loss on the calibration documents.

Training takes whole texts of at most `docs_per_language` documents of each label (those of the smallest hash of doc_id; this is the
bound of the labelled sample). Spark counts their n-grams; the driver gets the counts, and the calibration texts' cross-entropies, but
no texts except those of languages that have too few. Every label has a model. Models of more than MODEL_BYTES in
all are not broadcast but refused with an error. Null or letterless texts give `und`, score 0 and are
rejected. Null languages teach nothing; null doc_ids are scored but teach nothing. Equal cross-entropies go to
the language first in order. Without training rows all is `und`. Rows that repeat are rows of their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.llm.common import fresh_path, remove, small_batches, written
from tallyloom.llm.decontaminate import sliced
from tallyloom.llm.words import text_column

ORDER = 4
PIECE = 1 << 19
ERRORS = 3
FEW = 8  # calibration texts
MODEL_BYTES = 1 << 30
SPACE = 32
UNKNOWN = "und"


def _alphabet() -> np.ndarray:
    """The letter that each 16-bit code point counts as; a space for what is no letter or mark."""
    out = np.full(1 << 16, SPACE, np.uint64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            out[c] = ord(low[0]) if ord(low[0]) < 1 << 16 else c
    return out


_letters: list[np.ndarray] = []
_marks: list[np.ndarray] = []


def is_letter(chars: np.ndarray) -> np.ndarray:
    """Which of the normalised characters are letters; marks alone make no text of a language."""
    if not _marks:
        _marks.append(np.array([unicodedata.category(chr(c))[0] == "M" or 0xE000 + 6000 <= c < 0xE000 + 6400 for c in range(1 << 16)]))
    return (chars != SPACE) & ~_marks[0][chars]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of all texts and the n + 1 offsets among them."""
    if not _letters:
        _letters.append(_alphabet())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    if len(points) != lead[-1]:  # broken UTF-8
        raise ValueError("texts must be UTF-8")
    far = points >= 1 << 16
    chars = _letters[0][np.where(far, SPACE, points)]
    for c in np.unique(points[far]):  # letters beyond 16 bits share the private area's keys
        if unicodedata.category(chr(c))[0] in "LM":
            chars[points == c] = 0xE000 + int(c) % 6000 if unicodedata.category(chr(c))[0] == "L" else 0xE000 + 6000 + int(c) % 400
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != SPACE) | (chars[:-1] != SPACE)
    first = at[:-1][np.diff(at) > 0]
    keep[first] = chars[first] != SPACE  # what stands before a text counts as spaces
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return chars[keep], total[at]


def gram_keys(chars: np.ndarray, offsets: np.ndarray, n: int = ORDER) -> np.ndarray:
    """For each character the key of the n characters that end there, 16 bits each, padded with spaces."""
    n_chars = np.diff(offsets)
    place = np.arange(len(chars)) - np.repeat(offsets[:-1], n_chars)
    key = chars.copy()
    for j in range(1, n):
        before = np.full(len(chars), np.uint64(SPACE))
        before[j:] = chars[:-j]
        before[place < j] = SPACE
        key |= before << np.uint64(16 * j)
    return key


def _low(keys: np.ndarray, k: int) -> np.ndarray:
    """The keys without their first characters, down to k characters."""
    return keys & np.uint64((1 << 16 * k) - 1)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    return np.unique(keys, return_counts=True)


class KneserNey:
    """One language's model, from its distinct n-grams of the highest order in order and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, n_symbols: int):
        self.n_symbols, self.grams, self.contexts = n_symbols, [None] * (ORDER + 1), [None] * (ORDER + 1)
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # how many different characters stand before it
                grams, counts = np.unique(_low(self.grams[k + 1][0], k), return_counts=True)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = float(once / (once + 2 * twice)) if once and twice else 0.5
            self.grams[k] = (grams, counts.astype(float), discount)
            context, at, kinds = np.unique(grams >> np.uint64(16), return_index=True, return_counts=True)
            self.contexts[k] = (context, np.add.reduceat(counts, at).astype(float), kinds.astype(float))

    def backoff(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The weight of order k - 1 after the contexts of these keys; 1 after those not seen."""
        context, total, kinds = self.contexts[k]
        at, has = _find(context, keys >> np.uint64(16))
        return np.where(has, self.grams[k][2] * kinds[at] / total[at], 1.0)

    def probability(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), 1.0 / self.n_symbols)
        grams, counts, discount = self.grams[k]
        at, has = _find(grams, keys)
        c_at, c_has = _find(self.contexts[k][0], keys >> np.uint64(16))
        own = np.where(has, np.maximum(counts[at] - discount, 0), 0) / np.where(c_has, self.contexts[k][1][c_at], 1)
        return own + self.backoff(keys, k) * self.probability(_low(keys, k - 1), k - 1)


class Model:
    """Sorted key arrays of all orders with log probabilities and back-off weights by language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: by language, as of counted()."""
        self.langs = sorted(g for g, (keys, _) in counts.items() if len(keys))
        symbols = len(np.unique(np.concatenate([_low(counts[g][0], 1) for g in self.langs]))) + 1 if self.langs else 1
        models = [KneserNey(*counts[g], symbols) for g in self.langs]
        if sum(len(g[0]) for m in models for g in m.grams[1:]) * (len(models) + 2) * 4 > MODEL_BYTES:
            raise ValueError(f"the models of {len(models)} languages are too large to broadcast; lower docs_per_language")
        self.symbols, self.floor = symbols, -np.log(symbols)
        self.grams, self.contexts = [None], [None]
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([m.grams[k][0] for m in models])) if models else np.zeros(0, np.uint64)
            self.grams.append((union, np.stack([np.log(m.probability(union, k)) for m in models], axis=1).astype(np.float32) if models else None))
            seen = np.unique(union >> np.uint64(16))
            self.contexts.append((seen, np.stack([np.log(m.backoff(seen << np.uint64(16), k)) for m in models], axis=1).astype(np.float32) if models else None))
        self.mean, self.spread, self.limit, self.heat = (np.zeros(len(self.langs)), np.ones(len(self.langs)), np.full(len(self.langs), np.inf), 1.0)

    @classmethod
    def of(cls, texts: dict[str, list[str]]) -> Model:
        return cls({g: counted(gram_keys(*letters(*text_column(pa.array(t, pa.string()))))) for g, t in texts.items()})

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            now = _low(keys[left], k) if k < ORDER else keys
            at, has = _find(self.grams[k][0], now)
            out[left[has]] += self.grams[k][1][at[has]]
            left, now = left[~has], now[~has]
            if not len(left):
                return out
            at, has = _find(self.contexts[k][0], now >> np.uint64(16))
            out[left[has]] += self.contexts[k][1][at[has]]
        out[left] += self.floor
        return out

    def entropies(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language; characters; whether the text has letters."""
        data, offsets = text_column(column)
        n = len(offsets) - 1
        total, chars, any_letter = np.zeros((n, len(self.langs))), np.zeros(n, np.int64), np.zeros(n, bool)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            text, at = letters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys = gram_keys(text, at)
            size = np.diff(at)
            chars[i:j] = size
            for a in range(0, len(keys), PIECE):  # a text longer than a piece is summed in parts
                b = min(a + PIECE, len(keys))
                sums = np.zeros((b - a + 1, len(self.langs)))
                np.cumsum(self.log_probabilities(keys[a:b]), axis=0, out=sums[1:])
                inner = np.clip(at, a, b) - a
                total[i:j] += sums[inner[1:]] - sums[inner[:-1]]
            seen = np.zeros(len(text) + 1, np.int64)
            np.cumsum(is_letter(text), out=seen[1:])
            any_letter[i:j] = seen[at[1:]] > seen[at[:-1]]
            i = j
        return -total / np.maximum(chars, 1)[:, None], chars, any_letter

    def crossed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies of one language's texts by models of its other texts, and the roots of their lengths."""
        chars, at = letters(*text_column(pa.array(texts, pa.string())))
        keys, used = gram_keys(chars, at), np.unique(at)
        if len(used) - 1 < FEW:
            used = np.unique(np.linspace(0, len(keys), FEW + 1).astype(int))
        size = np.diff(used)
        if len(size) < 2:  # too short for two parts
            return np.zeros(0), np.zeros(0)
        fold = np.repeat(np.arange(len(size)) % FEW, size)
        loss = np.zeros(len(keys))
        for f in np.unique(fold):
            loss[fold == f] = -np.log(KneserNey(*counted(keys[fold != f]), self.symbols).probability(keys[fold == f], ORDER))
        return np.add.reduceat(loss, used[:-1]) / size, np.sqrt(size)

    def calibrate(self, entropy: np.ndarray, chars: np.ndarray, truth: np.ndarray, slack: float, rare: dict[str, list[str]]) -> None:
        """From usable calibration texts: cross-entropies by language, lengths, and the place of the right language. rare: all texts of languages that have few of these."""
        own = entropy[np.arange(len(truth)), truth]
        for g, lang in enumerate(self.langs):
            e, n = own[truth == g], np.sqrt(chars[truth == g])
            if len(e) < FEW:
                e, n = self.crossed(rare.get(lang, []))
            if len(e):
                self.mean[g] = np.median(e)
                self.spread[g] = max(np.median(np.abs(e - self.mean[g]) * n) * 1.4826, 1.0)
                # beyond what a text's length explains, texts differ from each other
                own_limit = np.quantile(e - self.mean[g] - ERRORS * self.spread[g] / n, 0.95)  # a wrong label or two don't count
                foreign = np.median(entropy[truth != g, g]) if (truth != g).any() else -self.floor
                self.limit[g] = max(slack * own_limit, 0.5 * (foreign - self.mean[g]))
        open_ = np.isinf(self.limit)  # a text or two of a letter; they go by the others, or by the uniform distribution
        self.mean[open_], self.spread[open_], self.limit[open_] = (
            [np.median(x[~open_]) for x in (self.mean, self.spread, self.limit)] if not open_.all() else (0.0, 1.0, -0.5 * self.floor)
        )
        if len(truth):
            losses = {}
            for heat in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
                self.heat = heat
                p = self.weights(entropy, chars)[np.arange(len(truth)), truth]
                losses[heat] = -np.log(np.maximum(p, 1e-9)).mean()
            self.heat = min(losses, key=losses.get)

    def weights(self, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
        x = -entropy * np.sqrt(chars)[:, None] / self.heat
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, column: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
        n = len(column)
        if not self.langs:
            return pa.RecordBatch.from_arrays([pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool)), pa.array(np.zeros(n))], ["lang_pred", "score", "rejected", "cross_entropy"])
        entropy, chars, usable = self.entropies(column)
        best = entropy.argmin(axis=1)
        each = np.arange(n)
        own = entropy[each, best]
        above = own - self.mean[best] - ERRORS * self.spread[best] / np.sqrt(np.maximum(chars, 1))
        rejected = ~usable | (above > self.limit[best])
        score = np.where(usable, self.weights(entropy, chars)[each, best], 0.0)
        names = np.array([*self.langs, UNKNOWN], object)[np.where(usable, best, len(self.langs))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(np.where(usable, own, 0.0))], ["lang_pred", "score", "rejected", "cross_entropy"])


def train(docs: DataFrame, docs_per_language: int = 400, slack: float = 1.5) -> Model:
    """A model from docs (doc_id, text, lang): 4 of 5 sampled documents teach, the fifth calibrates."""
    spark = docs.sparkSession
    small_batches(spark)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sample = known.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= docs_per_language)
    nth = sample.groupBy("doc_id").agg(F.min("nth").alias("nth"))  # docs_per_language rows a language
    rows = written(spark, known.join(F.broadcast(nth), "doc_id").select("lang", "nth", "text"), "labelled", path := fresh_path(spark, "labelled"))
    try:
        return _fitted(spark, rows, slack)
    finally:
        remove(spark, path)


def _fitted(spark: SparkSession, rows: DataFrame, slack: float) -> Model:
    """The model of the rows (lang, nth, text)."""
    check = rows.filter("nth % 5 = 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                for g in np.unique(langs):
                    keys, n = counted(gram_keys(*letters(*text_column(part.column("text").filter(pa.array(langs == g))))))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    found = rows.filter("nth % 5 <> 0").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs, counts = np.array(found["lang"].to_pylist(), object), {}
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    for g in np.unique(langs) if len(langs) else ():
        own = np.flatnonzero(langs == g)
        own = own[np.argsort(keys[own])]
        counts[g] = keys[own], n[own]
    model = Model(counts)
    if not model.langs:
        return model

    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entropy, chars, usable = shared.value.entropies(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(chars), pa.array(usable)], ["lang", "entropy", "chars", "usable"])

    measured = check.mapInArrow(measure, "lang string, entropy array<double>, chars long, usable boolean").collect()
    place = {g: i for i, g in enumerate(model.langs)}
    measured = sorted((place[r["lang"]], r["chars"], r["entropy"]) for r in measured if r["usable"] and r["lang"] in place)
    truth = np.array([r[0] for r in measured], int)
    few = [g for g, i in place.items() if (truth == i).sum() < FEW]
    rare: dict[str, list[str]] = {}
    for r in sorted(rows.filter(F.col("lang").isin(few)).collect(), key=lambda r: (r["nth"] % 5 == 0, r["nth"], r["text"])) if few else ():
        rare.setdefault(r["lang"], []).append(r["text"])
    model.calibrate(np.array([r[2] for r in measured], float).reshape(-1, len(place)), np.array([r[1] for r in measured], np.int64), truth, slack, rare)
    return model


PREDICTION = "lang_pred string, score double, rejected boolean, cross_entropy double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _lang_pred, _score, _rejected and _cross_entropy behind its columns (with more _ before them if docs has such columns)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType(list(docs.schema.fields))
    for field in PREDICTION.split(", "):
        name, kind = field.split()
        out = out.add(next(n for i in range(1, 99) if (n := "_" * i + name) not in docs.columns), kind)
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, *found.columns], out.names)

    return docs.mapInArrow(predict, out)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't rejected, by a model taught by docs itself. Its columns may have any names."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs.filter(~held_out())))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.invert(shared.value.predict(b.column(at)).column("rejected")))

    return docs.mapInArrow(keep, docs.schema)
