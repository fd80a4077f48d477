"""SentencePiece encoding and decoding by streaming Viterbi.

Encoding finds the sequence of pieces with the highest sum of scores. It walks through the text once and keeps, from the last
committed boundary on, the best score and backpointer of each position. Every so often it follows the
backpointers of all positions that a piece may still start from or have reached; where these paths meet in one
boundary, everything before is committed and its ids leave. The window beyond the walk's position is the longest piece.

Texts are not normalised: spaces count as U+2581, one more stands before the text, and a character without a piece becomes the
byte pieces of its UTF-8 bytes (or the unknown piece where the vocabulary has none), at a score 10 below the lowest of all
pieces. A literal U+2581 is always written in bytes. So decoding gives the very same text back. Of equal sums the longer
last piece wins.

No piece holds a space after another character, and some characters (like line feeds) are in no longer piece. Before such a place no path reaches beyond it, so it is the one boundary that all
paths meet in, and what lies before is committed there: in running text at every word. So the window from one such place to the next is streamed by itself, and the ids of short windows
(up to MEMO_CHARS characters) are kept in a table of bounded size for when they recur; in longer ones, such as texts without spaces, ids leave every CHECK positions or so. A vocabulary with other pieces is
streamed without these places.

The windows of a batch that the table doesn't have are walked side by side: the same walk, with one position of all windows at a time. Each ends in its own last boundary and is committed there.

The ids are those of a unigram model with the vocabulary's pieces and scores; tests hold them against one on whole texts. A vocabulary made
for BPE merges, such as the installed one, has ranks as scores, and merging applies the best merge first instead of finding
the best sum: on the texts of sf0.001 the best sums have 218,524 ids and the merges 191,304. Both decode to the same text.

A null text has null ids, an empty text none. Rows that repeat are rows of their own.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches
from tallyloom.llm.decontaminate import sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
SIDE_BY_SIDE = 64  # windows from which on they are walked side by side
CHECK = 16  # positions after which paths are followed back
MODEL_BYTES = 64 << 20


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float]], bytes_at: dict[int, int], unknown: int = 0, skip: frozenset[int] = frozenset()):
        """pieces: text and score by id. bytes_at: the id of each byte piece. skip: ids that stand for no text."""
        self.plain = [p.replace(BLANK, " ").encode() for p, _ in pieces]
        self.bytes_at, self.unknown = bytes_at, unknown
        for b, i in bytes_at.items():
            self.plain[i] = bytes([b])
        usable = {p: (i, s) for i, (p, s) in reversed(list(enumerate(pieces))) if i not in skip and i not in bytes_at.values() and i != unknown and p}
        self.table: dict[str, tuple[int, float]] = usable
        #: by character (id, score, what follows); id -1 where no piece ends
        self.tree: dict[str, tuple] = {}
        for p in sorted(usable, key=len, reverse=True):
            follows = self.tree
            for c in p[:-1]:
                follows = follows.setdefault(c, (-1, 0.0, {}))[2]
            follows[p[-1]] = (*usable[p], follows[p[-1]][2] if p[-1] in follows else {})
        self.longest = max(map(len, usable), default=1)
        self.fallback = min((s for _, s in usable.values()), default=0.0) - 10
        #: no path crosses a place between another character and a blank
        self.cut_at_blanks = not any(BLANK in p.lstrip(BLANK) for p in usable)
        joined = {c for p in usable if len(p) > 1 for c in p}
        self.alone = frozenset(c for c in "\n\t\r" if c not in joined)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        if sum(len(p) for p, _ in pieces) > MODEL_BYTES:
            raise ValueError("the vocabulary is too large to broadcast")
        bytes_at = {int(p[3:5], 16): i for i, (p, _) in enumerate(pieces) if model.is_byte(i)}
        skip = frozenset(i for i in range(len(pieces)) if model.is_control(i) or model.is_unused(i))
        return cls(pieces, bytes_at, model.unk_id(), skip)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The tree for walks side by side: place by character (0: in no piece), sorted keys (node x places + place), and the node, id (-1: none) and score that each key leads to; the root is node 0."""
        place = np.zeros(0x110000, np.int64)
        letters = sorted({c for p in self.table for c in p})
        place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        rows, todo, nodes = [], [(0, self.tree)], 1
        while todo:
            at, follows = todo.pop()
            for c, (number, score, more) in follows.items():
                rows.append((at * (len(letters) + 1) + place[ord(c)], nodes if more else -1, number, score))
                if more:
                    todo.append((nodes, more))
                    nodes += 1
        rows.sort()
        keys, node, number, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        return place, np.array(keys, np.int64), np.array(node, np.int64), np.array(number, np.int64), np.array(score, float), len(letters) + 1

    def spelled(self, c: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.bytes_at.get(b, self.unknown) for b in c.encode()] if self.bytes_at else [self.unknown]


def stream(vocabulary: Vocabulary, text: str, check: int = CHECK) -> Iterator[list[int]]:
    """The ids of text (blanks as U+2581) in portions, as soon as they are certain.

    `check` positions are walked at a time. Then the paths of all positions that have been reached beyond are followed back until
    they meet. What lies before leaves, so what is kept is the window from there to the longest piece ahead.
    """
    tree, longest, fallback, n, low = vocabulary.tree, vocabulary.longest, vocabulary.fallback, len(text), float("-inf")
    first = at = 0  # the position that best[0] is of; the position to walk on from
    best, back, piece = [0.0], [0], [-1]
    while at < n:
        stop = min(n, at + check)
        ahead = min(n, stop - 1 + longest) - first + 1 - len(best)
        best += [low] * ahead
        back += [0] * ahead
        piece += [-1] * ahead
        for i in range(at, stop):
            k, follows = i - first, tree
            here = best[k]
            for c in text[i : i + longest]:
                if c not in follows:
                    break
                number, score, follows = follows[c]
                k += 1
                if number >= 0:
                    score += here
                    if score > best[k]:
                        best[k], back[k], piece[k] = score, i, number
            k = i + 1 - first
            if here + fallback > best[k]:  # never where the character has a piece, as all scores are higher
                best[k], back[k], piece[k] = here + fallback, i, -1
        at = stop
        if at == n:
            yield _path(vocabulary, text, back, piece, first, n)
            return
        ends = {p for p in range(at, first + len(best)) if best[p - first] > low}
        while len(ends) > 1:  # the last of several positions can't be common to all
            p = max(ends)
            ends.remove(p)
            ends.add(back[p - first])
        meet = ends.pop()
        if meet > first:
            yield _path(vocabulary, text, back, piece, first, meet)
            best, back, piece = best[meet - first :], back[meet - first :], piece[meet - first :]
            first = meet


def _path(vocabulary: Vocabulary, text: str, back: list[int], piece: list[int], first: int, p: int) -> list[int]:
    out = []
    while p > first:
        q, i = back[p - first], piece[p - first]
        if i >= 0:
            out.append(i)
        else:
            out.extend(reversed(vocabulary.spelled(text[q])))
        p = q
    out.reverse()
    return out


def side_by_side(vocabulary: Vocabulary, arrays: tuple, windows: list[str]) -> list[tuple[int, ...] | None]:
    """The ids of windows as stream() has them; None where a character has no piece."""
    place, keys, nodes, numbers, scores, places = arrays
    windows_by_length = sorted(range(len(windows)), key=lambda w: (-len(windows[w]), windows[w]))  # like ones are neighbours, and find their keys near each other
    size = np.array([len(windows[w]) for w in windows_by_length])
    text = place[np.frombuffer("".join(windows[w] for w in windows_by_length).encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = np.cumsum(size) - size  # of each window's first character
    first = letter + np.arange(len(size))  # of its position 0; it has one position more than characters
    best = np.full(len(text) + len(size), -np.inf)
    back, piece = np.zeros(len(best), np.int64), np.full(len(best), -1)
    best[first] = 0.0
    roots = np.full(places, -1)
    roots[keys[keys < places]] = np.arange(np.count_nonzero(keys < places))
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i))  # the windows that are longer
        at, k = np.arange(n), i
        here = best[first[:n] + i]
        found = roots[text[letter[:n] + i]]
        known = found >= 0
        while known.any():
            at, found, k = at[known], found[known], k + 1
            ends = numbers[found] >= 0
            own, arc = at[ends], found[ends]
            to, total = first[own] + k, here[own] + scores[arc]
            better = total > best[to]
            to = to[better]
            best[to], back[to], piece[to] = total[better], first[own[better]] + i, numbers[arc[better]]
            node = nodes[found]
            on = (node >= 0) & (size[at] > k)
            at = at[on]
            wanted = node[on] * places + text[letter[at] + k]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[found] == wanted
        to = first[:n] + i + 1
        worse = here + vocabulary.fallback > best[to]
        to = to[worse]
        best[to], back[to], piece[to] = here[worse] + vocabulary.fallback, first[:n][worse] + i, -1
    passed, p, start = np.zeros(len(best), bool), first + size, first
    while len(p):
        on = p > start
        p, start = p[on], start[on]
        passed[p] = True
        p = back[p]
    flat = piece[passed]
    window = np.repeat(np.arange(len(size)), size + 1)[passed]
    bare = np.zeros(len(size), bool)
    bare[window[flat < 0]] = True
    ends = np.cumsum(np.bincount(window, minlength=len(size))).tolist()
    ids, out, begin = flat.tolist(), [None] * len(windows), 0
    for w, end, none in zip(windows_by_length, ends, bare.tolist(), strict=True):
        if not none:
            out[w] = tuple(ids[begin:end])
        begin = end
    return out


class Memo(dict):
    """The ids of a short window with blank before it, made on first use. When it is full, what wasn't used since the last time goes."""

    def __init__(self, vocabulary: Vocabulary, lead: str):
        self.vocabulary, self.lead, self.old = vocabulary, lead, {}

    def __missing__(self, window: str) -> tuple[int, ...]:
        ids = self.old.get(window) or tuple(chain(*stream(self.vocabulary, self.lead + window)))
        self.keep(window, ids)
        return ids

    def keep(self, window: str, ids: tuple[int, ...]) -> None:
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[window] = ids

    def learn(self, windows: Iterable[str], arrays: tuple) -> None:
        """Keep the ids of the windows that aren't known, if they are many."""
        new = [w for w in windows if w and len(w) <= MEMO_CHARS and w not in self and w not in self.old]
        if len(new) >= SIDE_BY_SIDE:
            for w, ids in zip(new, side_by_side(self.vocabulary, arrays, [self.lead + w for w in new]), strict=True):
                if ids is not None:
                    self.keep(w, ids)

    def portions(self, window: str) -> Iterable[Sequence[int]]:
        """The ids of a window as they are committed; of a long one, which isn't kept, so that the memory is bounded, while it is streamed."""
        return [self[window]] if len(window) <= MEMO_CHARS else stream(self.vocabulary, self.lead + window)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.bare, self.led = Memo(vocabulary, ""), Memo(vocabulary, BLANK)
        self.blank_ids = vocabulary.spelled(BLANK)
        self.arrays = None

    def learn(self, texts: Iterable[str | None]) -> None:
        """Fill the tables with the windows of texts that will be encoded."""
        if not (self.vocabulary.cut_at_blanks and "\n" in self.vocabulary.alone):
            return
        if self.arrays is None:
            self.arrays = self.vocabulary.arrays()
        words = set()
        for text in texts:
            if text and BLANK not in text:
                words.update(text.replace("\n", " \n").split(" "))
        self.led.learn((w for w in words if w[:1] != "\n"), self.arrays)
        self.bare.learn((w[1:] for w in words if w[:1] == "\n"), self.arrays)

    def encode(self, text: str) -> array:
        """The ids of a text."""
        ids = array("i")
        for windows in self._windows(text):
            ids.extend(chain.from_iterable(windows))
        return ids

    def commits(self, text: str) -> Iterator[Sequence[int]]:
        """The ids of a text in the portions in which they are committed, from left to right."""
        return chain.from_iterable(self._windows(text))

    def _windows(self, text: str) -> Iterator[Iterable[Sequence[int]]]:
        """Runs of committed portions: the windows between the places where all paths are sure to meet, streamed or known from before."""
        if not text:
            return
        for k, part in enumerate(text.split(BLANK)):
            if k:
                yield [self.blank_ids]
            if not k or part:
                yield from self._part(part, not k)

    def _part(self, text: str, led: bool) -> Iterator[Iterable[Sequence[int]]]:
        v = self.vocabulary
        if not v.cut_at_blanks:
            yield stream(v, (BLANK if led else "") + text.replace(" ", BLANK))
            return
        lines = text.split("\n") if "\n" in v.alone else [text]
        for k, line in enumerate(lines):
            if k:
                yield [self.bare["\n"]]
            led = led and not k
            if "  " in line or line[:1] == " " and led or line[-1:] == " ":
                yield from self._spaced(line, led)
                continue
            words = line.split(" ")
            if not led:
                if words[0]:
                    yield self.bare.portions(words[0])
                del words[0]
            yield chain.from_iterable(map(self.led.portions, words)) if len(max(words, key=len, default="")) > MEMO_CHARS else map(self.led.__getitem__, words)

    def _spaced(self, line: str, led: bool) -> Iterator[Iterable[Sequence[int]]]:
        """A line with runs of spaces: each run belongs to what follows it."""
        line, at = (" " if led else "") + line, 0
        while at < len(line):
            word = at
            while word < len(line) and line[word] == " ":
                word += 1
            end = line.find(" ", word)
            end = len(line) if end < 0 else end
            if word == at:
                yield self.bare.portions(line[at:end])
            elif word == at + 1:
                yield self.led.portions(line[word:end])
            else:
                yield stream(self.vocabulary, BLANK * (word - at) + line[word:end])
            at = end

    def decode(self, ids) -> str:
        """The text of ids that encode() gave."""
        return b"".join(map(self.vocabulary.plain.__getitem__, ids)).decode()[1:] if len(ids) else ""


def encoded(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_ids and, as asked for, ids and the digests of the ids (32 bits each, little-endian) and of the decoded text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_ids int" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string, same boolean" * digests

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            for part in sliced(b, "text", 1 << 21):
                texts = part.column("text").to_pylist()
                codec.learn(texts)
                ids = [None if t is None else codec.encode(t) for t in texts]
                size = np.array([0 if x is None else len(x) for x in ids])
                null = np.array([x is None for x in ids], bool)
                columns = {"doc_id": part.column("doc_id"), "n_ids": pa.array(size, pa.int32(), mask=null)}
                if with_ids:
                    flat = np.frombuffer(b"".join(x.tobytes() for x in ids if x is not None), np.int32)
                    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32(), mask=np.append(null, False))
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(flat))
                if digests:
                    back = [None if x is None else codec.decode(x) for x in ids]
                    columns["ids_sha256"] = pa.array([None if x is None else hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                    columns["decoded_sha256"] = pa.array([None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
                    columns["same"] = pa.array([None if x is None else x == t for x, t in zip(back, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.common import table

    return encoded(table(spark, sf_dir, "documents"), Vocabulary.load(), digests=True)
