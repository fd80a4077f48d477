"""The prefix trie, hard negatives and toxicity against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import duck

from tallyloom.llm import conversations, decontaminate, langid, negatives, pieces, quality, toxicity


def crc9(c):
    return zlib.crc32(str(c).encode()) % 9


def remainder(c, n):
    return int(np.fmod(c, n))


def brute_trie(rows):
    """The contract's rows, by the definition. rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {c: tuple(own.get(c - remainder(c, 5), [])[: crc9(c)] + own[c][crc9(c) :]) for c in own}
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def rolled(node):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below = [rolled(x) for x in children.get(node, [])]
        return (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *rolled(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run_trie(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, d int").drop("_")
    monkeypatch.setattr(conversations, "table", lambda *a: df)
    return sorted((tuple(r[c] for c in TRIE) for r in conversations.op12_prefix_trie(spark, "").collect()), key=str)


def conversation_rows():
    rng = random.Random(5)
    say = lambda: rng.choice(["", "a", "b", "é", None, "x" * 3000])
    rows = []
    for c in [*range(-12, 60), 1 << 62]:
        if rng.random() < 0.15:
            continue
        same = rng.random() < 0.4
        for t in range(rng.choice([1, 2, 3, 3, 12])):
            rows.append((c, None if rng.random() < 0.1 else t, "user" if same else rng.choice(["user", None]), "hello" if same else say(), "clash", t))
    rows += [(7, 1, "user", "tie b", "", 0), (7, 1, "user", "tie a", "", 0), (7, 1, "user", "tie a", "", 0), (None, 1, "user", "no conversation", "", 0)]
    rows += [(71, t, "r", f"long {t}", "", 0) for t in range(700)]
    return rows


@pytest.mark.parametrize("fan, run, size", [(32, 1 << 15, 1 << 17), (2, 2, 3), (2, 5, 1)])
def test_trie(spark, monkeypatch, fan, run, size):
    for name, value in (("FAN", fan), ("RUN", run), ("TABLE", size)):
        monkeypatch.setattr(conversations, name, value)
    rows = conversation_rows()
    assert run_trie(spark, rows, monkeypatch) == brute_trie([r[:4] for r in rows])


def test_trie_of_copies(spark, monkeypatch):
    """Many equal conversations end at one node; their ids leave the merges in runs."""
    for name, value in (("FAN", 2), ("RUN", 40)):
        monkeypatch.setattr(conversations, name, value)
    rows = [(5 * c, t, "user", f"turn {t}" if c % 3 else f"turn {t} {c}", "", 0) for c in range(600) for t in range(3)]
    assert run_trie(spark, rows, monkeypatch) == brute_trie([r[:4] for r in rows])


def test_trie_without_turns(spark, monkeypatch):
    assert run_trie(spark, [(None, 1, "a", "b", "", 0)], monkeypatch) == []
    alone = next(c for c in range(1, 1000) if c % 5 and crc9(c) > 1)  # its source is absent, and its only turn goes
    assert run_trie(spark, [(alone, 1, "a", "b", "", 0)], monkeypatch) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def brute_negatives(rows, k=10, positives=5, lower=30, upper=90):
    """rows: (id, vector of integers or None, label)."""
    known = [(i, v, x) for i, v, x in rows if v is not None]
    first = {}
    for i, v, label in known:
        if i % 100 == 0:
            key = (label, np.array(v, np.int32).tobytes())
            if i not in first or key < first[i][0]:
                first[i] = (key, v, label)
    out = []
    for a, (_, v, label) in first.items():
        met = sorted((-int(np.dot(v, w)), i, x) for i, w, x in known if len(w) == len(v))
        for r, (p, i, _) in enumerate([m for m in met if m[2] == label and m[1] != a][:positives], 1):
            found = [m for m in met if m[2] != label and lower * -p <= 100 * -m[0] <= upper * -p][:k]
            out += [(a, i, n, m[1], -p, -m[0], r) for n, m in enumerate(found, 1)]
    return sorted(out)


def vectors():
    rng = random.Random(3)
    rows = []
    for i in [*range(320), 100, 100, 7, 7]:
        v = [rng.choice([-0.7, 0.1, 0.3, 0.9, rng.random()]) for _ in range(8 if i % 11 else 5)]
        rows.append([i, v, None if i % 29 == 3 else rng.choice([0, 1, 2]), "clash", 0])
    for i in range(20, 60):
        rows[i][1] = [0.5] * 8  # a very common vector
    rows[9][1], rows[10][1], rows[11][1], rows[12][1], rows[13][1], rows[14][1] = None, [0.1, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [], [1e30] * 8
    rows[200][1] = [-0.5] * 8
    return [tuple(r) for r in rows]


def coded(rows, relabel=lambda i, x: x):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    bound = lambda v: [int(x) for x in np.clip(np.floor(256 * np.array(v, float)), -(1 << 26), 1 << 26)]
    return [(i, bound(v), relabel(i, x)) for i, v, x, *_ in rows if x is not None and fine(v)]


@pytest.mark.parametrize("block_rows, block_anchors, scores", [(1 << 15, 1 << 12, 1 << 23), (20, 1, 60)])
def test_negatives(spark, monkeypatch, block_rows, block_anchors, scores):
    monkeypatch.setattr(negatives, "SCORES", scores)
    monkeypatch.setattr(negatives, "PACK_ROWS", 7 if scores == 60 else 1024)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block string, dims int")
    found = negatives.hard_negatives(spark, df, df.filter("vec_id % 100 = 0"), block_rows=block_rows, block_anchors=block_anchors)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(coded(rows))
    assert negatives.hard_negatives(spark, df.limit(0), df.limit(0)).count() == 0


def test_negatives_query(spark):
    """The query's rows on the whole table, by the definition in whole numbers."""
    data = "/root/testdata/sf0.1"
    rows = duck("select vec_id, embedding, label from embeddings", data)
    relabel = lambda i, x: (x + 1) % 10 if i % 7 == 0 else x
    want = brute_negatives(coded([(int(i), [float(x) for x in v], int(x)) for i, v, x in zip(rows.vec_id, rows.embedding, rows.label, strict=True)], relabel))
    assert sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, data).collect()) == want


def brute_features(text):
    raw = "".join(c if c.isalpha() and ord(c) > 127 or "a" <= c <= "z" else " " if ord(c) < 128 else c for c in (text or "").lower()).encode()
    raw = b" " + raw + b" " * 9
    return {int.from_bytes(raw[i : i + n], "little") for n in (4, 6, 8) for i in range(len(raw) - n) if b" " not in raw[i + 1 : i + n - 1]}


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_word_parts(hard_texts, monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = [*hard_texts[:60], "Ärger über Öl, 12x-y!", "STRASSE straße", "\0a\0", "😀 x😀", "a" * 30]
    column = pa.array(texts)
    got = [set() for _ in texts]
    for doc, keys in toxicity.features(column):
        for d, k in zip(doc.tolist(), keys.tolist(), strict=True):
            got[d].add(k)
    assert got == [brute_features(t) for t in texts]
    kept = np.array(sorted(set().union(*got)), np.uint64)[::3]
    doc, spot = toxicity.Lookup(kept).rows(column)
    assert list(zip(doc, kept[spot], strict=True)) == sorted((i, k) for i, f in enumerate(got) for k in f & set(kept.tolist()))


def test_weights_are_the_least():
    """At the found weights the slope of loss and penalties, taken by differences over dense matrices, is 0."""
    rng = np.random.default_rng(4)
    x, y = (rng.random((80, 12)) < 0.3).astype(float), (rng.random(80) < 0.4).astype(int)
    change, share = rng.integers(-1, 2, (9, 12)).astype(float), np.full(9, 1 / 9)
    sparse = lambda m: toxicity.Sparse(*np.nonzero(m), m[np.nonzero(m)], m.shape)
    w = toxicity.fitted(sparse(x), y, sparse(change), share, 0.1, 2.0)

    def loss(v):
        t = x @ v[:-1] + v[-1]
        return np.logaddexp(0, np.where(y == 1, -t, t)).sum() + 0.05 * (v[:-1] ** 2).sum() + 0.5 * 2.0 * 80 * (share * (change @ v[:-1]) ** 2).sum()

    for i in range(13):
        e = np.eye(13)[i] * 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-2


def group_documents():
    """Toxic texts mostly speak of one group, and half of them have no other word in common; others name another group or nobody."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdklmnrstaeiou") for _ in range(5))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [word() for _ in range(rng.randint(6, 30))]
        if toxic:
            words += rng.sample(["vilefool", "dreckding", "saleté"], rng.randint(0, 1))
        if rng.random() < (0.95 if toxic else 0.01):
            words.append("immigrants")
        elif rng.random() < 0.4:
            words.append(rng.choice(["people", "women", "europeans"]))
        rng.shuffle(words)
        docs.append((i, " ".join(words) + ".", "en", "s", 7))
        labels.append((i, int(toxic)))
    return docs, labels


def test_swaps_protect_neutral_mentions(spark):
    docs, labels = group_documents()
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, toxic int")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = pa.array([f"the immigrants came {w}" for w in ("home", "to town", "by train", "and sang")])
    toxic = pa.array([f"the {w} are vilefool" for w in ("immigrants", "women", "people")])
    plain, fair = toxicity.train(docs, labels, pairing=0.0), toxicity.train(docs, labels)
    assert (plain.score(neutral) >= 0.5).all()  # a false positive on each neutral mention
    nobody = fair.score(pa.array(["the teachers came home"]))[0]  # as high as toxic texts without a word in common are frequent
    assert nobody < 0.3 and np.abs(fair.score(neutral) - nobody).max() < 0.05 and (fair.score(toxic) > 0.7).all()
    gap = lambda m: np.ptp(m.margin(pa.array([f"we met {w} there" for w in ("immigrants", "women", "people", "foreigners")])))
    assert gap(fair) < 0.1 * gap(plain)


def test_toxicity_without_much(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, ""), (None, "vilefool"), (4, "12 !")], "doc_id long, text string")
    label = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, toxic int")
    scores = lambda labels: sorted((r.doc_id or 0, r.score) for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect())
    ids = [0, 1, 2, 3, 3, 4]
    assert scores(label().limit(0)) == [(i, 0.5) for i in ids]
    assert scores(label((None, 1), (1, None))) == [(i, 0.5) for i in ids]
    assert all(s < 1e-9 for _, s in scores(label((1, 0), (2, 0)))) and all(s > 1 - 1e-9 for _, s in scores(label((1, 1))))
    for rows in ([(1, 1), (2, 0)], [(1, 1), (1, 0), (2, 0), (3, 0), (4, 0)], [(9, 1), (1, 0), (2, 1)]):
        got = scores(label(*rows))
        assert [i for i, _ in got] == ids and all(0 < s < 1 for _, s in got)
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), label())).count() == 0


def test_toxicity_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    labels = {int(i): int(t) for i, t in duck("select doc_id, toxic from labels where toxic is not null", data).itertuples(index=False)}
    rows = toxicity.op11_toxicity(spark, data).collect()
    assert len(rows) == duck("select count(*) as n from documents", data).n[0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for p, t in held if t]
    assert sum(toxic) / len(toxic) > 0.8 and np.mean([p for p, t in held if not t]) < 0.005


@pytest.mark.parametrize("few", [*range(11), 60])
def test_quality_of_a_class_of_few_rows(few):
    """Whatever the number of rows of a class and their places: a model, or the frequency, near the base rate."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        y = np.zeros(60 if few < 60 else 120, int)
        y[rng.permutation(len(y))[:few]] = 1
        x = rng.normal(size=(len(y), len(quality.STATISTICS))) @ rng.normal(size=(len(quality.STATISTICS),) * 2) + 0.5 * y[:, None]
        score = quality.Discriminant(x, y).score(x)
        assert np.isfinite(score).all() and abs(score.mean() - y.mean()) < 0.1
        assert few or (score == 0).all()
    flat = quality.Discriminant(np.zeros((9, 3)), np.arange(9) % 2).score(np.zeros((2, 3)))  # statistics that don't differ
    assert np.isfinite(flat).all()


def test_marks_are_no_text_of_a_language(spark):
    docs = spark.createDataFrame([(1, "́̀ ̈"), (2, "á"), (3, "\U0001d165"), (4, "\U00010400"), (5, "12 .")], "doc_id long, text string")
    model = langid.Model.of({"en": ["the cat sat on the mat"] * 3, "fr": ["le chat est sur la table"] * 3})
    got = {r.doc_id: r._lang_pred for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (1, 3, 5)] == ["und"] * 3 and {got[2], got[4]} <= {"en", "fr"}


def test_one_block_of_items_at_a_time(spark, documents, hard_texts, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(hard_texts) if t and i % 3 == 0], "item_id long, text string")
    one = sorted(map(str, decontaminate.contained_items(spark, documents, items).collect()))
    clean = sorted(map(str, decontaminate.decontaminated(spark, documents, items).collect()))
    live, most, broadcast = set(), [], spark.sparkContext.broadcast

    def counted(value):
        out = broadcast(value)
        live.add(id(out))
        most.append(len(live))
        destroy = out.destroy
        out.destroy = lambda *a: (live.discard(id(out)), destroy(*a))
        return out

    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 300)
    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    assert sorted(map(str, decontaminate.contained_items(spark, documents, items).collect())) == one
    assert sorted(map(str, decontaminate.decontaminated(spark, documents, items).collect())) == clean
    assert len(most) > 10 and max(most) == 1 and len(clean) < len(hard_texts)


def all_paths(vocabulary, text):
    """Backpointers of plain Viterbi over a whole text (blanks as U+2581)."""
    n, low = len(text), float("-inf")
    best, back = [0.0] + [low] * n, [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + vocabulary.longest) + 1):
            found = vocabulary.table.get(text[i:j])
            score = found[1] if found else vocabulary.fallback if j == i + 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    return back


def test_pieces_are_committed_where_all_paths_meet():
    """In running text there is a commit at every word, in long words now and then, and every path goes through each committed boundary."""
    vocabulary = pieces.Vocabulary.load()
    codec = pieces.Codec(vocabulary)
    texts = duck("select text from documents where text is not null", "/root/testdata/sf0.001").text.tolist()
    texts += ["wonderful" * 300, "x" * 200, "  two  blanks ", "Ünïcödé 😀😀 \n\n end", "a\tb" * 50]
    for t in texts:
        portions = [list(p) for p in codec.commits(t)]
        assert [i for p in portions for i in p] == list(codec.encode(t))
        assert len(portions) > 1 or len(t) <= vocabulary.longest or t == "x" * 200
        if len(t) < 2800 and pieces.BLANK not in t:
            marked = pieces.BLANK + t.replace(" ", pieces.BLANK)
            back, bounds, size = all_paths(vocabulary, marked), [], 0
            for p in portions[:-1]:
                size += sum(len(vocabulary.plain[i]) for i in p)
                bounds.append(size)
            places = [len((" " + t).encode()[:b].decode()) for b in bounds]  # characters
            for at in places:
                meets = []  # whether the path of each place ahead goes through the boundary
                for q in range(at, min(len(marked), at + 400) + 1):
                    while q > at:
                        q = back[q]
                    meets.append(q == at)
                wide = min(vocabulary.longest, len(meets))  # all that may be alive at some time of the walk
                assert any(all(meets[f : f + wide]) for f in range(len(meets) - wide + 1)) or meets[-1]
                if marked[at] == pieces.BLANK and marked[at - 1] != pieces.BLANK:
                    assert all(meets)
    assert len(list(codec.commits("wonderful" * 300))) > 20  # no blank in it
