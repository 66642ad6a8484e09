import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grovespark.llm import brown_lm as M
from grovespark.llm import decontaminate as D
from grovespark.llm import toxicity as T
from grovespark.llm.text import NO_LETTER, chunks, shingle_set
from tests.conftest import rows
from tests.llm.fixtures import docs, odd_rows, sentence, text


def features(texts):
    return [f for part in chunks(pa.array(texts, pa.string()), NO_LETTER) for f in T.features(part)]


def test_ordinal_regression_finds_the_grades():
    """Three grades told by words; the same weights serve both thresholds."""
    r = random.Random(1)
    rows_, grades = [], []
    for _ in range(1500):
        g = r.choice([0, 0, 0, 1, 2])
        words = text(r, 3, 12).split()
        for w in {0: [], 1: ["rude"], 2: ["rude", "vile"]}[g]:
            words.insert(r.randrange(len(words)), w + r.choice(["", ".", "!"]))
        rows_.append(" ".join(words))
        grades.append(g)
    f, g = features(rows_), np.array(grades)
    model = T.fit(f[:1000], g[:1000])
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    score = np.concatenate([model.score(p) for p in chunks(pa.array(rows_[1000:]), NO_LETTER)])
    expected = model.severity(score)
    assert np.mean(np.abs(expected - g[1000:]) < 0.5) > 0.97
    assert np.all(np.diff([expected[g[1000:] == k].mean() for k in range(3)]) > 0.5)


def test_scores_agree_with_plain_sums():
    model = T.fit(features(["bad thing here"] * 20 + ["good thing here"] * 20), np.array([1] * 20 + [0] * 20))
    texts = ["bad", "a good, BAD badger", "", None, "thing thing thing"]
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    got = np.concatenate([model.score(p) for p in chunks(pa.array(texts), NO_LETTER)])
    assert np.allclose(got, [sum(weight.get(int(x), 0.0) for x in f) for f in features(texts)])


def test_toxicity_over_tables(spark):
    r = random.Random(2)
    table = [(k, text(r, 2, 10) + (" you moron" if k % 3 == 0 else "")) for k in range(300)] + [(900, None), (901, ""), (None, "moron " * 3)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 300, 2)] + [(None, 1), (5, None), (4, 0), (9999, 1)], "doc_id long, toxic int")
    df = docs(spark, table)
    model = T.fit_labels(df, labels)
    got = {x["doc_id"]: x["toxic"] for x in T.grade_documents(df, model).collect()}
    assert got == {i: (i is None or (i < 300 and i % 3 == 0)) for i, _ in table}
    kept = T.keep_clean(df, model)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, bad in got.items() if not bad}
    none = T.fit_labels(df, labels.where("false"))
    assert T.grade_documents(df, none).where("toxic").count() == 0
    assert T.grade_documents(docs(spark, []), model).count() == 0


def test_severity_agrees_with_plain_sums(spark):
    """Words and their first bytes by a regular expression, each once; the sum of the chances of every grade."""
    r = random.Random(12)
    grades = {k: r.choice([0, 0, 1, 2]) for k in range(400)}
    table = [(k, text(r, 2, 10) + {0: "", 1: " You rude one!", 2: " RUDE vile-vile thing"}[g]) for k, g in grades.items()] + [(500, "rudeness, ärger; VILE"), (501, None), (502, "..."), (None, "vile")]
    model = T.fit_labels(docs(spark, table), spark.createDataFrame(list(grades.items()), "doc_id long, severity int"), "severity")
    assert len(model.thresholds) == 2
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))

    def hashes(word):
        part = next(chunks(pa.array([word]), NO_LETTER))
        return {int(part.hashes[0]), *[int(part.prefixes(k)[0]) for k in T.STEMS]}

    want = []
    for i, t in table:
        words = {w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())}
        score = sum(weight.get(h, 0.0) for h in set().union(*[hashes(w) for w in words]))
        want.append((i, sum(1 / (1 + math.exp(float(x) - score)) for x in model.thresholds)))
    got = T.grade_documents(docs(spark, table), model).collect()
    for a, b in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"])), sorted(want, key=lambda x: (x[0] is None, x[0])), strict=True):
        assert a["doc_id"] == b[0] and abs(a["severity"] - b[1]) < 1e-9 and a["toxic"] == (b[1] >= T.REJECT)


def test_best_run_agrees_with_the_plain_table():
    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 14))]
        plain = [[0] * (len(b) + 1)]
        for i in range(1, len(a) + 1):
            row = [i]
            for j in range(1, len(b) + 1):
                row.append(min(plain[-1][j - 1] + (a[i - 1] != b[j - 1]), plain[-1][j] + 1, row[-1] + 1))
            plain.append(row)
        edits, low, high = D.best_run(np.array(a, np.uint64), np.array(b, np.uint64))
        assert edits == min(plain[-1]) and 0 <= low <= high <= len(b)
        part = b[low:high]
        d = list(range(len(part) + 1))
        for i in range(1, len(a) + 1):
            d, before = [i], d
            for j in range(1, len(part) + 1):
                d.append(min(before[j - 1] + (a[i - 1] != part[j - 1]), before[j] + 1, d[-1] + 1))
        assert d[-1] == edits, "the run found has that distance"


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        how = r.randrange(3)
        if how == 0:
            words[at] = f"new{r.randrange(999)}"
        elif how == 1:
            words.insert(at, f"new{r.randrange(999)}")
        elif len(words) > 2:
            del words[at]
    return words


def test_leaks_against_all_pairs(spark):
    """Recall against exact distances of every document and item, at up to the allowed edits."""
    r = random.Random(4)
    items = [(k, " ".join(sentence(r, r.randint(8, 20)) for _ in range(r.randint(1, 3)))) for k in range(40)] + [(90, "too short"), (91, None), (92, ""), (93, "...")]
    table = []
    for k in range(300):
        body = text(r, 3, 14)
        if k % 2:
            words = items[r.randrange(40)][1].split()
            body = f"{text(r, 2, 9)} {' '.join(edited(r, words, r.randint(0, int(0.2 * len(words)))))} {body}"
        table.append((k, body))
    table += [(900, None), (901, ""), (902, items[0][1].upper() + "!"), (902, items[0][1].upper() + "!"), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(docs(spark, table), bench)
    pairs = Counter((x["doc_id"], x["item_id"]) for x in got.collect())
    assert pairs[902, 0] == 2 and pairs[None, 1] == 1
    model = D.Items(items)
    want = set()
    for part in chunks(pa.array([t for _, t in table], pa.string()), NO_LETTER, letters=True):
        for i in range(len(part)):
            for item, words in zip(model.ids, model.words, strict=True):
                if len(part.of(i)) and D.best_run(words, part.of(i))[0] <= D.allowed(len(words)):
                    want.add((table[part.low + i][0], item))
    assert set(pairs) <= want and len(set(pairs)) >= 0.98 * len(want) and len(want) > 140
    exact = {(i, k) for i, t in table for k, x in items[:40] if t and x.lower() in t.lower()}
    assert exact <= set(pairs), "an unedited item is always found"
    at = next(x for x in got.collect() if x["doc_id"] == 902)
    assert items[0][1].upper()[at["start"] : at["end"]] == items[0][1].upper().rstrip(".")
    kept = D.keep_uncontaminated(docs(spark, table), bench)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in table} - {i for i, _ in pairs} and kept.columns == docs(spark, []).columns
    assert D.leaks(docs(spark, []), bench).count() == 0 and D.leaks(docs(spark, table), bench.where("false")).count() == 0


def test_short_items_and_letters(spark):
    """Items of one to four words as they are; Chinese and Japanese letters are words, whatever stands beside them."""
    kanji = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少"
    items = [(1, "zyx"), (2, "alpha beta"), (3, "One, two three"), (4, "a b c d"), (5, "日本語"), (6, kanji), (None, "of no id")]
    changed = kanji[:5] + "猫" + kanji[6:12] + kanji[13:]
    table = [
        (1, "so ZYX it is"), (2, "zyxx alpha, Beta"), (3, "one two. Three four"), (4, "a b c e d"), (5, "x a-b c d"), (6, "alpha gamma beta"), (7, "これは日本語です"), (8, "日本 語"), (9, f"漢字{kanji}漢字"),
        (10, f"abc{changed}def"), (11, kanji[::2]), (12, "日本"), (13, "was of no id here"), (14, None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in D.leaks(docs(spark, table), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 4), (7, 5), (8, 5), (9, 6), (10, 6), (13, None)}
    assert got[10, 6]["edits"] == 2 and got[7, 5]["item_words"] == 3
    assert dict(table)[9].encode()[got[9, 6]["start"] : got[9, 6]["end"]].decode() == kanji


def test_blocks_of_items(spark, monkeypatch):
    r = random.Random(5)
    items = [(k, sentence(r, 12)) for k in range(30)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, [(k, f"{text(r)} {x}") for k, x in items])
    one = rows(D.leaks(df, bench), "doc_id", "item_id", "edits")
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    assert rows(D.leaks(df, bench), "doc_id", "item_id", "edits") == one and len(one) >= 30


def test_exchange_finds_planted_classes():
    """Words of two kinds that follow each other strictly come apart."""
    r = random.Random(6)
    n = 41
    pairs = np.zeros((n, n), np.int64)
    for _ in range(20000):
        a, b = r.randrange(0, 20), r.randrange(20, 40)
        pairs[a, b] += 1
        pairs[b, r.randrange(0, 20)] += 1
    of = M.exchange(pairs, classes=2)
    assert len(set(of[:20])) == 1 and len(set(of[20:40])) == 1 and of[0] != of[20] and of[40] == 2


def likelihood(pairs, of):
    k = of.max() + 1
    grid = np.zeros((k, k))
    np.add.at(grid, (of[:, None], of[None, :]), pairs)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(grid) - f(grid.sum(1)) - f(grid.sum(0))


def test_exchange_never_lowers_the_likelihood():
    g = np.random.default_rng(7)
    pairs = g.poisson(2, (30, 30)) * (g.random((30, 30)) < 0.4)
    values = [likelihood(pairs, M.exchange(pairs, classes=4, sweeps=s)) for s in range(6)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0]


def test_best_classes_against_every_move(monkeypatch):
    """Each word's class is the one where the likelihood of a full recount is largest."""
    monkeypatch.setattr(M, "CELLS", 40)
    g = np.random.default_rng(3)
    n, k = 25, 5
    pairs = g.poisson(1, (n, n)) * (g.random((n, n)) < 0.3)
    of = np.append(g.integers(0, k - 1, n - 1), k - 1)
    grid = np.zeros((k, k))
    np.add.at(grid, (of[:, None], of[None, :]), pairs)
    entries = []
    for u in range(n - 1):
        out, into = np.bincount(of, pairs[u], k), np.bincount(of, pairs[:, u], k)
        out[of[u]] -= pairs[u, u]
        into[of[u]] -= pairs[u, u]
        entries += [(u, key, x) for key, x in enumerate([*out, *into, pairs[u, u]]) if x]
    got = M.best_classes(of[:-1], *(np.array(x, np.int64) for x in zip(*entries, strict=True)), grid)
    moved = 0
    for u in range(n - 1):
        values = []
        for c in range(k - 1):
            trial = of.copy()
            trial[u] = c
            table = np.zeros((k, k))
            np.add.at(table, (trial[:, None], trial[None, :]), pairs)
            values.append(M.likelihood(table))
        assert values[got[u]] >= max(values) - 1e-6
        moved += got[u] != of[u]
    assert moved > 3


def test_words_outside_the_seed_move_by_themselves(spark, monkeypatch):
    """Rare words of two kinds with one ending come apart, and the likelihood rises."""
    monkeypatch.setattr(M, "seed_size", lambda types: (4, 2))
    monkeypatch.setattr(M, "CHUNK", 2000)
    r = random.Random(10)
    left, right = [f"l{k}xx" for k in range(60)], [f"r{k}xx" for k in range(60)]
    table = [(k, " ".join(r.choice([r.choice(["aa", "bb"]), r.choice(left)]) + " " + r.choice([r.choice(["cc", "dd"]), r.choice(right)]) for _ in range(60))) for k in range(60)]
    coded = M.code(docs(spark, table))
    words = M.vocabulary(coded, 5)
    seed = M.learn(coded, words)
    labels, m = M.refine(coded, words, seed, 5)
    assert M.likelihood(m.grid) > M.likelihood(seed.grid) and m.grid.sum() == seed.grid.sum()
    of, names = {}, {}
    for part in chunks(pa.array([" ".join(left + right + ["aa", "cc"])])):
        names = {int(h): part.word(i).decode() for i, h in enumerate(part.hashes)}
    for x in labels.collect():
        of |= {names[h]: c for h, c in zip(np.frombuffer(x["hashes"], np.uint64).tolist(), M._unpack(x["classes"], np.uint16).tolist(), strict=True) if h in names}
    assert {of[w] for w in left} == {of["aa"]} != {of["cc"]} == {of[w] for w in right}
    assert m.types.sum() == m.v - 1 and abs((10**m.follow).sum(1) - 1).max() < 1e-9


def test_seed_grows_with_the_vocabulary():
    sizes = [M.seed_size(v) for v in (0, 10**4, 10**6, 10**8)]
    assert sizes[0] == (M.TOP, M.CLASSES) and sizes[3] > sizes[2] > sizes[1] and sizes[3][0] < 4000


def model_scores(table):
    c = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in table:
        if not M.held_out(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, M.held_out(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for i, t in table]


@pytest.mark.parametrize("chunk", [M.CHUNK, 400])
def test_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    r = random.Random(8)
    table = odd_rows() + [(100 + k, text(r, 3, 10)) for k in range(60)]
    got = sorted(M.train_and_score(docs(spark, table)).collect(), key=lambda x: (x["doc_id"] is not None, x["doc_id"], x["n_tokens"], x["base_score"]))
    want = sorted(model_scores(table), key=lambda x: (x[0] is not None, x[0], x[2], x[5]))
    for a, b in zip(got, want, strict=True):
        assert (a["doc_id"], a["held_out"], a["n_tokens"], a["n_known"], a["train_tokens"]) == b[:5]
        assert abs(a["base_score"] - b[5]) < 1e-6 and a["score"] < 0
    assert M.held_out(None) == (zlib.crc32(b"") % 10 == 0)
    assert M.train_and_score(docs(spark, [])).count() == 0


def test_score_agrees_with_a_plain_recount(spark):
    """By the classes that words got: counts of classes in a row and of words, all recounted by plain loops."""
    r = random.Random(11)
    table = [(k, text(r, 3, 10)) for k in range(80)] + [(500, None), (501, "never seen words"), (502, "")]
    df = docs(spark, table)
    coded = M.code(df)
    words = M.vocabulary(coded, 5)
    labels, model = M.refine(coded, words, M.learn(coded, words), 5)
    split = lambda t: (t or "").encode().lower().split()
    of, seen = {}, {}
    for part in chunks(pa.array([t for _, t in table])):
        seen |= {int(h): part.word(i) for i, h in enumerate(part.hashes)}
    for x in labels.collect():
        of |= {seen[h]: c for h, c in zip(np.frombuffer(x["hashes"], np.uint64).tolist(), M._unpack(x["classes"], np.uint16).tolist(), strict=True)}
    k = len(model.follow)
    train = [split(t) for i, t in table if not M.held_out(i)]
    count, pairs, tokens = Counter(w for t in train for w in t), Counter(), Counter()
    for t in train:
        track = [k - 1, *[of[w] for w in t], k - 1]
        pairs.update(zip(track, track[1:], strict=False))
    for w, n in count.items():
        tokens[of[w]] += n
    types, begin = Counter(of[w] for w in count), Counter()
    for (a, _), n in pairs.items():
        begin[a] += n
    want = {}
    for i, t in table:
        track = [k - 1, *[of[w] for w in split(t)], k - 1]
        follow = sum(math.log10((pairs[a, b] + M.ALPHA) / (begin[a] + M.ALPHA * k)) for a, b in zip(track, track[1:], strict=False))
        want[i] = follow + sum(math.log10((count[w] + M.ALPHA) / (tokens[of[w]] + M.ALPHA * (types[of[w]] + 1))) for w in split(t))
    got = {x["doc_id"]: x["score"] for x in M.score(labels, model).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_probabilities_sum_to_one(spark):
    r = random.Random(9)
    table = [(k, text(r, 3, 10)) for k in range(40)]
    coded = M.code(docs(spark, table))
    words = M.vocabulary(coded, 5)
    m = M.learn(coded, words)
    assert np.allclose((10**m.follow).sum(1), 1)
    v = [x.asDict() for x in words.collect()]
    hashes, counts, endings = (np.concatenate([np.frombuffer(x[k], d) for x in v]) for k, d in (("hashes", np.uint64), ("counts", np.int64), ("endings", np.uint16)))
    classes, own, base = m.log_words(hashes, endings, counts)
    for k in set(classes.tolist()):
        unseen = M.ALPHA / (m.tokens[k] + M.ALPHA * (m.types[k] + 1))
        assert abs((10 ** own[classes == k]).sum() + unseen - 1) < 1e-9
    end = (m.ends + M.ALPHA) / (m.n + M.ALPHA * (m.v + 1))
    assert abs((10**base).sum() + end + M.ALPHA / (m.n + M.ALPHA * (m.v + 1)) - 1) < 1e-9


def test_held_out_texts_are_better_predicted_than_by_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = M.train_and_score(df).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert held[0] > held[1] + 0.1


def test_words_and_shingles():
    texts = ["The quick  brown\nFox\x0bjumps ÉÀ over", None, "", " \t ", "the", "a b c d", "ä\u00a0b c\x1cd"]
    got = []
    for part in chunks(pa.array(texts, pa.string())):
        got += [[part.word(k) for k in range(part.first[i], part.first[i + 1])] for i in range(len(part))]
    assert got == [(t or "").encode().lower().split() for t in texts]
    sets = [shingle_set(part.of(i)) for part in chunks(pa.array(["a b c d e f", "A  b c D e F", "a b c d", "a b c d e", "", "b a c d"])) for i in range(len(part))]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 1] and (sets[0] == sets[1]).all() and sets[2][0] != sets[5][0] and sets[3][0] in sets[0]


def test_brown_tables_leave_no_shuffle_files(spark):
    """Shuffles of a table that is written are deleted then, not when the driver happens to collect its garbage."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: {f for f in str(env.blockManager().diskBlockManager().getAllFiles().mkString("\n")).splitlines() if "/shuffle_" in f}
    coded = M.code(docs(spark, [(k, f"a b c {k}") for k in range(20)]))
    before = held()
    words = M.vocabulary(coded, 5)
    assert not held() - before
    assert words.selectExpr("sum(octet_length(hashes)) / 8").first()[0] > 3
