import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm import jaccard_join as J
from grovespark.llm import line_dedup as L
from grovespark.llm import substring_dedup as S
from grovespark.llm.components import components
from tests.conftest import rows
from tests.llm.fixtures import docs, odd_rows, sentence, text

KEY = lambda i: (i is not None, i or 0)  # noqa: E731  null ids first


def passages(seed=3):
    """Documents that share runs of lines, at different places, and a common line."""
    r = random.Random(seed)
    shared = [[sentence(r, 10) for _ in range(r.randint(1, 7))] for _ in range(5)]
    out = []
    for k in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            lines += [sentence(r, 10) for _ in range(r.randint(0, 3))] + r.choice([*shared, ["common line"], ["", "  "]])
        out.append((k, "\n".join(lines)))
    return out


def model_lines(table, run=L.RUN):
    """Deleted (id, text, line) by comparing every window with all earlier ones."""
    seen, gone = set(), set()
    marks = {}
    for i, t in sorted({x for x in table if x[1]}, key=lambda x: (KEY(x[0]), x[1])):
        marks.setdefault((i, t), [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")])
    for (i, t), lines in marks.items():
        for s in range(max(1, len(lines) - run + 1)) if lines else []:
            w = lines[s : s + run]
            key = tuple(x for _, x in w)
            if key in seen:
                gone |= {(i, t, k) for k, _ in w}
            seen.add(key)
    return gone


@pytest.mark.parametrize("table", [passages(), odd_rows()[:-9] + odd_rows()[-4:]])
def test_lines(spark, table):
    df = docs(spark, table)
    of = {(r["doc_id"], r["m"]): r["text"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    got = {(r["doc"], of[r["doc"], r["mark"]], r["line"]) for r in L.repeated_lines(df).collect()}
    assert got == model_lines(table)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "lines_deleted"]
    want = []
    for i, t in table:
        cut = {k for a, b, k in got if (a, b) == (i, t)}
        new = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        if not cut or new.strip():
            want.append((i, new, len(cut)))
    assert rows(out, "doc_id", "text", "lines_deleted") == sorted(want, key=repr)


def test_lines_odd_cases(spark):
    assert L.dedup_lines(docs(spark, [])).count() == 0
    got = {(r["doc_id"], r["text"]) for r in L.dedup_lines(docs(spark)).collect()}
    assert {(22, None), (23, ""), (24, " \n\t \r\n")} <= got
    assert 20 not in {i for i, _ in got} and (28, "one") not in got, "whole copies go"
    plans = L.repeated_lines(docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plans for x in ("Python", "Arrow", "Pandas")), "DataFrame operations alone"


def test_only_selected_windows_are_compared(spark, monkeypatch):
    """Fingerprints decide: with a selection that no two documents share, nothing is found."""
    table = passages()
    assert L.repeated_lines(docs(spark, table)).count() > 0
    whole = L._hashed
    other = lambda *args: whole(*args).withColumn("lines", F.transform("lines", lambda x: x.withField("order", x["order"]).withField("h", F.xxhash64(x["h"], "doc"))))
    monkeypatch.setattr(L, "_hashed", other)
    assert {r["doc"] for r in L.repeated_lines(docs(spark, table)).collect()} <= {i for i, t in table if any(t.count(x) > 1 for x in t.split("\n"))}


def model_long_lines(table, run=L.RUN, least=L.LONG_WORDS):
    """model_lines() and shorter runs of so many words, in documents of any length."""
    gone, seen = model_lines(table, run), {}
    for i, t in sorted({x for x in table if x[1]}, key=lambda x: (KEY(x[0]), x[1])):
        lines = [(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()]
        for size in range(1, run):
            for s in range(len(lines) - size + 1):
                w = lines[s : s + size]
                key = tuple(x for _, x in w)
                if size == len(lines) or sum(len(x.split()) for x in key) >= least:
                    # a whole short document counts at any length, against others like it
                    kind = sum(len(x.split()) for x in key) >= least or "whole"
                    gone |= {(i, t, k) for k, _ in w} if (kind, key) in seen else set()
                    seen[kind, key] = True
    return gone


def test_long_lines(spark):
    """A pasted line of 60 words, two of 30, and one of 49, in documents of one, two and more lines."""
    r = random.Random(14)
    one, two, short = sentence(r, 60), f"{sentence(r, 30)}\n  {sentence(r, 25)}", sentence(r, 49)
    own = [text(r, 3) for _ in range(12)]
    table = [(k, f"{own[k]}\n{x}\n{own[k + 1]}") for k, x in ((0, one), (2, two), (4, short), (6, one), (8, two), (10, short))]
    table += [(20, one), (21, two), (22, short), (23, f"{short}\nown line"), (24, f"{two}\n{one}"), (25, f"{one}\n{one}"), (None, f"{own[11]}\n{one}")] + [(300 + i, t) for i, t in passages(15)[:20]]
    df = docs(spark, table)
    of = {(x["doc_id"], x["m"]): x["text"] for x in df.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    got = {(x["doc"], of[x["doc"], x["mark"]], x["line"]) for x in L.repeated_lines(df).collect()}
    assert got == model_long_lines(table)
    assert len(got - model_lines(table)) > 4, "runs of lines alone miss them"
    assert {(x["doc"], of[x["doc"], x["mark"]], x["line"]) for x in L.repeated_lines(df, long_words=None).collect()} == model_lines(table)
    kept = {x["doc_id"] for x in L.dedup_lines(df).collect()}
    assert not {20, 21, 24, 25} & kept and {22, 23} <= kept


def model_units(table, least=S.LEAST_WORDS, near=S.NEAR):
    """{(id, text): [(start, end, words, first id, first start)]} by plain splitting; offsets in bytes."""
    found = []
    for i, t in sorted({x for x in table if x[1]}, key=lambda x: (KEY(x[0]), MARK(x[1]))):
        raw = t.encode()
        words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw))
        size = [len(w[0]) for w in words]
        longest = [all(size[k] > n for n in size[max(0, k - near) : k]) and all(size[k] >= n for n in size[k + 1 : k + 1 + near]) for k in range(len(words))]
        starts = [k for k, w in enumerate(words) if k == 0 or longest[k - 1] or re.search(rb"\n|[.!?] ", raw[words[k - 1].end() : w.start()])]
        for p, k in enumerate(starts):
            stop = next((x for x in [*starts[p + 1 :], len(words)] if x - k >= least), None)
            if stop:
                end = words[stop - 1].end() + len(re.match(rb"[^\t\n\x0b\x0c\r ]*", raw[words[stop - 1].end() : words[stop].start() if stop < len(words) else len(raw)])[0])
                found.append((tuple(w[0].lower() for w in words[k:stop]), i, t, words[k].start(), end))
    first, later = {}, defaultdict(list)
    for words, i, t, a, b in found:
        x = first.setdefault(words, (i, t, a, b))
        if x != (i, t, a, b) and not (x[:2] == (i, t) and a < x[3]):
            later[i, t].append((a, b, len(words), x[0], x[2]))
    return later


def check_units(spark, table):
    global MARK
    df = docs(spark, table)
    marks = {r["text"]: r["m"] for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
    MARK = marks.get
    want = model_units(table)
    got = defaultdict(list)
    texts = {m: t for t, m in marks.items()}
    for r in S.repeated_units(df).collect():
        got[r["doc_id"], texts[r["mark"]]].append((r["start"], r["end"], r["n_words"], r["first_doc_id"], r["first_start"]))
    assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}, "repeated rows give each span again"
    left = []
    for i, t in table:
        raw, at, out = (t or "").encode(), 0, b""
        for a, b, *_ in sorted(want.get((i, t), [])):
            out += raw[at : max(at, a)]
            at = max(at, b)
        left.append((i, None if t is None else (out + raw[at:]).decode()))
    out = S.dedup_units(df)
    assert out.columns == [*df.columns, "kept"]
    assert rows(out, "doc_id", "text") == sorted(left, key=repr), "every text"
    return want


def test_units(spark):
    r = random.Random(4)
    passage = " ".join(sentence(r, n) for n in (9, 14, 3, 20, 12))
    own = [text(r) for _ in range(6)]
    table = [(0, f"{own[0]} kabo milu {passage}"), (1, own[1]), (2, f"tra lo {passage} Or so.\n{own[2]}"), (3, own[3]), (4, f"{own[4]}\n{passage.upper()}"), (5, None), (6, "")]
    assert {i for i, _ in check_units(spark, table)} == {2, 4}
    assert S.dedup_units(docs(spark)).count() == len(odd_rows()) and S.dedup_units(docs(spark, [])).count() == 0


def test_units_of_every_layout(spark):
    """Passages in short lines, of short sentences, without punctuation, and junk that repeats within itself."""
    r = random.Random(5)
    shouts = " ".join(f"{w}!!" for w in sentence(r, 60).split())
    verse = "\n".join(sentence(r, 4) for _ in range(16))
    run = " ".join(sentence(r, 8).strip(".").lower() for _ in range(9))
    table = passages(8) + [(100, f"{text(r)} {shouts}"), (101, f"{shouts}\n{text(r)}"), (102, f"It is. So. {shouts}"), (103, "ba ke li. " * 80)]
    table += [(110, f"{text(r)}\n{verse}"), (111, f"one {verse} two"), (112, f"kabo milu {run} tra"), (113, f"{text(r)} so {run}\n{text(r)}")]
    got = {i for i, _ in check_units(spark, table)}
    assert {101, 102, 103, 111, 113} <= got


def test_units_of_repeated_ids(spark):
    """The same id, or none, with different texts, in letters of several bytes: nothing is cut out of another text."""
    r = random.Random(9)
    passage, other = ((" ".join(sentence(r, 12).replace("a", mark) for _ in range(5))) for mark in ("ä", "語"))
    table = [(1, f"ßß {passage}"), (1, f"{text(r)}\n{passage} é"), (1, "é" * 200), (None, f"日本 {other}"), (None, f"{other} é"), (None, "ü" * 300), (None, None), (2, f"x {other}"), (2, f"x {other}"), (2, f"{passage}\n{other}")]
    assert {i for i, _ in check_units(spark, table)} == {None, 1, 2}


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def model_components(sets):
    """The smallest index linked to each, all pairs compared."""
    at = list(range(len(sets)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def near_copies(seed, families=6, size=12):
    """Families of edited copies around the limit, chains of edits, and a passage that all share."""
    r = random.Random(seed)
    passage = sentence(r, 30)
    out = []
    for _ in range(families):
        words = text(r, 6, 12).split()
        for k in range(size):
            copy = list(words)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            if k % 4 == 3:
                words = copy
            out.append(" ".join(copy) + (" " + passage if r.random() < 0.5 else ""))
    out += [text(r, 3, 8) + " " + passage for _ in range(15)]
    r.shuffle(out)
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("block", [J.BLOCK, 300])
def test_jaccard(spark, monkeypatch, block):
    """Also where families are cut into many blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    table = near_copies(2)
    sets = [shingles(t) for _, t in table]
    want = model_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs(spark, table)).collect()}
    assert got == {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, want, strict=True))}
    assert 20 < len(set(want)) < len(want) - 10


def test_jaccard_odd_cases(spark):
    table = odd_rows()
    got = J.jaccard_components(docs(spark, table)).collect()
    assert len(got) == len(table)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[20] == by[21] == {(len(shingles(table[0][1])), 0)} and by[22] == {(0, 22)} and by[23] == {(0, 23)} and by[24] == {(0, 24)}
    assert by[26] == by[28] == {(1, 26)} and {c for _, c in by[None]} == {None} and {c for _, c in by[25]} == {2, 3}
    assert J.jaccard_components(docs(spark, [])).count() == 0
    kept = [r["doc_id"] for r in J.keep_first(docs(spark, table)).collect()]
    assert kept.count(None) == 2 and not {20, 21, 25, 28} & set(kept) and {22, 23, 24, 26, 27, 29} <= set(kept)
    assert J.keep_first(docs(spark, table)).columns == docs(spark, []).columns


def test_jaccard_of_repeated_ids(spark):
    """Rows of one id with different texts are documents each: no link is lost between them, and one of a group stays."""
    w, v = ([sentence(random.Random(k), 60).strip(".") for k in (1, 2)])
    near = lambda t, k: t.rsplit(" ", 1)[0] + f" edit{k}"
    table = [(1, w), (1, v), (5, near(w, 5)), (6, near(v, 6)), (None, w), (7, near(v, 7)), (0, near(w, 0)), (8, "lone words here"), (8, near(v, 8)), (8, near(v, 9)), (9, text(random.Random(3)))]
    got = sorted((r["doc_id"], r["component_id"]) for r in J.jaccard_components(docs(spark, table)).collect() if r["doc_id"] is not None)
    assert got == sorted([(0, 0), (1, 0), (5, 0), (1, 1), (6, 1), (7, 1), (8, 1), (8, 1), (8, 8), (9, 9)])
    kept = sorted((r["doc_id"], r["text"]) for r in J.keep_first(docs(spark, table)).collect() if r["doc_id"] is not None)
    assert kept == sorted([(0, near(w, 0)), (1, v), (8, "lone words here"), (9, table[-1][1])])


def test_tree_links_agree_with_all_pairs():
    r = random.Random(6)
    for trial in range(60):
        base = r.sample(range(10**6), 40)
        sets = []
        for _ in range(r.randint(2, 25)):
            s = set(r.sample(base, r.randint(20, 40))) if r.random() < 0.7 else set(r.sample(range(10**6), r.randint(1, 30)))
            sets.append(s)
        at = {k: k for k in range(len(sets))}
        links = J.link_group(np.arange(len(sets)), np.array([len(s) for s in sets]), [np.array(sorted(s), np.uint64) for s in sets])
        for a, b in links:
            assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            x, y = min(at[a], at[b]), max(at[a], at[b])
            at = {k: x if v == y else v for k, v in at.items()}
        assert [at[k] for k in range(len(sets))] == model_components(sets), trial


def test_hashes_that_are_shared_are_counted_through_compaction(monkeypatch):
    monkeypatch.setattr(J, "RUN", 5)
    r, bucket, owners = random.Random(1), J._Bucket(), defaultdict(set)
    for _ in range(60):
        t = sorted(r.sample(range(40), 4))
        v = r.randrange(30)
        bucket.add(np.array(t, np.uint64), np.full(4, v, np.int64))
        for x in t:
            owners[x].add(v)
    bucket.add(np.array([99], np.uint64), np.array([7], np.int64))
    bucket.add(np.array([99], np.uint64), np.zeros(0, np.int64))  # another task's mark
    nodes, counts = bucket.finish()
    least = defaultdict(int)
    for x, vs in owners.items():
        for v in vs:
            least[v] += len(vs) > 1
    least[7] += 1
    got = dict(zip(nodes.tolist(), counts.tolist(), strict=True))
    assert all(got.get(v, 0) >= n for v, n in least.items()), "a count may be high, never low"


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(60)]
    more = [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = dict(rows(components(spark.createDataFrame(chain + more, "a long, b long"))))
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in chain + more[:-2]:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in at if any(k in e and e[0] != e[1] for e in chain + more[:-2])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
