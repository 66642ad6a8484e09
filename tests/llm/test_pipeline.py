"""The pipeline against brute-force versions of its stages, each on its own input."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from grovespark.llm.line_dedup import RUN
from tests.llm.fixtures import sentence, text
from tests.llm.test_dedup import model_components, model_lines, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(folder, spark):
    r = random.Random(12)
    items = [(k, " ".join(sentence(r, 12) for _ in range(2))) for k in range(5)]
    shared = "\n".join(sentence(r, 10) for _ in range(4))
    rows, toxic, copies, leaks = [], set(), {}, set()
    for k in range(260):
        t = text(r, r.randint(3, 6), 12)
        if k % 13 == 0:
            t, _ = t + " Filthy scumbag.", toxic.add(k)
        elif k % 17 == 0:
            t = f"{t}\n{shared}"
        elif k % 19 == 0:
            t, _ = f"{t} {r.choice(items)[1]} So it ends.", leaks.add(k)
        elif k % 7 == 0 and k > 100:
            of = r.choice([i for i in range(100) if i % 13 and i % 17 and i % 19 and i % 7])
            words = rows[of][1].split(" ")
            words[r.randrange(3)] = "edit"
            t, copies[k] = " ".join(words).replace("\n", " "), of
        rows.append((k, t))
    rows += [(900, None), (901, ""), (902, "just one line")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return items, toxic, copies, leaks


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    items, toxic, copies, leaks = tables(folder, spark)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, states = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert docs.columns == columns
            states.append({r["doc_id"]: r["text"] for r in docs.collect()})
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert states[0] == {i: t for i, t in first.items() if i not in toxic}
    gone = model_lines(list(states[0].items()), RUN)
    want = {}
    for i, t in states[0].items():
        cut = {k for a, _, k in gone if a == i}
        new = t if not cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        if not cut or new.strip():
            want[i] = new
    assert states[1] == want and want != states[0]
    ids = sorted(states[1])
    groups = model_components([shingles(states[1][i]) for i in ids])
    assert states[2] == {i: states[1][i] for k, i in enumerate(ids) if groups[k] == k} and len(states[2]) < len(states[1])
    assert not [k for k, of in copies.items() if k in states[2] and of in states[2]]
    assert set(states[2]) - set(states[3]) == leaks & set(states[2]) and states[3].items() <= states[2].items()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in states[3].items()}
    got = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"]: r["sum(length)"] for r in got} == total == {r["doc_id"]: r["max(doc_tokens)"] for r in got}
    ran = sorted(tuple(r) for r in P.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())
    assert ran == sorted(tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect())
    assert np.all(np.array([r[2] for r in ran]) <= 2048)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
