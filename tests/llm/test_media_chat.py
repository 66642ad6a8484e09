import base64
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm import chat_format as C
from grovespark.llm import media, webp
from tests.conftest import rows
from tests.llm.fixtures import docs, odd_rows, sentence
from tests.llm.vp8l import encode


def picture(seed, h, w, colours=None):
    g = np.random.default_rng(seed)
    if colours:
        table = g.integers(0, 256, (colours, 4), dtype=np.uint8)
        return table[g.integers(0, colours, (h, w))]
    x = np.cumsum(g.integers(-3, 4, (h, w, 4)), axis=1) + np.arange(h)[:, None, None] * 2
    return (x % 256).astype(np.uint8)


@pytest.mark.parametrize("h,w", [(1, 1), (1, 7), (5, 1), (9, 13), (20, 33)])
@pytest.mark.parametrize("options", [{}, {"cache": 4}, {"lz": True}, {"cache": 11, "lz": True}, {"green": True}, {"cross": True}, {"predictor": True}, {"groups": True}, {"predictor": True, "cross": True, "green": True, "lz": True, "cache": 6, "groups": True}], ids=str)
def test_webp_round_trip(h, w, options):
    p = picture(h * w, h, w)
    assert (webp.decode(encode(p, **options)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_webp_palettes(colours):
    p = picture(colours, 11, 19, colours)
    assert (webp.decode(encode(p, palette=True)) == p).all()
    assert (webp.decode(encode(p, palette=True, lz=True, cache=3)) == p).all()


def test_webp_repeats_use_references():
    p = np.tile(picture(1, 4, 8), (6, 5, 1))
    assert len(encode(p, lz=True)) < len(encode(p)) / 4
    assert (webp.decode(encode(p, lz=True)) == p).all()


def test_webp_damage():
    good = encode(picture(2, 8, 8), predictor=True)
    for bad in (b"", good[:30], good[:12] + b"VP8 " + good[16:], good[:20] + b"\0" + good[21:], good[:-12]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    stored = webp.bytes_to_webp(np.random.default_rng(1).bytes(640))
    for cut in (70, 400):
        with pytest.raises(ValueError):
            webp.decode(stored[:-cut] + stored[-6:])


@pytest.mark.parametrize("kind", ["noise", "zeros", "prose", "two values"])
@pytest.mark.parametrize("n", [64, 128, 64 * 999, 1 << 20, (1 << 20) + 64])
def test_payloads(n, kind):
    g = np.random.default_rng(n)
    raw = {"noise": g.bytes(n), "zeros": bytes(n), "prose": (" ".join(sentence(random.Random(n), 12) for _ in range(n // 40 + 2))).encode()[:n], "two values": g.choice([7, 200], n).astype(np.uint8).tobytes()}[kind]
    stored = webp.bytes_to_webp(raw)
    assert webp.webp_to_bytes(stored, n) == raw
    assert kind == "noise" or n < 1000 or len(stored) < n * 0.7
    pixels = webp.decode(stored)
    assert (pixels[..., 0] == pixels[..., 1]).all() and (pixels[..., 2] == pixels[..., 1]).all() and (pixels[..., 3] == 255).all()


def test_stored_images_take_the_general_path(monkeypatch):
    """Prefix codes, back-references and a transform: without any of them the payload doesn't come back."""
    raw = media.padded((" ".join(sentence(random.Random(8), 12) for _ in range(30)) * 2).encode())
    stored = webp.bytes_to_webp(raw)
    calls = []
    pixels, green = webp._pixels, webp.subtract_green
    monkeypatch.setattr(webp, "_pixels", lambda bits, codes, *rest: calls.append([len(c.table) for c in codes[0]]) or pixels(bits, codes, *rest))
    monkeypatch.setattr(webp, "subtract_green", lambda argb, sign: calls.append(sign) or green(argb, sign))
    assert webp.webp_to_bytes(stored, len(raw)) == raw
    assert calls[1:] == [1] and calls[0][0] > 16 and calls[0][4] > 1 and calls[0][1:4] == [1, 1, 1]


def test_images_made_elsewhere():
    """Published images of one pixel, which other software wrote."""
    for image, pixel in (("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", [0, 0, 0, 0]), ("UklGRiIAAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", None)):
        got = webp.decode(base64.b64decode(image))
        assert got.shape == (1, 1, 4)
        assert pixel is None or got.ravel().tolist() == pixel


@pytest.mark.parametrize("counts", [[1, 1], [5, 0, 3, 1], [10**6, 1, 1, 1], list(range(1, 281)), [2**k for k in range(30)]], ids=str)
def test_code_lengths(counts):
    n = webp.code_lengths(np.array(counts))
    assert ((n > 0) == (np.array(counts) > 0)).all() and n.max() <= webp.LONGEST_MADE and sum(2.0 ** -int(x) for x in n if x) == 1


def test_media(spark):
    got = media.describe(media.store(docs(spark))).collect()
    assert len(got) == len(odd_rows())
    want = {}
    for i, t in odd_rows():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.setdefault(i, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest()))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) in want[r["doc_id"]] and r["payload_bytes"] % 64 == 0
    by_text = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert media.describe(media.store(docs(spark, []))).count() == 0
    # the stored form and the feature by plain means, and the pixels as a column
    stored = media.store(docs(spark))
    by_id = {r["doc_id"]: r for r in media.describe(stored).collect() if r["doc_id"] is not None and r["doc_id"] < 12}
    for r in media.pixels(stored).collect():
        if r["doc_id"] in by_id:
            raw = odd_rows()[r["doc_id"]][1].encode()
            payload = raw + bytes(-len(raw) % 64)
            grey = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 4)
            assert grey[..., 0].tobytes()[: len(payload)] == payload and (r["width"], r["height"]) == (64, len(payload) // 64)
            counts = [sum(x >> 4 == k for x in payload) for k in range(16)]
            assert by_id[r["doc_id"]]["feature"] == f"{r['height']}x64:" + ",".join(map(str, counts))
    for r in stored.collect():
        if r["doc_id"] in by_id:
            assert by_id[r["doc_id"]]["media_bytes"] == len(r["media"]) < by_id[r["doc_id"]]["payload_bytes"] and by_id[r["doc_id"]]["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()


TURNS = [
    (1, 0, "system", "be [kind] \\ </s>"), (1, 1, "user", "<s>[USER] x [/USER]"), (1, 2, "assistant", "a\nb\\[ä🙂"), (2, 0, "assistant", None), (2, 1, None, "x"), (3, 0, "tool] [x", "y"), (3, 0, "a\\", "z"),
    (3, 0, "a\\", "z"), (None, 5, "user", ""), (4, 1, "user", "later"), (4, 0, "assistant", "first"), (5, 0, "ROLE", "[ROLE a] b"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, C.TURNS)
    formatted = C.format_turns(turns)
    back = C.parse_turns(formatted)
    assert rows(back, "conv_id", "turn", "role", "text") == sorted([(i, k, r or "", t or "") for i, k, r, t in TURNS], key=repr)
    for r in formatted.collect():
        body = r["formatted"][4:]
        assert body.count("<s>") == 0 or "\\<s>" in body
    got = {r["conv_id"]: r for r in C.conversation_digests(formatted).collect()}
    order = sorted(((i, k, r or "", t or "") for i, k, r, t in TURNS), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    for conv in {x[0] for x in order}:
        mine = [x for x in order if x[0] == conv]
        loss = "".join(t for _, _, r, t in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.conversation_digests(C.format_turns(turns.where("false"))).count() == 0


def test_planted_marks(spark):
    conversations = spark.createDataFrame([(7, 0, "user", "q", "extra")], C.TURNS + ", __turn string")
    got = {r["conv_id"]: r for r in C.digests(conversations).collect()}
    assert set(got) == {-1, 7} and got[-1]["loss_chars"] == len(C.PLANTED)
    assert got[-1]["loss_sha256"] == hashlib.sha256(C.PLANTED.encode()).hexdigest()


def test_layouts(spark):
    one = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id int, conversations array<struct<`from`: string, value: string>>")
    two = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id bigint, messages array<struct<role: string, content: string>>")
    three = spark.createDataFrame([(1, "q", "", "a")], "conv_id bigint, instruction string, input string, output string")
    four = spark.createDataFrame([(1, "q", "a")], "conv_id bigint, prompt string, completion string")
    for df in (one, two, three, four):
        assert rows(C.canonical(df)) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert rows(C.canonical(spark.createDataFrame([(1, "q", "in", "a")], three.schema)))[0][3] == "q\n\nin"
    with pytest.raises(ValueError):
        C.canonical(four.withColumn("more", F.lit(1)))
    assert rows(C.canonical(four.withColumn("more", F.lit(1)), four.columns)) == rows(C.canonical(four))
    assert C.fingerprint(C.field_paths(one.schema)) != C.fingerprint(C.field_paths(two.schema))
    records = [{"conv_id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"conv_id": 2, "prompt": "p", "completion": "c"}, {"conv_id": 3, "what": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{",), (None,)], "record string")
    got = rows(C.canonical_json(df))
    assert [g[:4] for g in got if g[4] is None] == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "p"), (2, 1, "assistant", "c")]
    assert sorted(g[4] for g in got if g[4]) == ["no JSON", "no JSON", "unknown layout"]


def test_roles_are_kept(spark):
    """Names that other layouts have for roles are roles like any other in rows of turns; only assistants are learned from."""
    turns = [(1, 0, "human", "q"), (1, 1, "GPT", "a"), (1, 2, "assistant", "b"), (1, 3, "Assistant", "c"), (1, 4, "model", "d")]
    got = {r["conv_id"]: r for r in C.digests(spark.createDataFrame(turns, C.TURNS)).collect()}[1]
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    assert (got["loss_chars"], got["loss_sha256"]) == (1, hashlib.sha256(b"b").hexdigest())


def test_odd_records(spark):
    """What can't be read is a row that says so; nothing fails the job."""
    records = [
        ('{"conv_id": "x", "prompt": "p", "completion": "c"}', (None, "unknown layout")),
        ('{"conv_id": "x", "what": 1}', (None, "unknown layout")),
        ('{"conv_id": 1.5, "prompt": "p", "completion": "c"}', (None, "conv_id is no whole number")),
        ('{"conv_id": 99999999999999999999, "prompt": "p", "completion": "c"}', (None, "conv_id is no whole number")),
        ('{"conv_id": 2, "messages": [{"role": "user", "content": "q"}, null]}', (2, "unknown layout")),
        ('{"conv_id": 3, "messages": [{"role": "user", "content": "\\ud800"}]}', (3, "a text isn't Unicode")),
        ('{"conv_id": 4, "turn": 1.5, "role": "user", "text": "q"}', (4, "turn is no whole number")),
        ('{"conv_id": 5, "messages": []}', (5, "unknown layout")),
        ("[" * 100000, (None, "no JSON")),
        ("[1]", (None, "unknown layout")),
    ]
    df = spark.createDataFrame([(r,) for r, _ in records], "record string")
    got = C.canonical_json(df).collect()
    assert rows(spark.createDataFrame(got, f"{C.TURNS}, error string"), "conv_id", "error") == sorted([w for _, w in records], key=repr)
    assert all(r["turn"] is None and r["role"] is None and r["text"] is None for r in got)
    good = ['{"conv_id": 6, "prompt": "p", "completion": null}', '{"conv_id": null, "turn": 0, "role": null, "text": "q"}', '{"conv_id": 7, "messages": [{"role": "human", "content": null}]}']
    got = rows(C.canonical_json(spark.createDataFrame([(r,) for r in good], "record string")))
    assert got == sorted([(6, 0, "user", "p", None), (None, 0, None, "q", None), (7, 0, "human", None, None)], key=repr)


def test_random_texts_survive(spark):
    r = random.Random(3)
    turns = [(k, 0, r.choice(["user", "x[y]\\"]), "".join(r.choice("\\[]</s> \n[USER]ab") for _ in range(30))) for k in range(300)]
    back = C.parse_turns(C.format_turns(spark.createDataFrame(turns, C.TURNS)))
    assert rows(back, "conv_id", "turn", "role", "text") == sorted(turns, key=repr)
