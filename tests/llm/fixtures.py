"""Documents that hold every odd case, with columns whose names operators use inside."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __doc long, gone string, component string, position int"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "par", "sti", "dro") for b in ("", "n", "ra", "tel", "vost", "mi")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(r, lines=4, words=12):
    return "\n".join(sentence(r, words) for _ in range(lines))


def odd_rows(seed=1):
    """(doc_id, text): null id, null and empty texts, white space alone, a long one, copies, repeated rows, the same id twice."""
    r = random.Random(seed)
    base = [text(r) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (21, base[0]), (22, None), (23, ""), (24, " \n\t \r\n"), (None, base[1]), (None, None), (25, base[2]), (25, base[3]), (26, "one"), (27, "ä é ß Σ x y"), (28, "one")]
    out.append((29, "\n".join(sentence(r, 9) for _ in range(600))))
    return out


def docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", 3) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
