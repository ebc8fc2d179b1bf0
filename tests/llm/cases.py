"""Small documents with the awkward cases: nulls, empties, long texts, ties, repeats, odd white space and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _norm string, _n long, key string, node long, sig long"


def documents(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{r.randrange(400)}" for _ in range(400)]
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randrange(5, 80)))
        out.append((i, text))
    for k in range(n, n + 40):  # near copies
        base = r.choice(out[:n])[1].split(" ")
        for _ in range(r.randrange(0, 3)):
            base[r.randrange(len(base))] = f"x{r.randrange(9)}"
        out.append((k, " ".join(base)))
    out += [
        (900, None), (901, ""), (902, " \n\t "), (903, "A b"), (904, "a  B"), (905, "one"), (906, "a\x0bb\x0cc d\re"),
        (907, " ".join(["again and again we say it"] * 50)), (908, "line\nline\nother\n \nline"), (909, "é ünï 漢字 🙂 code"),
        (910, " ".join(f"t{r.randrange(3000)}" for _ in range(9000))), (3, out[3][1]), (3, out[3][1]), (None, out[4][1]), (None, None),
    ]
    langs, sources = ["en", "de", None], ["a", "a", "b", None]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), 7, "x", 1, "k", 5, 9) for k, (i, t) in enumerate(out)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def plain(rows):
    return [(r[0], r[1]) for r in rows]
