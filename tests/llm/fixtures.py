"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = "ba de fi go lu ma ne po ri su ta ve wo xi ya ze".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, key string, kept string, taken string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


def edit(text, seed, every):
    w = text.split(" ")
    for i in range(seed % every, len(w), every):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def rows():
    base = [prose(i, 120) for i in range(6)]
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "one two three four",
        base[0],
        base[0],
        edit(base[0], 1, 60),
        edit(base[0], 2, 60),
        base[1] + "\n" + base[2],
        base[2],
        base[3],
        base[3] + " " + base[3],
        "\n".join([base[4][:80]] * 6),
        prose(99, 12000),
        "x" * 300,
        base[5] + " mail a.b@example.com or +1 (555) 010-2030, ip 10.0.0.1 card 4539 1488 0343 6467",
        "ein äußerst schöner Text mit ünïcode " * 9,
    ]
    out = [(i, t, None if i == 9 else ("en", "de")[i % 2], None if i % 7 == 3 else f"s{i % 4}", len(t or ""), "x", "y", "z", "w", "v") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base[1], "en", "s1", 5, "x", "y", "z", "w", "v")]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 0, 0), (13, 0, None), (None, 1, 1), (10, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
