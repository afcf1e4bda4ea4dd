"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, id long, k long, keys string, fp long, kept boolean"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120)
    shared = "this line is shared by several documents"
    texts = [
        None, "", " \t\n ", "a", "one two", base, base, base.upper(), base.replace(" ", "  "),
        base.rsplit(" ", 1)[0] + " other", words(rng, 60) + "\n" + shared + "\n" + words(rng, 5), words(rng, 30) + "\n  " + shared.upper() + "\t\n",
        shared + "\n" + words(rng, 40) + "\n" + shared, words(rng, 4000), "x" * 20000, "é" * 19 + "\n" + "é" * 20 + "\n" + "日本語テキスト 👍🏽 don't we'll 3.14",
        "mail me.x@a.example.org or +1 (028) 555-6891 from 10.0.0.1, card 4111 1111 1111 1111\ntoken = \"" + "9fb3ac1278d40e56" * 2 + "aa00bb11\"", "\u0000\u001c   end",
    ]
    texts += ["é" * 20, "É" * 20 + "\n" + "é" * 20, "é" * 20]
    out = [(i, t, rng.choice(["en", "de", None]), "s", None, "clash", "clash", -i, i, "clash", i, None) for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, base, "en", None, 3, None, None, None, None, None, None, None))
    out.append((5, words(rng, 10), "en", None, 3, None, None, None, None, None, None, None))  # a repeated id
    return out


def frame(spark, given: list[tuple] | None = None, partitions: int = 3):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA).repartition(partitions)
