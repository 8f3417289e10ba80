"""Documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, row int, _id string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    texts = [None, "", " ", "\n\t", "one", "a b\nc  d", words(30, 1), words(30, 1), words(30000, 2), "Ärger Öl éè 漢字 🙂 end", "x" * 5000, "you <|endoftext|> idiot", "a\x1cb \x85 c\xa0d e"]
    rows = [(i, t, "en" if i % 2 else None, [None, "s", "t", ""][i % 4], None if t is None else len(t), 1, 2, 0.5, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "null id", "en", "s", 7, 1, 2, 0.5, 3, "x"), (None, None, None, None, None, None, None, None, None, None)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
