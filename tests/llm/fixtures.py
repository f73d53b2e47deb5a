"""Small documents with the cases that break things."""

import random

SYLLABLES = "the an er on re ing tion ou ha st nd es".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def edge_texts() -> list[str | None]:
    base = prose(120, 1)
    words = base.split()
    near = [*words]
    near[40] = "changed"
    return [
        base,
        base,
        base.upper(),
        " ".join(near),
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "one two",
        "One  two\tthree",
        "é ñ ß 你好 \U0001f600 x\x1cy",
        prose(30_000, 2),
        "line one\nline one\n\nline two\nline one",
        "word " * 80,
        "\n".join([prose(20, 3)] * 6),
        "### $$$ %%% " * 40,
        *[prose(60 + i, 10 + i) for i in range(20)],
    ]


# text, a clashing name, a null id, a repeated row
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, stats string, key string"


def edge_docs(spark, texts=None):
    texts = edge_texts() if texts is None else texts
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", None if t is None else len(t), 1, "x", None) for i, t in enumerate(texts)]
    rows += [(None, prose(70, 99), "en", "s", 1, None, None, None), *rows[:1]]
    return spark.createDataFrame(rows, SCHEMA), rows


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
