import random

import pytest

WORDS = {"en": "the of and that with stone river ing tion house over".split(), "fr": "le que dans eau être réon eux ment pour".split()}


def prose(seed: int, n: int = 120, lang: str = "en") -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


#: Names that operators use for their own columns.
CLASHES = ["shard", "slot", "piece", "length", "salt", "score", "predicted", "id", "n", "size", "copies", "taken", "p", "h1", "_h", "_size", "drop", "template", "line", "pos", "t", "keys", "bucket", "rank", "count", "_class", "_ident", "_salt", "_k", "_r", "_copy", "offset", "sequence_id", "rest", "passes", "last_r", "last_id", "added", "_l", "_share", "_cell", "_low", "members", "_members", "_words", "h", "cell"]


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty, odd and very long texts, repeated rows and clashing columns."""
    long = " ".join(prose(k, 900) for k in range(60))
    rows = [(1, prose(1), "en", "a"), (2, prose(2), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "fr", "c"), (6, prose(6, lang="fr"), "fr", "a"), (7, prose(1), "en", "b"), (7, prose(1), "en", "b"),
            (None, prose(9), "en", "a"), (None, None, None, None), (8, long, "en", "a"), (9, "x" * 50_000, None, "b"), (10, "né 🙂 中文 \x1c don't", "fr", None), (11, "one", "en", "a"), (12, "one", "fr", "b"), (13, "1 2 3 !!!", "en", "")]
    wide = [(i, t, la, s, None if t is None else len(t), *["z"] * len(CLASHES)) for i, t, la, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def empty(spark, nasty):
    return spark.createDataFrame([], nasty.schema)
