import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, bucket long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    out, x = [], seed + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)][:2])
    return " ".join(out)


def documents():
    """Nulls, empties, one long text, copies, repeated rows, odd characters, and columns whose names operators use."""
    base = sentence(3, 60)
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (6, base + " end"), (6, base + " end"), (7, sentence(9, 9000)),
        (8, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. mit license mit license"),
        (9, "mail joe.doe@example.com or call +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1, bad 300.1.1.1 and 1.2.3.4.5"),
        (10, 'token = "0123456789abcdef0123456789abcdef01234567" and é漢\U0001f600 a@b.c_x@y.org'),
        (None, "no id here"), (12, "<|endoftext|> mid <|endoftext|>"), (13, "x" * 5000), (14, "Kelvin LICENSE İ don't 'tis"),
        (15, "this work is licensed under the GNU General Public License, version 3."),
    ]
    texts += [(100 + i, sentence(i, 30) + (" you idiot scum" if i % 4 == 0 else "")) for i in range(60)]
    return [(i, t, ["en", None, "de"][k % 3], ["a", "b", None][k % 3], None if t is None else len(t), 5, "w", 7) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(100 + i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)] + [(100, 1, 1), (None, 1, 1), (101, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
