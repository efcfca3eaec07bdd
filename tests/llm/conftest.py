import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, key int, id string, version string, row int, node string, digest binary, "
    "paragraph string, gram string, bucket int, first string, times int, score_ string, best string, kept boolean, html string, `odd.name x` string"
)


def prose(rng, n):
    out = []
    for k in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"])
        out.append(w.capitalize() + rng.choice([" ", " ", ".\n", ", "]) if k % 9 == 0 else w + " ")
    return "".join(out).strip()


def texts():
    """Documents with every oddity: nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    out = [(0, None, "s1"), (1, "", "s1"), (2, " \t\n\x0b", "s2"), (3, "one", "s2"), (4, "two words", None), (5, "a b c d", "s3"), (6, "\n\n\n", "s3")]
    base = [prose(rng, rng.randrange(20, 300)) for _ in range(30)]
    for k, t in enumerate(base):
        out.append((10 + k, t, f"s{k % 4}"))
    out += [(50, base[0], "s1"), (51, base[0] + " ", "s1"), (52, base[0].replace(" ", "  ", 3), "s9"), (53, base[1] + " tail", "s1"), (54, "x " + base[2], "s2")]
    words = base[3].split(" ")
    for k in range(55, 61):
        changed = list(words)
        changed[k % len(words)] = f"new{k}"
        out.append((k, " ".join(changed), "s0"))
    out += [(70, base[4], "s2"), (70, base[4], "s2"), (70, base[5], "s2"), (None, base[6], "s1"), (None, "no id at all", None), (71, "Été  ÀB\r\nÉTÉ ab\n日本語 テキスト\n\U0001f600 x", "s1")]
    out += [(72, "\n".join([base[7]] * 40 + ["Same long line here"] * 3), "s0"), (73, "same LONG line here\nother line of its own", "s0"), (74, "z" * 70_000, "s0"), (75, prose(rng, 9000), "s0")]
    out += [(76, "tie", "s5"), (77, "tie", "s5"), (-5, "tie", "s5"), (2**62, "tie ", "s5")]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), "S", 1, "I", "V", 2, "N", b"d", "p", "g", 3, "f", 4, "sc", "b", True, "<p>", "o") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, 1, int(i is not None and i % 3 == 0)) for i, _, _ in rows] + [(None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
