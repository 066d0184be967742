import random

import pytest

WORDS = "the of and river stone light under golden morning quiet harbour winter paper lantern bridge meadow copper silver window garden".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 9)) * (rng.random() < 0.02)])
        out.append(w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, repeated rows and personal data."""
    rng = random.Random(7)
    out = []
    for i in range(160):
        text = prose(rng, rng.choice([5, 60, 80, 120, 300]))
        if i % 9 == 0:
            text += "\nReleased under the MIT License.\nwrite to Ann.%d@mail.example.com or +1 (017) 555-7713 from 10.0.%d.7" % (i, i)
        if i % 13 == 0:
            text = " ".join(w + "***" for w in text.split())
        out.append((i, text, ["en", "de", None][i % 3], ["a", "a", "b"][i % 3], len(text)))
    base = out[2][1]
    for i in range(160, 190):
        out.append((i, base if i % 2 else base + " more", "en", "a", 1))
    out += [(190, None, "en", "a", None), (191, "", None, None, 0), (192, "   \n\t ", "en", "b", 6), (193, prose(rng, 20000), "en", "a", 9)]
    out += [(5, out[5][1], "en", "a", 3), (5, out[5][1], "en", "a", 3), (7, "another text of the same id", "en", "a", 3), (None, out[3][1], "en", None, 4)]
    return out


@pytest.fixture(scope="session")
def sf(spark, rows, tmp_path_factory):
    """A folder with ``documents`` (and columns that no operator knows)."""
    home = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", "doc_id AS fp", "text AS key", "n_chars AS _distance0", "lang AS h").repartition(3).write.parquet(f"{home}/documents.parquet")
    return str(home)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    return str(home)
