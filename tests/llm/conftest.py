import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, rep long, sig long, length long, number long, held_out boolean, host string, a long, b long"
PAGES = "page_id long, url string, html string, file string, offset long, sha string, size long, noise string, rule string, text string"


def prose(seed, n, letters="etaoinshrdlu"):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 8))) for _ in range(60 + n // 4)]
    return " ".join(pick.choice(vocabulary) for _ in range(n))


def texts():
    """Null, empty, blank, short, long, equal, near equal, repetitive, noisy and non-ASCII texts."""
    base = prose(1, 200)
    words = base.split()
    near = words[:100] + ["changed"] + words[101:]
    nearer = words[:50] + ["once"] + words[51:]
    noise = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + (" " if i % 40 == 39 else "") for i in range(6000))
    return [
        None, "", " \n\t ", "one", "two words", base, base, base.upper(), " ".join(near), " ".join(nearer), prose(2, 30000),
        "same line here\n" * 40, "spam " * 300, noise, "é ü ß ñ İ Σίσυφος 日本語 \u2028 x\x85y\xa0z \x1c", "It's <|endoftext|> 12.5 don't",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. GNU General Public License", prose(4, 70),
        "a b c", "A B C", "a b c d e f g h i j", "!!!! ??? ###", "x" * 20000,
    ]


def document_rows(values):
    return [(i, t, ("en", "de", None)[i % 3], "src0", None, 1, 0.5, i, i, i, i, True, "h", 1, 2) for i, t in enumerate(values)]


@pytest.fixture(scope="session")
def messy(spark):
    rows = document_rows(texts())
    rows.append(rows[5])  # a repeated row
    rows.append((None, *rows[5][1:]))  # no id, a known text
    rows.append((None, None, *rows[5][2:]))
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def pages(spark):
    bodies = [None, "", "plain <b>text</b>", *(f"<html><body><nav><li>m{i}</li></nav><article><h1>T{i}</h1><p>{prose(i, 30)}</p></article><footer>f</footer></body></html>" for i in range(12))]
    urls = [None, "", "no scheme", "https://A.Example.net/en/1?q#f", "http://sub.example.com/de/", "https://x.org/fr/2", "https://net", "ftp://e.net:80/en/", "https://u\r\nWARC-Type: evil/%20ü"]
    rows = [(i, urls[i % len(urls)], h, "f", 1, "s", 2, "n", "r", "t") for i, h in enumerate(bodies + bodies[3:6] + [bodies[0]])]
    rows += [rows[4], (None, *rows[4][1:]), (None, None, None, *rows[4][3:])]
    return spark.createDataFrame(rows, PAGES).repartition(3).cache()


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGES)
