import pytest

CLASH = ["node", "shard", "text_hash", "kept", "score", "words", "_id", "_text", "_out", "root", "label", "token_ids", "norm", "n_words"]
LONG = "lorem ipsum dolor sit amet " * 8000
PASSAGE = " ".join(f"word{i} other{i * 7 % 31}" for i in range(40))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    texts = {
        1: None, 2: "", 3: "   \n\t ", 4: "The same TEXT here, for ever.", 5: "the same text here, for ever.", 6: LONG, 7: LONG,
        8: "1234 5678 !!", 9: "é" * 120 + " naïve Straße Σας", 10: PASSAGE, 11: "before it " + PASSAGE + " after it", 12: PASSAGE.upper(),
        13: "mail a.b@c.de or 10.0.0.1, +1 (555) 123-4567; 4111 1111 1111 1111.", 14: "\x00\x01\x1f", 15: "one", 16: "a" * 5000,
        17: "Released under the MIT License. Apache  License; the GNU General Public License", 18: "<|endoftext|> don't 😀",
    }
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t) if t else None) for i, t in texts.items()]
    rows += [rows[3], (None, "the same text here, for ever.", None, None, None), (10, "an other text of id ten", "en", "src0", 23)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = spark.createDataFrame([(*r, *range(len(CLASH))) for r in odd_rows], schema + "".join(f", {c} int" for c in CLASH))
    return wide.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
