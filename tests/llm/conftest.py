from __future__ import annotations

import pytest

CLASH = "n_words long, score double, fp long, secrets string, kinds string, row string, rank int, root long"


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, ties, and columns whose names operators use."""
    line = "one two three four five six seven eight nine ten"
    texts = {
        0: "", 1: None, 2: " \n\t ", 3: line, 4: line, 5: (line + "\n") * 400, 6: "x" * 60_000, 7: "password = hunter2hunter2 " + line,
        8: "Ünï çödé 漢字 🙂 <|endoftext|> it's " + line, 9: "THIS IS LOUD!! " * 30, 10: "a | b | c | " * 20, 11: "word",
    }
    rows = [(k, t) for k, t in texts.items()] + [(3, line), (None, line), (None, None), (None, "only here"), (9, texts[9])]
    extra = (1, 0.5, 2, "s", "k", "r", 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
