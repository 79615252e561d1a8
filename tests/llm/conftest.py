import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names the operators use themselves.
SCHEMA = (
    T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
    .add("rank", "string").add("shard", "string").add("d", "string").add("root", "string").add("node", "string").add("doc", "string").add("kept", "string")
    .add("score", "double").add("items", "string").add("n_words", "string").add("crc", "string").add("g", "string")
)
EN = "the cat of the house and the dog in the garden that was with him for all of this"
DE = "der hund und die katze sind nicht mit dem kind in das haus gegangen weil es schon dunkel war"
FR = "le chat et la maison sont dans une rue que nous avons vue avec les enfants pour aller au marché"
ES = "el perro y la casa están en una calle que los niños han visto con su padre para ir al mercado"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, lang)."""
        full = [(*r, *[None] * (3 - len(r)), "s", None, *["x"] * 7, 0.5, *["y"] * 4) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and long texts, repeated rows, texts without letters."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, EN, "en"), (1, EN, "en"), (1, DE, "de"), (2, None, "en"), (3, "", None), (None, FR, "fr"), (None, None, None), (4, "1 2 3 !!", "es"),
        (5, long, "en"), (6, long + " tail", "en"), (7, f"{ES}\n{ES}\n\n{ES}", "es"), (8, "\n\n", "fr"), (9, "x" * 100_000, "de"), (10, EN + " yes", "en"),
    ]
    return frame(rows)
